"""Queries of renderings, specialists, skill plans and evaluations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import normalise, patterns, specialists
from quern.plans import control, domain, evaluation, planner
from quern.plans.registry import query, table

_NONE = lambda x: f"coalesce(CAST({x} AS VARCHAR), 'None')"


@query(f"""WITH {domain._SC} SELECT id AS event_id, CASE type WHEN 'PURCHASE_ORDER' THEN 'Purchase order ' || po_number || ' from supplier ' || {_NONE('supplier_id')} || ' for part ' || coalesce(part_name, part_id) || ' qty ' || quantity || ' status ' || {_NONE('status')} || '.'
WHEN 'SHIPMENT_UPDATE' THEN 'Shipment ' || shipment_id || ' via None from ' || {_NONE('origin_facility')} || ' to ' || destination_facility || ' status ' || {_NONE('status')} || ' lead Noned (expected Noned).'
WHEN 'QUALITY_RESULT' THEN 'Quality inspection ' || inspection_id || ' for part ' || part_id || ' result ' || result || ' defect_rate None.'
WHEN 'DISRUPTION_ALERT' THEN 'Disruption None at ' || facility_id || ' severity ' || severity || ' region ' || {_NONE('region')} || '. None'
ELSE 'Inventory at ' || facility_id || ' part ' || part_id || ' on_hand ' || on_hand_qty || ' ' || CASE WHEN below_reorder THEN 'BELOW REORDER' ELSE 'ok' END || ' days_of_supply None.' END AS text FROM sc""")
def supply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P10] What supply-chain events say; what they lack reads None."""
    events = domain.supply_events(spark, sf_dir)
    return events.select("event_id", normalise.rendered(F.col("event_type"), F.col("payload_json"), normalise.SUPPLY_SENTENCES, F.col("payload_json"), 500).alias("text"))


@query(f"""WITH {domain._EV}, {domain._FIRED},
o AS (SELECT patient_id, list_sort(list(DISTINCT {{'event': seq, 'abnormal': coalesce(abnormal, false)}}))[1:20] AS v FROM ev WHERE {domain._LAB} GROUP BY 1),
s AS (SELECT patient_id, list_sort(list(DISTINCT {{'observation': lab_name, 'condition': condition}}))[1:20] AS v FROM fired GROUP BY 1),
f AS (SELECT p.patient_id, CAST(coalesce(len(s.v), 0) AS INTEGER) AS lab_signal_count, CAST(coalesce(len([x FOR x IN o.v IF x.abnormal]), 0) AS INTEGER) AS abnormal_observation_count FROM (SELECT DISTINCT patient_id FROM ev) p LEFT JOIN o ON o.patient_id = p.patient_id LEFT JOIN s ON s.patient_id = p.patient_id)
SELECT * FROM f WHERE lab_signal_count + abnormal_observation_count > 0""")
def lab_specialist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q11, F15] Patients with signals or abnormal results among their first twenty."""
    labs = domain.clinical_events(spark, sf_dir, "LAB_RESULT").select("patient_id", F.struct(F.col("arrival_seq").alias("event"), F.coalesce("payload.abnormal", F.lit(False)).alias("abnormal")).alias("observations"))
    signals = domain.lab_signals(spark, sf_dir).select("patient_id", F.struct(F.col("lab_name").alias("observation"), "condition").alias("lab_signals"))
    patients = table(spark, sf_dir, "events").select(F.expr(domain.ENVELOPE["patient_id"]).alias("id")).distinct()
    context = patterns.with_lists(patients, "id", patterns.together(labs, signals), "patient_id", {"observations": 20, "lab_signals": 20})
    return specialists.lab_interpretation(context, "id").select(F.col("id").alias("patient_id"), "lab_signal_count", "abnormal_observation_count")


@query("""WITH r AS (SELECT l_suppkey, list_sort(list(DISTINCT {'signal': signal, 'part': l_partkey})) AS v FROM (SELECT l_suppkey, l_partkey, 'quality' AS signal FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT l_suppkey, l_partkey, 'delay' FROM lineitem WHERE l_quantity > 45) GROUP BY 1),
p AS (SELECT l_suppkey, len(list_sort(list(DISTINCT l_partkey))) AS n FROM lineitem GROUP BY 1)
SELECT s_suppkey AS supplier_id, CAST(len(r.v) AS INTEGER) AS signal_count, CAST(p.n AS INTEGER) AS affected_parts, CAST(nullif(len([x FOR x IN r.v IF x.signal = 'quality']), 0) AS INTEGER) AS quality_issues FROM supplier LEFT JOIN r ON r.l_suppkey = s_suppkey LEFT JOIN p ON p.l_suppkey = s_suppkey WHERE p.n > 0""")
def supply_specialists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q12] What each supply specialist says of each supplier, of all its signals and parts."""
    part = F.col("l_partkey")
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", part).agg(F.max(F.col("l_discount") > 0.05).alias("quality"), F.max(F.col("l_quantity") > 45).alias("delay"))
    counts = pairs.groupBy("l_suppkey").agg(F.count("*").alias("n_parts"), F.count_if("quality").alias("n_quality"), F.count_if("delay").alias("n_delay"))
    counts = counts.withColumn("n_risk_signals", F.col("n_quality") + F.col("n_delay"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"))
    context = suppliers.join(counts, F.col("supplier_id") == F.col("l_suppkey"), "left").na.fill(0, ["n_parts", "n_quality", "n_risk_signals"])
    parts = specialists.disruption_impact(context)
    found = parts.join(specialists.supplier_risk(context), "supplier_id", "left").join(specialists.quality_review(context), "supplier_id", "left")
    return found.select("supplier_id", *[F.col(n).cast("int").alias(n) for n in ("signal_count", "affected_parts", "quality_issues")])


@query(r"""SELECT CASE conv_id % 3 WHEN 0 THEN 'single_pass' WHEN 1 THEN 'loop' ELSE 'graph' END AS mode, round(avg(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' OR starts_with(text, 'LLM error:') THEN 0.0 WHEN length(text) > 50 AND length(text) < 5000 THEN 1.0 ELSE 0.5 END), 4) AS quality,
round(avg(CASE WHEN turn <= 1 THEN 1.0 WHEN turn >= 4 THEN 0.0 ELSE 1 - (turn - 1) / 3 END), 4) AS latency, count(*) AS cases FROM conversations GROUP BY 1""")
def evaluation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q23, P32, P33] Mean scores of every turn by the mode that answered it."""
    mode = F.when(F.col("conv_id") % 3 == 0, "single_pass").when(F.col("conv_id") % 3 == 1, "loop").otherwise("graph")
    cases = table(spark, sf_dir, "conversations").select(mode.alias("mode"), evaluation.quality_score(F.col("text")).alias("quality"), evaluation.linear_score(F.col("turn"), 1, 4).cast("double").alias("latency"))
    return evaluation.compared(cases, "mode", ["quality", "latency"])


#: A layer of skills for the kinds of events: what a goal needs, and what each skill needs.
_GOALS = {"signup": ("welcome", "profile"), "purchase": ("bill", "profile", "thank"), "view": ("profile",), "click": ()}
_SKILLS = {"welcome": (("mail", "crm"), ("customer",)), "profile": (("crm", "search"), ("customer", "history")), "bill": (("ledger", "mail"), ("order",)), "thank": (("mail",), ())}
_IN_ORDER = lambda goal, at: list(dict.fromkeys(x for s in _GOALS[goal] for x in _SKILLS[s][at]))


@query("SELECT g.goal, count(*) AS events, g.tools, g.needs FROM events JOIN (VALUES " + ", ".join(f"('{g}', '{','.join(_IN_ORDER(g, 0))}', '{','.join(_IN_ORDER(g, 1))}')" for g in _GOALS) + ") AS g(goal, tools, needs) ON g.goal = event_type GROUP BY ALL")
def skill_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[Q22, J20, U07] The skills that each kind of event asks for, what they need once each in order of first mention."""
    goals = spark.createDataFrame([(g, list(s)) for g, s in _GOALS.items()], "goal string, skills array<string>")
    skills = spark.createDataFrame([(s, list(t), list(n)) for s, (t, n) in _SKILLS.items()], "skill string, tools array<string>, needs array<string>")
    asked = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("goal")).agg(F.count("*").alias("events"))
    plans = planner.skill_plans(goals, skills, ["tools", "needs"])
    return asked.join(plans, "goal").select("goal", "events", F.array_join("tools", ",").alias("tools"), F.array_join("needs", ",").alias("needs"))


@query("""WITH h AS (SELECT conv_id, list('- patient=' || conv_id || ' event=' || role || ' score=' || length(text) || '.000' ORDER BY turn)[1:5] AS lines, arg_min(text, turn) AS question FROM conversations GROUP BY 1)
SELECT conv_id, sha256('Answer from the evidence below only, and say what is missing.' || chr(10) || 'Question: ' || question || chr(10) || 'Events:' || chr(10) || array_to_string(lines, chr(10)) || chr(10) || 'Patients:' || chr(10) || '- none' || chr(10) || 'Close with a safety caveat: synthetic demo data, not medical advice.') AS prompt_sha256 FROM h""")
def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P34, P35] The prompt of every conversation, its first five turns as evidence."""
    turns = table(spark, sf_dir, "conversations")
    hit = F.struct(F.col("conv_id").cast("string").alias("patient_id"), F.col("role").alias("event_type"), F.char_length("text").cast("double").alias("score"))
    hits = patterns.listed_in_order(turns, "conv_id", hit, F.col("turn"), 5, "hits").join(turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")), "conv_id")
    return hits.select("conv_id", F.sha2(control.prompt_column(F.col("question"), F.col("hits")), 256).alias("prompt_sha256"))


@query("SELECT user_id, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (value > 20))[1:3], ','), '') AS kinds FROM events GROUP BY 1")
def distinct_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A02] The first three distinct kinds of a user's large events; nulls are skipped."""
    events = table(spark, sf_dir, "events")
    lists = patterns.listed(events, "user_id", F.when(F.col("value") > 20, F.col("event_type")), 3, "kinds")
    users = events.select("user_id").distinct().join(lists, "user_id", "left")
    return users.select("user_id", F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"))


@query("SELECT o_custkey AS owner, l_partkey AS item, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def items_without_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context without one of its columns, which the scan then does not read."""
    from quern.plans.catalog import order_items

    return patterns.without(order_items(spark, sf_dir), "state").groupBy("owner", "item").agg(F.count("*").alias("n"))
