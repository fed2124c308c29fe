"""The thin queries over the standard tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import alignment, byte_bpe, co_training, divergence, language_id, line_dedup, mixing, pii, quality_rules, secrets, simhash, suffix_dedup, topk
from quern.llm.common import long_texts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op1] Lines before dropping, lines dropped, hash of what is kept; null and empty texts are one empty line."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    report = F.col("line_report")
    return found.select("doc_id", report["n_lines"].alias("n_lines"), report["n_dropped"].cast("long").alias("n_dropped"), F.sha2(report["kept"], 256).alias("kept_sha256"))


def exact_topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op2] The twenty best of every twentieth vector; unusable vectors take no part, an empty table gives no row."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op3] Rule counts, the plain rules' verdict, and the forests'; a null text has no word and fails."""
    rows = quality_rules.measured(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality_rules.judge_measured(rows, quality_rules.fit_measured(rows, _table(spark, sf_dir, "labels")))
    failed = quality_rules.base_failed("rules")
    counts = [F.col(f"rules.{c}").alias(c) for c in quality_rules.COUNTS]
    return judged.select(F.col("id").alias("doc_id"), *counts, failed.alias("base_failed"), (~failed & F.col("verdict.normal")).alias("kept"), F.col("verdict.anomaly").alias("anomaly"))


def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op4] Token ids and what they decode to, as hashes; a null text is empty."""
    both = long_texts(_table(spark, sf_dir, "documents")).select("doc_id", byte_bpe.encode_decode(F.col("text")).alias("bpe"))
    ids, decoded = F.col("bpe.ids"), F.col("bpe.decoded")
    return both.select("doc_id", F.expr("octet_length(bpe.ids) div 4").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op5] Personal data by kind; a null text has none."""
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.KINDS if k.base]
    counts = [F.size(F.filter("pii", _kind_is(k))).cast("long").alias(f"n_{k}") for k in base]
    base_text = pii.spans_text(F.filter("pii", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *counts, F.sha2(base_text, 256).alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"), pii.scores_text(F.col("pii")).alias("scores"))


def _kind_is(kind: str):
    return lambda span: span["kind"] == kind


def secret_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op6] Secrets by kind; a null text has none."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.fit(docs))
    base = ("assign", "access", "hex")
    counts = [F.size(F.filter("secrets", _kind_is(k))).cast("long").alias(f"n_{k}") for k in base]
    base_text = pii.spans_text(F.filter("secrets", lambda s: s["kind"].isin(*base)))
    return found.select("doc_id", *counts, F.sha2(base_text, 256).alias("base_sha256"), pii.spans_text(F.col("secrets")).alias("spans"))


def source_mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op7] What the mix takes of each row; repeated rows are rows of their own, a null text has size 0."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op8] Fingerprint and component; texts without a word have fingerprint zero, repeated rows are in one component."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op9] Both views' and the combined probability, and the verdict; null texts are scored like any other."""
    docs = _table(spark, sf_dir, "documents")
    scored = co_training.classify(docs, co_training.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in ("by_text", "by_meta", "score", "kept")])


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op10] The language of every text by a model of the other two thirds; `und` without a letter."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def suffix_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op11] Bytes of repeated strings of 400 bytes, removed runs, and the hash of what stays; a null text is empty."""
    found = suffix_dedup.dedup_strings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "string_report.n_bytes", "string_report.n_removed", "string_report.n_spans", F.sha2("string_report.kept", 256).alias("kept_sha256"))


def source_divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op12] Distances between the sources of each language, and the terms that each uses more; nulls read as ''."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def token_alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[op13] Groups and links of two tokenizers' tokens; a text without tokens has zeros and an empty hash."""
    found, _ = alignment.align(_table(spark, sf_dir, "documents"))
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
    return found.select(F.col("id").alias("doc_id"), *columns)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": line_dedup_query,
    "op2_exact_topk": exact_topk_query,
    "op3_quality_rules": quality_rules_query,
    "op4_byte_bpe": byte_bpe_query,
    "op5_pii": pii_query,
    "op6_secret_scan": secret_scan_query,
    "op7_source_mix": source_mix_query,
    "op8_simhash": simhash_query,
    "op9_quality_classifier": quality_classifier_query,
    "op10_language_id": language_id_query,
    "op11_suffix_dedup": suffix_dedup_query,
    "op12_source_divergence": source_divergence_query,
    "op13_token_alignment": token_alignment_query,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(r.keeper <> k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT_TOPK_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS place, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.place <> c.place WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""

SOURCE_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source),
capped AS (
  SELECT *, 3 * source_size AS cap, CAST([5, 2, 1][1 + (rank - 1) % 3] AS BIGINT) AS weight FROM sources),
levels AS (
  SELECT *, row_number() OVER w AS cap_rank,
         (CAST(sum(source_size) OVER () AS BIGINT) - (CAST(sum(cap) OVER w AS BIGINT) - cap))
           / CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM capped WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
targets AS (
  SELECT source, rank, source_size,
         least(CAST(cap AS DOUBLE), weight * (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap_rank LIMIT 1)) AS target
  FROM levels),
queued AS (
  SELECT s.doc_id, s.hash, s.size, t.rank, t.source_size, t.target,
         CAST(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.hash, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS finish
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT doc_id, size, rank, hash, round, (finish + round * source_size) / target AS time
  FROM queued, (SELECT unnest([0, 1, 2]) AS round) WHERE size > 0 AND target > 0),
merged AS (
  SELECT doc_id, size, CAST(sum(size) OVER (ORDER BY time, rank, round, hash, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far
  FROM entries),
taken AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM merged
  WHERE so_far - size < (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""


def _pii_sql() -> str:
    """The contract's patterns as they are; where a span lies follows from the lengths between matches."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}",
        "pan": r"[0-9]([\x20-]?[0-9])+",
        "ssn": r"[0-9]+(-[0-9]+)+",
    }
    number = "regexp_replace(x.match, '[^0-9]', '', 'g')"
    worth = "CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END"
    luhn = f"list_sum([{worth} for c, i in string_split(reverse({number}), '')]) % 10 = 0"
    plain = "replace(x.match, ' ', '')"
    values = f"[CAST(CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS INTEGER) for c in string_split(substr({plain}, 5) || substr({plain}, 1, 4), '')]"
    around = "translate(substr(text, greatest(0, x.start - 40) + 1, x.start - greatest(0, x.start - 40)) || ' ' || substr(text, x.start + length(x.match) + 1, 40), "
    near = lambda words: f"regexp_matches({around}'{_UPPER}', '{_LOWER}'), '{words}')"
    rules = {
        "email": "true",
        "ip": "len([p for p in string_split(x.match, '.') if length(ltrim(p, '0')) > 3 OR lpad(ltrim(p, '0'), 3, '0') > '255']) = 0",
        "card": f"length({number}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({number}) BETWEEN 8 AND 15",
        "iban": f"length({plain}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, {values}), lambda a, v: CAST((a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97 AS INTEGER)) = 1",
        "pan": f"length({number}) BETWEEN 13 AND 15 AND {luhn} AND {near('card|visa|amex|credit|payment')}",
        "ssn": "regexp_matches(x.match, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') AND substr(x.match, 1, 3) NOT IN ('000', '666') AND substr(x.match, 1, 1) < '9'"
        f" AND substr(x.match, 5, 2) <> '00' AND substr(x.match, 8, 4) <> '0000' AND {near('ssn|social|security|tax')}",
    }
    cut = ", ".join(f"regexp_extract_all(text, '{p}') AS {k}_m, string_split_regex(text, '{p}') AS {k}_s" for k, p in patterns.items())
    placed = ", ".join(
        f"[{{'match': m, 'start': CAST(coalesce(list_sum([length(p) for p in {k}_s[1:i]]), 0) + coalesce(list_sum([length(p) for p in {k}_m[1:i - 1]]), 0) AS BIGINT)}} for m, i in {k}_m] AS {k}_x"
        for k in patterns
    )
    spans = ", ".join(f"['{k}:' || x.start || ':' || (x.start + length(x.match)) for x in {k}_x if {rules[k]}] AS {k}" for k in patterns)
    base = [k for k in patterns if k in ("email", "ip", "card", "phone")]
    # (Score in hundredths without context and with it, context words.)
    scored = {"email": (90, 100, "mail|contact|write"), "ip": (70, 100, "ip|host|server|address"), "card": (80, 100, "card|visa|credit|payment"), "phone": (80, 100, "phone|tel|call|mobile|fax"), "iban": (70, 100, "iban|bank|account|konto"), "pan": (70, 70, "card"), "ssn": (70, 70, "ssn")}
    scores = ", ".join(f"[CASE WHEN {near(w)} THEN '{high}' ELSE '{low}' END for x in {k}_x if {rules[k]}] AS {k}_score" for k, (low, high, w) in scored.items())
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, text, {cut} FROM texts),
placed AS (SELECT doc_id, text, {placed} FROM cut),
spans AS (SELECT doc_id, {spans}, {scores} FROM placed)
SELECT doc_id, {", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in base)},
       sha256(array_to_string({" || ".join(base)}, ',')) AS base_sha256, array_to_string({" || ".join(patterns)}, ',') AS spans,
       array_to_string({" || ".join(k + "_score" for k in patterns)}, ',') AS scores
FROM spans
"""


SOURCE_DIVERGENCE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text
  FROM documents),
terms AS (
  SELECT place, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT place) >= 30),
counted AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(k.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY lang, source) t USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT // (g.total + 5 * g.v) AS BIGINT) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT lang, term, 1 + CAST(1000000000 * (sum(n) + 5)::HUGEINT // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM shares GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
over AS (
  SELECT s.lang, s.source, s.term AS item, s.p - w.q AS value
  FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) FROM over)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


SQL: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op2_exact_topk": EXACT_TOPK_SQL,
    "op5_pii": _pii_sql(),
    "op7_source_mix": SOURCE_MIX_SQL,
    "op12_source_divergence": SOURCE_DIVERGENCE_SQL,
}
