"""Streams with state, versions, constraints and budgets, on small cases."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.operators import asof, budget, graph
from quern.operators.constraints import Constraint, violations
from quern.plans import domain, live, tools
from quern.sources.shared import new_folder
from quern.streaming import ingest, keyed_state
from quern.streaming.graph_log import GraphLog


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


SHOWN = ("kind", "src_label", "src", "dst_label", "dst", "tag", "props")


def test_replayed_batches_and_steps_change_nothing(spark, sf_dir):
    events = domain.clinical_events(spark, sf_dir)
    log = GraphLog(spark, new_folder(spark, "log"), {"base": graph.CLINICAL_BASE, "reference": graph.CLINICAL_REFERENCE})
    for n in (2, 0, 1):
        log.apply(events.where(f"arrival_seq % 3 = {n}"), n)
    before = rows(domain.shown_graph(log.read()), *SHOWN)
    log.apply(events.where("arrival_seq % 3 = 1"), 1)
    log.apply(events.where("arrival_seq % 3 = 2"), 2, only="reference")
    log.apply(events.where("arrival_seq % 3 = 0"), 7)  # the same events under another batch
    assert rows(domain.shown_graph(log.read()), *SHOWN) == before
    compact = log.compacted(new_folder(spark, "compact"), 9)
    assert rows(domain.shown_graph(compact.read()), *SHOWN) == before
    whole = graph.writes(events, graph.CLINICAL_BASE).unionByName(graph.writes(events, graph.CLINICAL_REFERENCE, first=1000))
    assert rows(domain.shown_graph(graph.folded(whole)), *SHOWN) == before


def test_partials_keep_once_and_again_across_batches(spark):
    program = (graph.Node("N", "key", {"last": "v"}, {"known": "w"}, {"first": "v"}, {"later": "v"}),)
    made = [(1, "a", 10, 7), (2, "a", 20, None), (3, "a", None, None), (4, "b", 5, 1)]
    events = spark.createDataFrame(made, "arrival_seq long, key string, v int, w int")
    log = GraphLog(spark, new_folder(spark, "log"), {"only": program})
    for n, seq in enumerate((3, 1, 4, 2)):
        log.apply(events.where(f"arrival_seq = {seq}"), n)
    found = graph.nodes_of(log.read()).select("key", graph.shown().alias("props"), "born")
    whole = graph.nodes_of(graph.folded(graph.writes(events, program))).select("key", graph.shown().alias("props"), "born")
    assert rows(found, "key", "props", "born") == rows(whole, "key", "props", "born")
    assert rows(found, "key", "born") == [("a", 1), ("b", 4)]


def test_a_batch_adds_one_row_to_an_identity(spark, sf_dir):
    events = domain.clinical_events(spark, sf_dir)
    log = GraphLog(spark, new_folder(spark, "log"), {"base": graph.CLINICAL_BASE, "reference": graph.CLINICAL_REFERENCE})
    log.apply(events, 0)
    added = spark.read.parquet(log.path)
    assert added.count() == added.select(*graph.IDENTITY).distinct().count() == log.read().count()
    twice = (graph.Node("N", "event_id", {"n": "1"}, {"n": "2"}),)  # here rows for each property are needed
    log = GraphLog(spark, new_folder(spark, "log"), {"only": twice})
    log.apply(events, 0)
    assert rows(domain.shown_graph(log.read()), *SHOWN) == rows(domain.shown_graph(graph.folded(graph.writes(events, twice), twice)), *SHOWN)


def test_a_go_is_dealt_to_many_tasks(spark):
    found, root = [], new_folder(spark, "goes")
    sink = lambda batch, n: found.append((batch.select(F.spark_partition_id()).distinct().count(), batch.count()))
    ingest.fed(spark, spark.range(0, 400, 1, 1), "id", 2, lambda s: ingest.ingest(s, [sink], f"{root}/checkpoint"))
    assert len(found) == 2 and sum(n for _, n in found) == 400
    assert min(tasks for tasks, _ in found) > 1


def test_interval_join_bounds_its_state(spark):
    at = lambda minutes: 1_700_000_000 + 60 * minutes
    made = [(i, i % 3, "lab" if i % 2 else "next", float(at(10 * i))) for i in range(400)]
    events = spark.createDataFrame(made, "id long, owner long, kind string, at double")
    root = new_folder(spark, "join")
    of = lambda stream, kind: stream.where(F.col("kind") == kind).select("owner", F.col("id").alias(kind), F.timestamp_seconds("at").alias(f"{kind}_ts"))
    join = lambda s: ingest.interval_joined(of(s, "lab"), of(s, "next"), ["owner"], "lab_ts", "next_ts", "40 minutes", "5 minutes")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/found/batch={n}")
    progress = ingest.fed(spark, events, "at", 8, lambda s: ingest.ingest(join(s), [sink], f"{root}/checkpoint"))
    want = [(b[0], a[0]) for a in made for b in made if a[2] == "lab" and b[2] == "next" and a[1] == b[1] and 0 < b[3] - a[3] <= 2400]
    assert rows(spark.read.parquet(f"{root}/found"), "next", "lab") == sorted(want, key=str)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) < 120  # of 400 rows: a go's and the interval's, not all
    batch = ingest.interval_joined(of(events, "lab"), of(events, "next"), ["owner"], "lab_ts", "next_ts", "40 minutes")
    assert rows(batch, "next", "lab") == sorted(want, key=str)


def test_late_reference_rows_reach_later_events_only(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed_state.PROVIDER)
    made = [("k", 1, False, None), ("k", 2, True, "x"), ("k", 3, False, None), ("j", 4, False, None), ("k", 5, True, None), ("k", 6, False, None), ("j", 7, True, "y"), ("j", 8, False, None), (None, 9, False, None)]
    events = spark.createDataFrame(made, keyed_state.ROW)
    root = new_folder(spark, "state")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/found/batch={n}")
    ingest.fed(spark, events, "seq", 4, lambda s: ingest.ingest(keyed_state.enriched(s), [sink], f"{root}/checkpoint"))
    assert rows(spark.read.parquet(f"{root}/found"), "key", "seq", "known", "first_seq", "step") == [("j", 4, None, 4, 1), ("j", 8, "y", 4, 2), ("k", 1, None, 1, 1), ("k", 3, "x", 1, 2), ("k", 6, None, 1, 3)]


@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of_with_a_hot_key_ties_and_nulls(spark, inclusive):
    rng = random.Random(2)
    keys = ["hot"] * 6 + ["a", "b", None]
    facts = [(i, rng.choice(keys), None if i % 40 == 0 else rng.randrange(60)) for i in range(300)]
    versions = [(rng.choice(keys), rng.randrange(60), rng.choice([None, "x", "y", "z"])) for _ in range(40)]
    f = spark.createDataFrame(facts, "id long, k string, o long")
    v = spark.createDataFrame(versions, "k string, o long, what string")
    found = asof.as_of(f, v, "k", "o", inclusive=inclusive).select("id", "k", "o", F.col("version").isNotNull().alias("there"), "version.what")

    def best(k, o):
        before = [(p, w is not None, w or "") for key, p, w in versions if k is not None and o is not None and key == k and (p <= o if inclusive else p < o)]
        return (True, max(before)[2] or None) if before else (False, None)

    assert rows(found, "*") == sorted(((i, k, o, *best(k, o)) for i, k, o in facts), key=str)
    assert asof.as_of(f, v.limit(0), "k", "o").where("version is not null").count() == 0
    assert asof.as_of(f.limit(0), v, "k", "o").count() == 0


def test_constraints_on_nulls_repeats_and_missing_targets(spark):
    tables = {
        "t": spark.createDataFrame([(1, "a", 5), (1, None, 50), (None, "abcdef", -1), (2, "a", None)], "id int, name string, n int"),
        "u": spark.createDataFrame([(1,), (3,), (3,)], "ref int"),
    }
    rules = [
        Constraint("once", "t", "unique", ("id",)), Constraint("both", "t", "unique", ("id", "name")), Constraint("there", "t", "needed", ("name",)), Constraint("short", "t", "length", ("name",), 1, 3),
        Constraint("small", "t", "range", ("n",), 0, 40), Constraint("known", "t", "among", ("name",), among=("a",)), Constraint("positive", "t", "range", ("n",), 0, None, where="id = 1"), Constraint("to", "u", "foreign", ("ref",), target=("t", "id")),
    ]
    want = [("known", "abcdef", 1), ("once", "1", 2), ("short", "abcdef", 1), ("small", "-1", 1), ("small", "50", 1), ("there", None, 1), ("to", "3", 2)]
    assert rows(violations(tables, rules), "rule", "value", "rows") == sorted(want, key=str)
    assert violations({n: t.limit(0) for n, t in tables.items()}, rules).count() == 0


def test_budget_goes_as_the_loop_does(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice(["a", "é", "\n", '"', "語", " "]) for _ in range(n))
    made = [(i, [(word(rng.randrange(60)), j) for j in range(rng.randrange(6))], [(j, word(rng.randrange(60))) for j in range(rng.randrange(6))], word(rng.choice([0, 10, 79, 80, 81, 400]))) for i in range(200)]
    df = spark.createDataFrame(made, "id long, vector_context array<struct<text:string,turn:int>>, graph_context array<struct<id:int,what:string>>, answer string")
    limit = 320
    fixed = len(tools.canonical({"answer": "", "graph_context": [], "vector_context": []}).encode()) - 2 - 2 - 2
    out = budget.fitted(df, "vector_context", "graph_context", "answer", F.lit(fixed), limit)
    got = {r.id: (len(r.vector_context), len(r.graph_context), r.answer, r.response_bytes) if r.problem is None else None for r in out.collect()}
    plain = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for i, hits, facts, answer in made:
        left = {"vector_context": [{"text": t, "turn": n} for t, n in hits], "graph_context": [{"id": n, "what": w} for n, w in facts], "answer": answer}
        size = lambda: len(plain(left).encode())
        for part in ("vector_context", "graph_context"):
            while left[part] and size() > limit:
                left[part].pop()
        while left["answer"] and size() > limit:
            left["answer"] = left["answer"][:-80]
        assert got[i] == ((len(left["vector_context"]), len(left["graph_context"]), left["answer"], size()) if size() <= limit else None), i
    tight = budget.fitted(df, "vector_context", "graph_context", "answer", F.lit(fixed), 20)
    assert tight.where("problem is null").count() == 0


def test_a_hot_identity_is_a_row_of_each_batch(spark, sf_dir):
    log = live.streamed_graph(spark, sf_dir, 3)
    stored = spark.read.parquet(log.path)
    assert stored.select("batch").distinct().count() >= 3 and {r.step for r in stored.select("step").distinct().collect()} == {"base", "reference"}
    hot = stored.where("kind = '' and src_label = 'SourceSystem' and name = 'type'").groupBy("batch").count().collect()
    assert {r["count"] for r in hot} == {1}  # however many events name it


def test_folding_side_by_side_equals_folding_property_by_property(spark, sf_dir):
    made = [(1, "a", 10, 7, "x"), (2, "a", 20, None, "y"), (3, "a", None, None, None), (3, "a", 30, None, "z"), (4, "b", 5, 1, "x"), (5, None, 1, 1, "y")]
    events = spark.createDataFrame(made, "arrival_seq long, key string, v int, w int, other string")
    program = (graph.Edge("E", ("N", "key"), ("M", "other"), {"v": "v"}, {"w": "w"}), graph.Node("N", "key", {"last": "v"}, {"known": "w"}, {"first": "v"}, {"later": "v"}), graph.Node("N", "key", keep={"last": "w", "more": "other"}), graph.Node("M", "other"))
    columns = ("kind", "src", "dst", "born", "last_seq", "shown")
    for e, p in ((events, program), (domain.clinical_events(spark, sf_dir), graph.program_of(graph.CLINICAL_BASE, graph.CLINICAL))):
        written = graph.writes(e, p)
        one, other = (f.withColumn("shown", graph.shown()) for f in (graph.folded(written, p), graph.folded(written)))
        assert rows(one, *columns) == rows(other, *columns)
    again = (graph.Node("N", "key", {"v": "v"}, once={"v": "w"}),)  # one property twice: folded one by one
    assert rows(graph.folded(graph.writes(events, again), again), "src", "born") == [("a", (1, 0)), ("b", (4, 0))]


@pytest.mark.parametrize("name", ["graph_supply_base", "graph_purchases", "graph_shipments", "graph_quality", "graph_disruptions", "graph_inventory", "graph_supply_reference", "graph_base"])
def test_a_graph_is_read_and_shuffled_once(spark, sf_dir, name):
    plan = domain.__dict__[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == (3 if name == "graph_supply_reference" else 1)


def test_a_keys_rows_are_taken_as_they_are():
    class Value:
        now, reads = None, 0

        def get(self):
            self.reads += 1
            return self.now

        def update(self, value):
            self.now = value

    keyed = keyed_state.Keyed()
    keyed.reference, keyed.steps = Value(), Value()
    row = lambda seq, told, known=None: Row(key="k", seq=seq, is_reference=told, known=known)
    out = [tuple(r) for batch in ([row(3, False), row(2, True, "x"), row(1, False)], [row(5, False), row(4, True)]) for r in keyed.handleInputRows(("k",), iter(batch), None)]
    assert out == [("k", 1, None, 1, 1), ("k", 3, "x", 1, 2), ("k", 5, None, 1, 3)]
    assert (keyed.reference.now, keyed.steps.now, keyed.reference.reads) == ((None,), (1, 3), 2)


def test_node_constraints_read_each_table_once(spark, sf_dir):
    plan = live.node_constraints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_state_lies_in_as_many_partitions_as_its_rows_ask_for(spark, monkeypatch):
    """A join's partition commits the files of four stores in each batch, so 40 partitions of 200 rows are mostly files."""
    at = lambda minutes: 1_700_000_000 + 60 * minutes
    events = spark.createDataFrame([(i, i % 3, "lab" if i % 2 else "next", float(at(10 * i))) for i in range(200)], "id long, owner long, kind string, at double")
    root = new_folder(spark, "state-width")
    of = lambda stream, kind: stream.where(F.col("kind") == kind).select("owner", F.col("id").alias(kind), F.timestamp_seconds("at").alias(f"{kind}_ts"))
    join = lambda s: ingest.interval_joined(of(s, "lab"), of(s, "next"), ["owner"], "lab_ts", "next_ts", "40 minutes", "5 minutes")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/found/batch={n}")
    width, empty, provider = "spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(width), spark.conf.get(empty)
    spark.conf.set(width, "40")
    spark.conf.unset(provider)
    try:
        settings = ingest.state_settings(events, 2, joins=True)
        progress = ingest.fed(spark, events, "at", 2, lambda s: ingest.ingest(join(s), [sink], f"{root}/checkpoint", settings=settings))
        assert spark.conf.get(width) == "40" and spark.conf.get(empty) == before[1]
        monkeypatch.setattr(ingest, "STATE_ROWS", 10)
        assert ingest.state_settings(events, 2)[width] == "10"
        monkeypatch.setattr(ingest, "STATE_ROWS", 1)
        assert ingest.state_settings(events, 2)[width] == "40"
    finally:
        spark.conf.set(width, before[0])
    assert len(progress) == 2
    assert {p["stateOperators"][0]["numShufflePartitions"] for p in progress} == {spark.sparkContext.defaultParallelism}
    batch = ingest.interval_joined(of(events, "lab"), of(events, "next"), ["owner"], "lab_ts", "next_ts", "40 minutes")
    assert rows(spark.read.parquet(f"{root}/found"), "next", "lab") == rows(batch, "next", "lab")


def test_what_is_an_events_own_is_one_row_until_it_is_shuffled(spark):
    made = [("e1", 1, "p", "f", "x"), ("e2", 2, "p", None, None), ("e3", 3, None, "f", "y"), (None, 4, "q", "g", "z")]
    events = spark.createDataFrame(made, "event_id string, arrival_seq long, part string, place string, said string")
    ev = ("Event", "event_id")
    program = (
        graph.Node(*ev, {"said": "said", "dst": "arrival_seq"}, {"kept": "place"}, {"first": "part"}, {"later": "part"}),
        graph.Edge("ABOUT", ev, ("Part", "part"), {"at": "arrival_seq"}),
        graph.Edge("AT", ev, ("Place", "place"), when="said is not null", tag="said"),
        graph.Node("Part", "part", {"seen": "arrival_seq"}),
    )
    columns = ("kind", "src_label", "src", "dst_label", "dst", "tag", "matched", "born", "last_seq", "shown")
    shown = lambda df: rows(df.withColumn("shown", graph.shown()), *columns)
    packed = graph.folded_events(events, program)
    assert shown(packed) == shown(graph.folded(graph.writes(events, program), program)) and packed.count() == 10
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "'*'" in plan or "= *" in plan
    # A property that an item writes twice, and one with the name of a field.
    twice = (graph.Node(*ev, {"dst": "said"}, once={"dst": "part"}), *program[1:])
    assert shown(graph.folded_events(events, twice)) == shown(graph.folded(graph.writes(events, twice), twice))
    # A key that is there twice, with other ends: each identity is folded by itself.
    again = events.unionByName(spark.createDataFrame([("e1", 5, "q", "f", "w")], events.schema))
    assert shown(graph.folded_events(again, program)) == shown(graph.folded(graph.writes(again, program), program))
