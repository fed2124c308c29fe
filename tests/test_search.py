"""Search, sessions and traversal against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import search, traverse
from quern.plans import control, sessions


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_search_with_filters_of_each_question(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("red green blue one two three four five six".split()) for _ in range(n))
    points = [(i, text(rng.randrange(1, 9)), rng.choice(["a", "b", None])) for i in range(60)] + [(60, "", "a"), (61, None, "a")]
    questions = [(i, text(rng.randrange(1, 5)), rng.choice(["a", "b", "none", None]), rng.choice([None, [3, 5, 9, 11, 40], []]), rng.randrange(1, 6)) for i in range(25)] + [(25, "", None, None, 3)]
    p = spark.createDataFrame(points, "point long, text string, kind string")
    q = spark.createDataFrame(questions, "question long, text string, want string, some array<bigint>, top_k int")
    monkeypatch.setattr(search, "BLOCK_POINTS", 20)
    monkeypatch.setattr(search, "BLOCK_QUESTIONS", 10)
    found = search.top_k(search.sparse(q, "question", "text").join(q.drop("text"), "question"), search.sparse(p, "point", "text").join(p.drop("text"), "point"), 5, must=("want", "kind"), should="some")
    bag = lambda t: Counter((t or "").split())
    want = []
    for number, t, kind, some, k in questions:
        scored = []
        for point, other, has in points:
            a, b = bag(t), bag(other)
            dot = sum(a[w] * b[w] for w in a)
            if dot and (kind is None or has == kind) and (some is None or point in some):
                scored.append((-round(dot / (math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))), 6), point))
        want += [(number, point, i + 1) for i, (_, point) in enumerate(sorted(scored)[:k])]
    # No two of these words share a bucket of the embedding.
    assert rows(found, "question", "point", "rank") == sorted(want, key=str)
    assert search.top_k(search.sparse(q, "question", "text").join(q.drop("text"), "question"), search.sparse(p.limit(0), "point", "text").join(p.drop("text"), "point"), 5).count() == 0


def test_sessions_end_as_the_loop_does(spark):
    rng = random.Random(5)
    facts = {i: [i] for i in range(0, 30, 3)}
    made = [(i, rng.choice([None, rng.randrange(30)])) for i in range(40)]
    # What each round of a session finds: hits of earlier rounds may come again.
    owner = {None: 4} | {e: rng.choice([None, *range(30)]) for e in range(8)}
    finds = {(i, n): [(e, owner[e]) for e in rng.choices([None, *range(8)], k=rng.choice([0, 0, 1, 2]))] for i, _ in made for n in (1, 2, 3)}
    table = spark.createDataFrame([(i, n, e, o) for (i, n), hits in finds.items() for e, o in hits], "session long, n int, event_id long, owner long")
    known = spark.createDataFrame([(i,) for i in facts], "owner long")
    searched = lambda open_, n: table.where(F.col("n") == n).join(open_.select("session"), "session")
    ends, _, _ = sessions.run(spark.createDataFrame(made, "session long, scope long"), searched, lambda owners: owners.join(known, "owner", "left_semi"))
    want = []
    for i, scope in made:
        n = iter((1, 2, 3))
        # The loop on the driver looks its scope up by truth, so a scope of 0 is none there.
        if scope == 0:
            continue
        out = control.run_loop("question", scope, lambda _, i=i, n=n: [{"event_id": e, "owner": o} for e, o in finds[i, next(n)]], lambda owners: [{"owner": o} for o in owners if o in facts])
        want.append((i, len(out.trace), out.stop, len(out.hits), len(out.graph)))
    skip = [i for i, scope in made if scope == 0]
    assert rows(ends.where(~F.col("session").isin(skip) if skip else F.lit(True)), "session", "rounds", "stop", "hits", "facts") == sorted(want, key=str)
    assert {w[2] for w in want} == {"confidence_reached", "no_progress_limit", "max_iterations_reached"}


@pytest.mark.parametrize("back", [False, True])
def test_traversal_with_hubs_cycles_and_typed_hops(spark, back):
    rng = random.Random(9)
    edges = [("hub", rng.choice("xy"), f"n{i}") for i in range(20)] + [(f"n{rng.randrange(25)}", rng.choice("xyz"), rng.choice(["hub", f"n{rng.randrange(25)}"])) for _ in range(60)] + [("n1", "x", "n1"), (None, "x", "n2"), ("n3", "x", None)]
    starts = ["n1", "n5", "hub", "nowhere", None, "n1"]
    df = spark.createDataFrame(edges, "src string, kind string, dst string")
    s = spark.createDataFrame([(x,) for x in starts], "start string")
    for kinds in (None, [["x", "<x"], ["y", "z", "<y"], ["x"]]):
        links = {}
        for a, k, b in edges:
            if a and b:
                links.setdefault(a, set()).add((k, b))
                if back:
                    links.setdefault(b, set()).add((f"<{k}", a))
        want = []
        for start in {x for x in starts if x}:
            seen, frontier = {start}, {start: ()}
            for hop in range(1, 4):
                new = {}
                for node, path in frontier.items():
                    for k, b in links.get(node, ()):
                        if b not in seen and (kinds is None or k in kinds[hop - 1]):
                            new[b] = min(new.get(b, (*path, (k, b))), (*path, (k, b)))
                want += [(start, node, hop, str(path)) for node, path in new.items()]
                seen |= set(new)
                frontier = new
        found = traverse.reached(df, s, 3, kinds, back, most=4)
        assert sorted((r.start, r.node, r.hops, str(tuple((p.kind, p.node) for p in r.path))) for r in found.collect()) == sorted(want)


def test_questions_that_ask_the_same_meet_points_once(spark, monkeypatch):
    p = spark.createDataFrame([(i, [i % 7, 100], [1, 1 + i % 3], "ab"[i % 2]) for i in range(90)], "point long, buckets array<int>, counts array<long>, kind string")
    q = spark.createDataFrame([(i, [i % 3], [1], None if i % 2 else "a", 1 + i % 5) for i in range(60)], "question long, buckets array<int>, counts array<long>, want string, top_k int")
    monkeypatch.setattr(search, "TILE_POINTS", 20)
    monkeypatch.setattr(search, "TILE_QUESTIONS", 4)
    found = search.top_k(q, p, 5, must=("want", "kind"))
    want = []
    for i in range(60):
        near = sorted((-round(1 / math.sqrt(1 + (1 + n % 3) ** 2), 6), n) for n in range(90) if n % 7 == i % 3 and (i % 2 or n % 2 == 0))
        want += [(i, n, -s, k + 1) for k, (s, n) in enumerate(near[: 1 + i % 5])]
    assert rows(found, "question", "point", "score", "rank") == sorted(want, key=str)


def test_a_hub_of_one_kind_is_whole_for_others(spark):
    edges = [("hub", "x", f"n{i}") for i in range(20)] + [("hub", "y", "m"), ("a", "x", "hub")]
    _, hubs = traverse.split_hubs(spark.createDataFrame(edges, "src string, kind string, dst string"), 4)
    assert rows(hubs, "src", "kind", "parts") == [("hub", "x", 5)]


def test_blocks_are_not_copied_for_each_other(spark, monkeypatch):
    """Points that meet many blocks of questions are shuffled once, and come out as from one block."""
    p = spark.createDataFrame([(i, [i % 7, 100 + i % 50], [1, 1 + i % 3], "abc"[i % 3]) for i in range(300)], "point long, buckets array<int>, counts array<long>, kind string")
    q = spark.createDataFrame([(i, [i % 7, 100 + i % 40], [1, 2], None if i % 2 else "ab"[i % 4 // 2], 3) for i in range(200)], "question long, buckets array<int>, counts array<long>, want string, top_k int")
    shown = lambda: rows(search.top_k(q, p, 5, must=("want", "kind")), "question", "point", "score", "rank")
    whole = shown()
    monkeypatch.setattr(search, "BLOCK_POINTS", 20)
    monkeypatch.setattr(search, "BLOCK_QUESTIONS", 10)
    found = search.top_k(q, p, 5, must=("want", "kind"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "sequence(" not in plan
    assert rows(found, "question", "point", "score", "rank") == whole and len(whole) == 600


def test_repeated_keys_are_one_vector_with_each_of_their_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "b c", "y"), (2, "a a", "x"), (None, "a", "x"), (3, "", "x"), (4, None, "x")], "id long, text string, source string")
    got = search.sparse(docs, "id", "text", keep=("source",)).collect()
    assert sorted((r.id, r.source, sorted(r.counts)) for r in got) == [(1, "x", [1, 1, 2]), (1, "y", [1, 1, 2]), (2, "x", [2])]
