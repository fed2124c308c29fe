import math

import numpy as np
import pytest

from quern.llm import topk


def brute(rows, every, k, scale=64):
    usable = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(usable):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(usable) if n != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def found(spark, rows, every, k):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as bucket")
    return sorted(map(tuple, topk.top_k(vectors, query_every=every, k=k).collect()))


@pytest.mark.parametrize("spread", [0.02, 0.6, 3.0])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(scale=spread, size=12)).tolist()) for i in range(700)]
    assert found(spark, rows, 20, 7) == brute(rows, 20, 7)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0])]
    rows += [(7, []), (8, [0.5]), (9, [1.0, 0.0, 9.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (40, [-1.0, -1.0]), (11, [-0.001, 0.001])]
    assert found(spark, rows, 20, 20) == brute(rows, 20, 20)


def test_ties_and_many_copies(spark):
    rows = [(i, [0.5, 0.5]) for i in range(600)] + [(i, [0.1 * (i % 5), 0.2]) for i in range(600, 700)]
    assert found(spark, rows, 100, 5) == brute(rows, 100, 5)


def test_repeated_rows_and_ids_are_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 90, rng.normal(size=6).tolist()) for i in range(300)]
    rows += rows[:40] + [(0, [2.0] * 6)] * 30 + [(7, [1.0] * 6)] * 25
    assert found(spark, rows, 10, 6) == brute(rows, 10, 6)


def test_query_and_its_sql_agree(spark, sf_dir):
    import duckdb

    from quern.llm import queries

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = queries.QUERIES["op2_exact_topk"](spark, sf_dir)
    want = con.sql(queries.SQL["op2_exact_topk"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_beyond_exact_doubles(spark):
    rows = [(0, [3e7, 3.0]), (1, [3e7, 1.0]), (2, [3e7, 2.0]), (3, [-3e7, 0.0])]
    assert found(spark, rows, 20, 5) == brute(rows, 20, 5)


def test_beyond_a_long_scores_tie(spark):
    got = found(spark, [(0, [1e9]), (2, [2e9]), (1, [1e9])], 20, 5)
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)]


def test_empty(spark):
    assert found(spark, [], 20, 5) == []
    assert found(spark, [(0, [1.0])], 20, 5) == []
