"""Exact inner-product search with norm buckets.

Vectors are grouped into buckets of like length.  A query's threshold (a score that twenty vectors
are known to reach) becomes, in each bucket, a local cosine threshold; buckets that cannot reach it
are left out before any shuffle.  Inside a bucket, a high local threshold prunes by coordinates (the
range each focus coordinate must lie in), a low one by length; what is left is verified by products.

Queries and candidates meet in blocks of bounded size, so neither side is held whole anywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize

#: Ratio of the longest to the shortest vector of a bucket.
BUCKET_RATIO = 1.05
#: Vectors and queries that one task compares at a time.
BLOCK_VECTORS = 512
BLOCK_QUERIES = 512
#: One vector in so many is probed first, for the queries' thresholds.
PROBE_SHARE = 8
#: From this local cosine threshold on, coordinates prune; below, lengths do.
COORDINATE_COSINE = 0.7
FOCUS_COORDINATES = 4


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which products ignore."""
    rows = [np.asarray(x, dtype=np.float64) for x in column.to_pylist()]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of integral vectors, exactly; beyond a long's range the nearest long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def search_block(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of ``vectors`` for each of ``queries``, those under a query's threshold left out."""
    q, v = _matrix(queries.column("vector")), _matrix(vectors.column("vector"))
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
    q_id, v_id = queries.column("vec_id").to_numpy(), vectors.column("vec_id").to_numpy()
    # A query's own row is no candidate; further rows like it are.
    own = {(i, h): n for n, (i, h) in enumerate(zip(v_id.tolist(), vectors.column("q").to_pylist()))}
    own_at = np.array([own.get(k, -1) for k in zip(q_id.tolist(), queries.column("q").to_pylist())], np.int64)
    repeats = vectors.column("repeats").to_numpy()
    q_len, v_len = queries.column("length").to_numpy(), vectors.column("length").to_numpy()
    floor = queries.column("floor").to_pandas().to_numpy(dtype=np.float64)  # nan: no threshold yet
    long_first = np.argsort(-v_len, kind="stable")
    v, v_id, v_len, repeats = v[long_first], v_id[long_first], v_len[long_first], repeats[long_first]
    place = np.append(np.argsort(long_first), -1)
    own_at = place[own_at]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = floor / (q_len * v_len.max(initial=0))
        q_unit, v_unit = np.nan_to_num(q / q_len[:, None]), np.nan_to_num(v / v_len[:, None])
        reach = np.where(floor > 0, floor / q_len, 0)
    # Rounding must not lose a tie: every bound is loosened a little.
    slack = 1e-9
    rows: list[tuple[np.ndarray, ...]] = []
    by_length = np.flatnonzero(~(local >= COORDINATE_COSINE))
    enough = np.searchsorted(-v_len, -reach[by_length] * (1 - slack), side="right")
    scores = _exact(q[by_length], v[: enough.max(initial=0)]) if len(by_length) else None
    for n, (i, m) in enumerate(zip(by_length.tolist(), enough.tolist())):
        rows.append(_best(i, np.arange(m), scores[n, :m], own_at, repeats, v_id, floor, k))
    for i in np.flatnonzero(local >= COORDINATE_COSINE).tolist():
        cosine = min(local[i] * (1 - slack), 1.0)
        focus = np.argsort(-np.abs(q_unit[i]), kind="stable")[:FOCUS_COORDINATES]
        centre, swing = q_unit[i, focus] * cosine, np.sqrt((1 - cosine**2) * np.maximum(0, 1 - q_unit[i, focus] ** 2)) + slack
        at_focus, to_the_end = v_unit[:, focus], np.abs(q_unit[i, focus]) >= cosine
        inside = (np.abs(at_focus - centre) <= swing) | (to_the_end & (at_focus * np.sign(centre) > np.abs(centre)))
        left = np.flatnonzero(inside.all(axis=1))
        rows.append(_best(i, left, _exact(q[i : i + 1], v[left])[0], own_at, repeats, v_id, floor, k))
    parts = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3
    times = np.minimum(repeats[parts[1]] - (parts[1] == own_at[parts[0]]), k) if len(parts[0]) else parts[0]
    return pa.table({"q": queries.column("q").to_numpy()[parts[0]], "query_id": q_id[parts[0]], "vec_id": v_id[parts[1]], "score": parts[2], "times": times})


def _best(i: int, at: np.ndarray, scores: np.ndarray, own_at: np.ndarray, repeats: np.ndarray, v_id: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    keep = (at != own_at[i]) | (repeats[at] > 1)
    if not np.isnan(floor[i]):
        keep &= scores >= floor[i]
    at, scores = at[keep], scores[keep]
    if len(at) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= kth
        at, scores = at[near], scores[near]
    order = np.lexsort((v_id[at], -scores))[:k]
    return np.full(len(order), i), at[order], scores[order]


def prepare(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, vector, repeats, length, q): usable rows with floor(scale * x) components.

    Rows alike in id and vector are one, there ``repeats`` times; ``q`` and the id name it.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take no part.
    """
    parts = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("parts"))
    finite = F.forall("parts", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = parts.where(F.col("vec_id").isNotNull() & F.col("parts").isNotNull() & finite)
    whole = whole.select("vec_id", F.transform("parts", lambda x: F.floor(x * scale).cast("double")).alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    once = whole.groupBy("vec_id", "vector").agg(F.count("*").alias("repeats"))
    return once.select("vec_id", "vector", "repeats", length.alias("length"), F.xxhash64("vec_id", F.col("vector").cast("string")).alias("q"))


def top_k(vectors: DataFrame, query_every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best inner products of every query.

    Queries are the rows whose id is divisible by ``query_every``; a query meets all rows but itself, so
    further rows of its id, and repeats of it, are candidates.  A repeated query is answered each time.
    Ties go to the smaller id; with fewer than ``k`` candidates there are fewer rows.  Vectors of other
    dimension are compared over the common components.  Scores beyond a long's range become the nearest long.
    """
    spark = vectors.sparkSession
    bucket = F.when(F.col("length") > 0, F.floor(F.log(F.col("length")) / F.lit(float(np.log(BUCKET_RATIO))))).otherwise(-(1 << 30)).cast("int")
    rows = materialize(prepare(vectors, id_col, vector_col, scale).withColumn("bucket", bucket))
    # One row for each ratio of lengths: some hundreds, bounded by the range of a double.
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    sizes = [(r.bucket, -(-r.n // BLOCK_VECTORS), r.longest) for r in sizes.collect()]
    buckets = F.broadcast(spark.createDataFrame(sizes, "bucket int, blocks int, longest double"))
    is_query = F.pmod(F.col("vec_id"), F.lit(query_every)) == 0
    query_blocks = max(1, -(-rows.where(is_query).count() // BLOCK_QUERIES))
    queries = rows.where(is_query).select("q", "vec_id", "vector", "length", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int").alias("query_block"))
    probe = F.pmod(F.xxhash64("q", F.lit("probe")), F.lit(PROBE_SHARE)) == 0

    def search(candidates: DataFrame, asking: DataFrame, share: int) -> DataFrame:
        """Queries and candidates meet where a query of a block can reach the bucket, and nowhere else."""
        blocks = F.ceil(F.col("blocks") / share).cast("int")
        block = F.pmod(F.xxhash64("q", F.lit("block")), blocks).cast("int")
        reachable = F.col("floor").isNull() | (F.col("length") * F.col("longest") * (1 + 1e-9) >= F.col("floor"))
        asked = asking.join(buckets, reachable).select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "query_block", "q", "vec_id", "vector", "length", "floor")
        places = asking.join(buckets, reachable).select("bucket", "blocks", "query_block").distinct()
        places = places.select(F.col("bucket").alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("n"), F.col("query_block").alias("qb"))
        placed = candidates.join(buckets, "bucket").select(F.col("bucket").alias("b"), block.alias("n"), "vec_id", "q", "repeats", "vector", "length")
        held = placed.join(places, ["b", "n"]).select("b", "n", "qb", *[F.col(c).alias(c) for c in ("vec_id", "q", "repeats", "vector", "length")])

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            return search_block(left, right, k)

        met = asked.groupBy("bucket", "block", "query_block").cogroup(held.groupBy("b", "n", "qb"))
        return met.applyInArrow(compare, "q long, query_id long, vec_id long, score long, times long")

    ranked = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        each = found.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("time", "times")
        return each.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    probed = materialize(best(search(rows.where(probe), queries.withColumn("floor", F.lit(None).cast("long")), PROBE_SHARE)))
    floors = probed.where(F.col("rank") == k).select("q", F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = search(rows.where(~probe), queries.join(floors, ["q", "vec_id"], "left"), 1)
    found = best(probed.drop("rank").withColumn("times", F.lit(1).cast("long")).unionByName(rest))
    again = rows.where(is_query & (F.col("repeats") > 1)).select("q", F.col("vec_id").alias("query_id"), "repeats")
    found = found.join(again, ["q", "query_id"], "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.coalesce("repeats", F.lit(1)).cast("int"))))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
