import numpy as np
from pyspark.sql import functions as F

from quern.llm import bloom


def test_no_key_is_lost(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 3000).tolist()
    rows = spark.createDataFrame([(k,) for k in keys[:1500]] + [(None,)], "k long")
    held = bloom.filter_of(rows, "k", 1500)
    both = spark.createDataFrame([(k,) for k in keys], "k long")
    found = {r.k for r in both.where(bloom.maybe(F.col("k"), held)).collect()}
    assert found >= set(keys[:1500]) and len(found) < 1600


def test_keys_that_are_there_twice(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([3, 4],), ([5, 5],), ([],)], "p array<long>").repartition(3)

    def keys(batches):
        for batch in batches:
            yield np.array([k for row in batch.column("p").to_pylist() for k in row], np.int64)

    held = bloom.filter_of(rows, keys, 5, least=2, segments=5)
    assert bloom.held(np.arange(1, 7), held.value).tolist() == [False, False, True, False, True, False]
    assert not bloom.held(np.arange(9), bloom.filter_of(rows.limit(0), keys, 0).value).any()


def test_a_full_filter_lets_everything_through(spark, monkeypatch):
    monkeypatch.setattr(bloom, "LEAST_BITS", 512)
    monkeypatch.setattr(bloom, "MOST_BITS", 512)
    rows = spark.range(5000).withColumnRenamed("id", "k")
    held = bloom.held(np.arange(5000), bloom.filter_of(rows, "k", 5000).value)
    assert held.all()
