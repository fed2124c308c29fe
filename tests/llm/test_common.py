import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import common


def test_ascii_lower_touches_only_ascii(spark):
    texts = ["ABC \u00dcn\u00ef \u00c9", "PLAIN", "\u017fK\u212a", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in rows.select(common.ascii_lower(F.col("t")).alias("v")).collect()]
    assert got == ["abc \u00dcn\u00ef \u00c9", "plain", "\u017fk\u212a", "", None]


def test_replaced_ignores_case(spark):
    rows = spark.createDataFrame([(1, 2)], "Score int, x int")
    assert common.replaced(rows, score=F.lit("new")).first().asDict() == {"x": 2, "score": "new"}


def test_smallest_keeps_ties_and_skips_nulls(spark):
    rows = spark.createDataFrame([(3,), (1,), (2,), (2,), (None,)], "n long")
    assert sorted(r.n for r in common.smallest(rows, F.col("n"), 2).collect()) == [1, 2, 2]
    assert common.smallest(rows.limit(0), F.col("n"), 2).count() == 0


def test_materialized_rows_do_not_change(spark):
    rows = common.materialize(spark.range(100).withColumn("r", F.rand()))
    assert rows.collect() == rows.collect()
    assert common.shared_folder(spark)


def test_row_keys_tell_texts_apart(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "a")], "i long, t string")
    assert rows.select(common.row_key(F.col("i"), F.col("t")).alias("k")).distinct().count() == 3


def test_matched_joins_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(1 if i < 3000 else i, i) for i in range(4000)], "k long, v long")
    lookup = spark.createDataFrame([(k, k * 10) for k in [1, *range(3000, 4000, 2)]], "k long, w long")
    want = rows.join(lookup, "k")
    got = common.matched(rows, lookup, "k")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_batches_of_long_texts_are_small(spark):
    """A Python worker holds many times a batch at its peak; 8 MB of text took two workers past 250 MB each."""
    from pyspark.sql.functions import pandas_udf

    docs = common.long_texts(spark.range(0, 120, 1, 1).select(F.repeat(F.lit("0123456789"), 10_000).alias("t")))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(map(len, batch.column("t").to_pylist()))]}, pa.schema([("n", pa.int64())]))

    @pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 3_000_000
    assert max(r.n for r in docs.select(together("t").alias("n")).collect()) <= 3_000_000
