"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.shared import materialize, new_folder, shared_folder, shuffle_width  # noqa: F401  for the operators

#: The six ASCII white-space characters, and the words between them.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of a batch that goes to Python at most.  A worker holds some ten times as much at its peak, and keeps most of it.
BATCH_BYTES = 2 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def long_texts(docs: DataFrame) -> DataFrame:
    """``docs``, once the session sends whole texts to Python in batches of bounded size.

    An Arrow batch of 64 MB of text takes several times as much in a Python worker.  The session's bound is
    lowered if it is higher, and stays so: it is read when a plan runs, after the operator has returned.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = conf.get(key).rstrip("b")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return docs


def unestimated(df: DataFrame) -> DataFrame:
    """A materialized ``df`` without the size that the optimizer estimated for it.

    A join's estimate is the product of its sides', which a checkpoint keeps: in a loop its digits double with
    every round, until planning takes longer than the work.
    """
    spark, rows = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)


#: Rows of a small table that one task reads, at least.
TASK_ROWS = 50_000


def few(df: DataFrame) -> DataFrame:
    """``materialize``, read again in as many tasks as its rows ask for.

    A loop over few rows in many partitions is all small files: three for each task of each shuffle.
    """
    done = materialize(df)
    return done.coalesce(done.count() // TASK_ROWS + 1)


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row, for joining decisions back: rows alike in id and text share it."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("text_hash"))


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added; input columns of those names (in any case) are replaced."""
    new = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])


def smallest(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """The rows of ``rows`` with the ``n`` least different values of ``order`` (a long).

    Only the numbers are sorted; the rows themselves, texts and all, are then filtered where they lie.
    """
    least = rows.select(order.alias("at")).where("at is not null").distinct().orderBy("at").limit(n)
    last = least.agg(F.max("at")).first()[0]
    return rows.where(order <= last) if last is not None else rows.limit(0)


def matched(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``lookup`` (one row for each ``key``) on ``key``, hot keys apart.

    Keys that hold over 1/(4 w) of the rows, w the shuffle partitions, are 4 w at most: their part of
    ``lookup`` is broadcast, so their rows stay where they are; the other rows are joined as usual.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    hot = counts.where(F.col("__n") > F.lit(max(1000, rows.count() // (4 * shuffle_width(rows.sparkSession))))).select(key)
    apart = materialize(lookup.join(F.broadcast(hot), key, "left_semi"))
    few = rows.join(F.broadcast(apart.select(key)), key, "left_anti").join(lookup, key)
    return few.unionByName(rows.join(F.broadcast(apart), key))


def one_text_each(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    """(id, q, text, others): one row for each id of ``chosen`` (id, q), however often its document is repeated.

    ``chosen`` is a bounded sample, so it is broadcast; of several texts the one with the smallest hash is taken.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), F.struct(text.alias("text"), *others).alias("doc")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "q").agg(F.min_by("doc", "h").alias("doc")).select("id", "q", "doc.*")
