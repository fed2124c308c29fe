"""The stages of the corpus pipeline: quality classifier, line dedup, near-dedup, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns
a DataFrame; all but the last return the columns of documents.  A result is written as Parquet and read
again as the next stage's ``docs``.

Rows may be null in any column, and further columns of any name pass through: an operator sees the
documents as one column ``row`` beside what it works on.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bloom, byte_bpe, co_training, line_dedup, mixing, near_copies
from quern.llm.common import long_texts, matched, materialize, new_folder, row_key


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` as one column ``row`` beside the ``columns`` an operator works on: no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = co_training.classify(whole(docs, "text", "lang", "source", "n_chars"), co_training.fit(docs, labels))
    return scored.where("quality.kept").select("row.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the long lines that many documents share; n_chars follows.  Null texts stay null."""
    # Numbered columns cannot clash, and the text is there once.
    number = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = line_dedup.dedup_lines(docs.toDF(*number.values()), number["doc_id"], number["text"])
    text = F.when(F.col(number["text"]).isNotNull(), F.col("line_report.kept"))
    n_chars = F.when(F.col("line_report.n_dropped") > 0, F.char_length(text).cast("long")).otherwise(F.col(number["n_chars"]))
    changed = {"text": text, "n_chars": n_chars}
    return found.select(*[changed.get(c, F.col(n)).alias(n) for c, n in number.items()]).toDF(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard 0.8 or more) the document with the smallest id stays.

    Groups are told apart by their label, so documents of one id in different groups all stay.  Of texts
    under one id in a group one stays (the smallest hash); repeated rows are kept once.  Rows without an
    id are never dropped.
    """
    rows = materialize(near_copies.near_copies(docs).where("id is not null").groupBy("label", "id", "text_hash").agg(F.count("*").alias("n")))
    first = rows.groupBy("label").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    judged = matched(rows, first, "label").select(F.struct("id", "text_hash").alias("key"), "n", ((F.col("first.id") == F.col("id")) & (F.col("first.text_hash") == F.col("text_hash"))).alias("stays"))
    # Rows that go or are there again; all others stay without a join.
    named = materialize(judged.where("n > 1 or not stays").withColumn("hash", F.xxhash64("key")))
    touched = bloom.filter_of(named, "hash", named.count())
    keyed = whole(docs).where("row.doc_id is not null").withColumn("key", row_key(F.col("row.doc_id"), F.col("row.text")))
    keyed = keyed.withColumn("touched", bloom.maybe(F.xxhash64("key"), touched))
    found = keyed.where("touched").join(named, "key", "left").where("stays is null or stays")
    # Only rows that are there again are compared whole.
    again = found.where("n > 1").dropDuplicates(["key"])
    stay = (keyed.where("not touched"), found.where("n is null"), again)
    kept = [rows.select("row.*") for rows in stay] + [docs.where("doc_id is null")]
    return reduce(DataFrame.unionByName, kept)


#: Copies of a row that one task writes.
MANY_COPIES = 1_000


def _place(doc_id: Column, source: Column, text_hash: Column) -> Column:
    """A row's key in the mix; nulls are values."""
    return F.struct(doc_id.isNull().alias("a"), F.coalesce(doc_id, F.lit(0)).alias("id"), source.isNull().alias("b"), F.coalesce(source, F.lit("")).alias("source"), text_hash.alias("text_hash"))


def _copied(rows: DataFrame) -> DataFrame:
    """(row) as often as ``copies``; those with very many are dealt out before they are multiplied."""
    upto = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    few = rows.where(F.col("copies") <= MANY_COPIES).select("row", upto(F.col("copies")))
    last = F.ceil(F.col("copies") / MANY_COPIES) - 1
    parts = rows.where(F.col("copies") > MANY_COPIES).select("row", "copies", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    many = parts.repartition("part").select("row", upto(F.least(F.lit(MANY_COPIES).cast("long"), F.col("copies") - F.col("part") * MANY_COPIES)))
    return few.unionByName(many).select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times; repeated rows together as often as all of them."""
    mixed = mixing.mix(docs).groupBy("id", "source", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("repeats")).where("copies > 0")
    mixed = materialize(mixed.select(_place(F.col("id"), F.col("source"), F.col("text_hash")).alias("key"), "copies", "repeats"))
    keyed = whole(docs)
    row = keyed["row"]
    found = matched(keyed.withColumn("key", _place(row["doc_id"], row["source"], F.xxhash64(row["text"]))), mixed, "key")
    again = found.where("repeats > 1").dropDuplicates(["key"])
    return _copied(found.where("repeats = 1").unionByName(again))


def byte_bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (packed little-endian 32-bit), their number, and whether they decode to its text."""
    both = long_texts(docs).select("doc_id", "lang", "source", "text", byte_bpe.encode_decode(F.col("text")).alias("bpe"))
    exact = F.col("bpe.decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", F.col("bpe.ids").alias("ids"), F.expr("octet_length(bpe.ids) div 4").cast("long").alias("n_tokens"), exact.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe_encoding),
]

#: SQL cannot train the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
