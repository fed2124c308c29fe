"""Line deduplication across documents [native].

Long lines become 128-bit hashes; the hashes are range-partitioned and sorted by document and
position, first occurrences stream past, and the result is one compressed bitmap of kept lines for
every document that loses any.  Text crosses no shuffle until a bitmap is applied.

Hot lines: a hash is dealt out with a salt taken from its document, as many salts as the session has
shuffle partitions, so a line in a third of all documents is spread over every range.  Each salted
run is streamed alone; only its summary (documents seen, first document) meets the other salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import SPACES, ascii_lower, materialize, row_key, shuffle_width

#: Lines whose flags share a word of the bitmap.
WORD_BITS = 63


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(hash, doc, row, pos) of every line whose key is long enough."""
    text = F.col(f"`{text_col}`")
    # The row's hash is taken before the lines are: else every line would hash its whole text.
    slim = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text")).where("doc is not null and text is not null")
    stripped = F.btrim(F.col("line"), F.lit(SPACES))
    return (
        slim.select("doc", "row", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .where((F.char_length("line") >= min_chars) & (F.char_length(stripped) >= min_chars))
        .select(F.unhex(F.md5(ascii_lower(stripped))).alias("hash"), "doc", "row", "pos")
    )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(key struct<id,text_hash>, words map<int,bigint>): lines to keep, for documents that lose any.

    A line of at least ``min_chars`` code points (stripped, A-Z lower-cased) held by at least
    ``min_docs`` documents stays only in the largest ``id_col``.  Bit ``pos % 63`` of word ``pos div 63``
    is 1 if line ``pos`` stays; words and documents that keep all their lines are left out.  Rows with a
    null id take no part and keep all lines; rows repeating an id count as one document; null texts have
    no line.
    """
    salts = shuffle_width(docs.sparkSession)
    lines = _long_lines(docs, id_col, text_col, min_chars).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    lines = materialize(lines)  # read by the range sort's sampling, by the sort, and by the join
    ranged = lines.repartitionByRange(salts, "hash", "salt")
    run = Window.partitionBy("hash", "salt").orderBy(F.desc("doc"), "row", "pos")
    before = F.lag("doc").over(run)
    heads = (
        ranged.withColumn("first_here", (before.isNull() | (before != F.col("doc"))).cast("int"))
        .groupBy("hash", "salt")
        .agg(F.sum("first_here").alias("seen"), F.max("doc").alias("first_doc"))
    )
    repeated = (
        heads.groupBy("hash")
        .agg(F.sum("seen").alias("seen"), F.max("first_doc").alias("keeper"), F.collect_list("salt").alias("salts"))
        .where(F.col("seen") >= min_docs)
        .select("hash", F.explode("salts").alias("salt"), "keeper")
    )
    dropped = lines.join(repeated, ["hash", "salt"]).where("doc <> keeper").select("doc", "row", "pos")
    return (
        dropped.repartition("doc", "row")
        .groupBy("doc", "row", F.expr(f"pos div {WORD_BITS}").cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD_BITS})")).alias("gone"))
        .select("doc", "row", "word", F.lit((1 << WORD_BITS) - 1).bitwiseXOR(F.col("gone")).alias("bits"))
        .groupBy("doc", "row")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
        .select(F.struct(F.col("doc").alias("id"), F.col("row").alias("text_hash")).alias("key"), "words")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``line_report`` struct<n_lines,n_dropped,kept>: ``kept`` joins the lines that stay by newlines.

    A null or empty text has one empty line and keeps it; a text that loses every line is empty.  Columns
    of ``docs`` may have any names; one named ``line_report`` is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != "line_report"]
    key = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), key.alias("key"))
    words = bitmaps.select(F.col("key").alias("marked"), "words")
    joined = rows.join(words, (F.col("key.id") == F.col("marked.id")) & (F.col("key.text_hash") == F.col("marked.text_hash")), "left")
    lines = lines_of(F.col(f"row.`{text_col}`"))
    word = lambda i: F.coalesce(F.try_element_at(F.col("words"), F.floor(i / WORD_BITS).cast("int")), F.lit((1 << WORD_BITS) - 1))
    bit = lambda i: F.call_function("shiftright", word(i), i % WORD_BITS).bitwiseAND(F.lit(1))
    kept = F.when(F.col("words").isNull(), lines).otherwise(F.filter(lines, lambda _, i: bit(i) == 1))
    n = F.size(lines).cast("long")
    report = F.struct(n.alias("n_lines"), (n - F.size(kept)).alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))
    return joined.select("row", report.alias("line_report")).select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "line_report")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``line_report``; an input column of that name is replaced.

    Texts and bitmaps meet by a shuffle at every size: bitmaps grow with the input, so they are not broadcast.
    """
    return apply_bitmaps(docs, materialize(keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)), id_col, text_col)
