"""Source divergence audit: how far each source's use of terms lies from the other sources of its language.

Documents are tallied where they lie.  A first pass finds the terms that enough documents of a language hold;
a second one counts only those, by language and source.  For two sources the distinct (count, count)
combinations over all kept terms are tallied, cells of terms that one or both lack included, and the
distance is evaluated once for each combination, times its multiplicity.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import bloom
from quern.llm.common import long_texts, materialize, shuffle_width

#: Documents that a term needs, what is added to a count, the scale of a share, terms reported.
MIN_DOCS, ADDED, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Terms that a task tallies before it hands them on.
HELD_TERMS = 1_000_000
#: Sources whose counts are held against each other in a task, and terms of a task, about.
BLOCK_SOURCES, BUCKET_TERMS = 32, 8_000

#: Bytes of a text to those of its terms: a space between them, A-Z lower-cased, all beyond ASCII as it is.
_BYTES = bytes(b if b >= 0x80 else b | 0x20 if chr(b).isalpha() else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, all in UTF-8."""
    return text.translate(_BYTES).split(b" ")


def _hashes(lang: str, terms: list[bytes]) -> np.ndarray:
    """64-bit hashes of a language's terms."""
    prefix = lang.encode() + b"\0"
    return np.array([xxhash.xxh64_intdigest(prefix + t) for t in terms], np.uint64).view(np.int64)


def _rows(key: dict[str, str], tally: Counter, of: str, kept: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The terms of ``tally`` and their numbers, beside the columns of ``key``."""
    terms, numbers = pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())
    there = pc.greater(pc.binary_length(terms), 0)  # between two separators lies nothing
    there = there if kept is None else pc.and_(there, pa.array(kept))
    terms, numbers = terms.filter(there).cast(pa.string()), numbers.filter(there)
    for start in range(0, len(terms), 100_000):
        part = terms.slice(start, 100_000)
        yield pa.RecordBatch.from_arrays([*[pa.repeat(pa.scalar(v), len(part)) for v in key.values()], part, numbers.slice(start, 100_000)], names=[*key, "term", of])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms that ``min_docs`` rows of a language or more hold; ``docs`` has lang, source, text, no nulls."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch)):
                held.setdefault(lang, Counter()).update(set(terms_of(text)))
            if sum(map(len, held.values())) > HELD_TERMS:
                for lang in list(held):
                    yield from _rows({"lang": lang}, held.pop(lang), "docs")
        for lang, tally in held.items():
            yield from _rows({"lang": lang}, tally, "docs")

    found = docs.select("lang", "text").mapInArrow(tallied, "lang string, term string, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")


def term_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of the terms in ``kept`` by group; absent ones have no row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, term in zip(batch.column("lang").to_pylist(), batch.column("term").cast(pa.binary()).to_pylist()):
                by_lang.setdefault(lang, []).append(term)
            yield np.concatenate([np.zeros(0, np.int64), *[_hashes(lang, terms) for lang, terms in by_lang.items()]])

    # Terms that are certainly not kept are left out before they are counted.
    wanted = bloom.filter_of(kept, keys, kept.count())

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Counter] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, source in list(held):
                tally = held.pop((lang, source))
                yield from _rows({"lang": lang, "source": source}, tally, "n", bloom.held(_hashes(lang, list(tally)), wanted.value))

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _texts(batch)):
                held.setdefault((lang, source), Counter()).update(terms_of(text))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from handed_on()
        yield from handed_on()

    found = docs.select("lang", "source", "text").mapInArrow(tallied, "lang string, source string, term string, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exact; null if there is no term."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = F.nullif(wide(total) + wide(ADDED * terms), F.lit(0).cast("decimal(21,0)"))
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + ADDED), below)


def _joint_counts(counts: DataFrame, groups: DataFrame, terms: int) -> DataFrame:
    """(lang, source, other, x, y, m): how many kept terms have x occurrences in one source and y in the other.

    Each pair of sources is there once, source before other in code points.  Terms that both lack are implied.
    """
    spark = counts.sparkSession
    buckets = max(shuffle_width(spark), terms // BUCKET_TERMS + 1)
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = widest // BLOCK_SOURCES + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    # A source without any of a bucket's terms has a row without a term there, so that its zeros are counted.
    rows = counts.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
    rows = rows.unionByName(groups.select("lang", "source", every), allowMissingColumns=True)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("with")

    def tally(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        source, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
        block = dict(zip(table.column("source").to_pylist(), table.column("block").to_pylist()))
        matrix = np.zeros((len(source.dictionary), len(term.dictionary)), np.int64)
        there = np.flatnonzero(table.column("term").is_valid().to_numpy())
        matrix[source.indices.to_numpy()[there], term.indices.take(pa.array(there)).to_numpy()] = table.column("n").take(pa.array(there)).to_numpy()
        names = source.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        ranked = [np.unique(row, return_inverse=True) for row in matrix]
        kinds = {"lang": pa.string(), "source": pa.string(), "other": pa.string(), "x": pa.int64(), "y": pa.int64(), "m": pa.int64()}
        out = [[] for _ in kinds]
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                if {block[names[a]], block[names[b]]} == {low, high}:
                    (xs, x), (ys, y) = ranked[a], ranked[b]
                    cells, m = np.unique(x * len(ys) + y, return_counts=True)
                    for column, values in zip(out, ([lang] * len(m), [names[a]] * len(m), [names[b]] * len(m), xs[cells // max(1, len(ys))], ys[cells % max(1, len(ys))], m)):
                        column.append(values)
        return pa.table({k: pa.chunked_array([pa.array(v, kind) for v in column], kind) for (k, kind), column in zip(kinds.items(), out)})

    found = rows.groupBy("lang", "bucket", "low", "high").applyInArrow(tally, "lang string, source string, other string, x long, y long, m long")
    return found.groupBy("lang", "source", "other", "x", "y").agg(F.sum("m").alias("m"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs; nulls read as ''.

    Part ``pair``: each other source of the language with the summed distance over all kept terms (0 where the
    language has none).  Part ``term``: the ``top`` kept terms that the source uses more than its language, with
    how much.  Ranks by value, then item in UTF-8 order.  Repeated rows are documents of their own; an empty
    table gives no row.
    """
    read = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = long_texts(docs.select(*read))
    kept = materialize(kept_terms(docs, min_docs))
    counts = materialize(term_counts(docs, kept))
    groups = materialize(docs.select("lang", "source").distinct())
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = materialize(groups.join(totals, ["lang", "source"], "left").join(n_terms, "lang", "left").select("lang", "source", zero("total"), zero("terms")))
    order = [F.desc("value"), F.asc("item")]
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank")

    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = groups.join(lang_totals, "lang")
    over = counts.join(in_lang, ["lang", "term"]).join(known, ["lang", "source"])
    more = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    by_term = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).where("value > 0")
    by_term = by_term.select("*", ranked).where(F.col("rank") <= top)

    cells = _joint_counts(counts, groups, kept.count())
    one, two = groups.alias("g"), groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"))
    apart = lambda x, y: F.abs(share(x, F.col("total"), F.col("terms")) - share(y, F.col("other_total"), F.col("terms")))
    each = cells.join(one, ["lang", "source"]).join(two, ["lang", "other"])
    tallied = each.groupBy("lang", "source", "other").agg(F.sum(F.col("m") * apart(F.col("x"), F.col("y"))).alias("there"), F.sum("m").alias("cells"))
    # Of every two sources the one before the other; terms that both lack are the cells that are left.
    pairs = one.join(two, "lang").where("source < other").join(tallied, ["lang", "source", "other"], "left")
    lacking = F.col("terms") - F.coalesce("cells", F.lit(0))
    nothing = F.coalesce(apart(F.lit(0), F.lit(0)), F.lit(0))
    pairs = pairs.select("lang", "source", "other", (F.coalesce("there", F.lit(0)) + lacking * nothing).cast("long").alias("value"))
    both = pairs.select("lang", "source", F.col("other").alias("item"), "value").union(pairs.select("lang", "other", "source", "value"))
    by_pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").select("*", ranked)
    return by_pair.unionByName(by_term)
