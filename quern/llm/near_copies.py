"""Near copies: components of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the sets meet by anchor covering (``simhash``), and every link they give is verified
on the whole sets.  Sets that are alike enough often lie many bits apart, so an exact set-similarity join finds
the rest.  In one order of all shingles, two sets that are alike enough share a shingle within their first
``n - ceil(0.8 n) + 1`` ones (prefix filter); where their first shared one lies bounds what they can share at
all (positional filter).  Any order gives all pairs.  Shingles that one set alone has come first: a set with
so many of its own has no copy and sends nothing.  Whether a shingle is a set's own is read off a Bloom filter
of fixed size over all shingles of all sets; those that are frequent in a bounded sample come last.  Every
candidate pair is verified on the whole sets.

Pairs inside a component need not be looked at: each set is first tried with one that it shares many prefix
shingles with, and only what then still lies in different components is compared.  Where that is a crowd, sets
that differ only in shingles of their own are one: what they share with each other, and with any other set, is
known from one of them.  The pairs of a shingle are dealt out in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.llm import bloom
from quern.llm.common import UPPER, WORD, few, long_texts, matched, materialize, smallest
from quern.llm.simhash import _labels, _links

#: Fixed values of a near copy: words of a shingle, and the similarity as a fraction.
SHINGLE_WORDS = 5
ALIKE = (4, 5)
#: Fingerprints of sets are linked at so many differing bits or fewer.
THRESHOLD = 3
#: Texts whose shingles are counted for the order at most; it bears on cost, never on results.
SAMPLE_TEXTS = 2_000
#: Shingles in a task, and shingles of sets that are verified against one set in a task, about.
BUCKET_SHINGLES = 1 << 20
#: Words whose hashes a Python worker keeps.
MEMO_WORDS = 50_000
#: Sets of a shingle beyond which those that differ in their own shingles only count as one; rows that meet in a task.
CROWD, BLOCK_SETS = 64, 1 << 10

_LOWER = str.maketrans(UPPER, UPPER.lower())
_WORDS = regex.compile(WORD)
_PRIME = np.uint64(0x9E3779B185EBCA87)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: str | None, known: dict[str, int], words_of: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; few words: one shingle; no word: none.

    ``known`` keeps word hashes between calls.
    """
    words = _WORDS.findall((text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42)
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(words_of, len(words))
    n = len(words) - k + 1
    mixed = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = mixed * _PRIME + hashes[i : i + n]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    return np.unique((mixed ^ (mixed >> np.uint64(32))).view(np.int64))


def set_hash(shingles: np.ndarray) -> int:
    """64-bit hash of a whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64))


def set_fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 65536):
        ones += np.unpackbits(shingles[start : start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def prefix(shingles: np.ndarray, repeated: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, places): those of a set's prefix that other sets may have (``repeated``), where they stand in the order."""
    n = len(shingles)
    length = n - -(-ALIKE[0] * n // ALIKE[1]) + 1 if n else 0
    rank = repeated.astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank += np.where(frequent[at] == shingles, counts[at], 0)
    order = np.argsort(rank, kind="stable")[:length]
    kept = repeated[order]
    return shingles[order[kept]], np.flatnonzero(kept)


def _hashed(texts: Iterator[pd.Series]) -> Iterator[list[np.ndarray]]:
    """The shingle sets of each batch."""
    known: dict[str, int] = {}
    for batch in texts:
        sets = []
        for text in batch:
            if len(known) > MEMO_WORDS:
                known.clear()
            sets.append(shingle_set(text, known))
        yield sets


def _shingles(text: str) -> Column:
    @pandas_udf("array<long>")
    def shingles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sets in _hashed(texts):
            yield pd.Series(sets, dtype=object)

    return shingles(text)


def _alike(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of ``n`` and ``m`` that share so many have the similarity."""
    a, b = ALIKE
    return (a + b) * shared >= a * (n + m)


def _reachable(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets whose first shared shingle lies at ``i`` and ``j`` can still share enough."""
    return _alike(F.least(n - i, m - j), n, m)


def _first_texts(batches: Iterator[pa.RecordBatch], firsts: tuple[np.ndarray, int]) -> Iterator[list[np.ndarray]]:
    """The sets of each batch of (key, text), copies that are not the first of their set left out (most of them)."""
    for sets in _hashed(batch.column("text").filter(pa.array(bloom.held(batch.column("key").to_numpy(), firsts))).to_pylist() for batch in batches):
        yield sets


def _shared_prefixes(keyed: DataFrame, sets: DataFrame, often: Broadcast) -> DataFrame:
    """(s, fp, at, n, own): the prefix shingles that several sets have, and few others; ``own`` are the set's own before them."""
    there = sets.agg(F.count("*"), F.sum(F.col("n").cast("long"))).first()
    total = int(there[1] or 0)
    firsts = bloom.filter_of(sets, "key", there[0])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for sets in _first_texts(batches, firsts.value):
            yield np.concatenate(sets) if sets else np.zeros(0, np.int64)

    # One shingle in ten is taken to be in several sets.
    repeated = bloom.filter_of(keyed, every, total // 10, least=2)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _first_texts(batches, firsts.value):
            rows = []
            for shingles in sets:
                s, at = prefix(shingles, bloom.held(shingles, repeated.value), *often.value)
                rows.append((s, np.full(len(s), set_hash(shingles), np.int64), *(np.full(len(s), x, np.int32) for x in (at, len(shingles), at.min(initial=len(shingles))))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["s", "fp", "at", "n", "own"])

    placed = few(keyed.mapInArrow(kept, "s long, fp long, at int, n int, own int").distinct())
    for used in (firsts, repeated):
        used.unpersist()
    return placed


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text_hash, text) of the hashes in ``wanted``, once each; other texts are left out where they lie."""
    known = bloom.filter_of(wanted, "text_hash", wanted.count())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("text_hash").to_numpy()
            first = np.zeros(len(hashes), bool)
            first[np.unique(hashes, return_index=True)[1]] = True
            yield batch.filter(pa.array(first & bloom.held(hashes, known.value)))

    few = texts.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(kept, "text_hash long, text string")
    return few.groupBy("text_hash").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, root) of the pairs (a, b) whose whole sets are alike.

    The sets paired with one set ``b`` come to it in blocks of bounded size; only texts of candidates are
    looked up, one for each set, and hashed again.
    """
    known = sets.select("fp", "n", "text_hash")
    a, b = (known.select(F.col("fp").alias(k), F.col("n").alias(f"n_{k}"), F.col("text_hash").alias(f"text_{k}")) for k in ("a", "b"))
    sized = few(pairs.join(a, "a"))
    blocks = sized.groupBy("b").agg(F.ceil(F.sum("n_a") / BUCKET_SHINGLES + 1).cast("int").alias("blocks"))
    sized = few(matched(sized, b.join(blocks, "b"), "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")))
    places = sized.select(F.col("text_a").alias("text_hash"), F.col("a").alias("fp"), "b", "block").unionByName(sized.select(F.col("text_b").alias("text_hash"), F.col("b").alias("fp"), "b", "block").distinct())
    once = texts_of(texts, places)

    def verify(block: pa.Table) -> pa.Table:
        hub = block.column("b")[0].as_py()
        known: dict[str, int] = {}
        fps, found = block.column("fp").to_numpy(), []
        whole = shingle_set(block.column("text")[int(np.flatnonzero(fps == hub)[0])].as_py(), known)
        for fp, text in zip(fps, block.column("text")):
            if fp != hub:
                other = shingle_set(text.as_py(), known)
                shared = len(np.intersect1d(whole, other, assume_unique=True))
                if sum(ALIKE) * shared >= ALIKE[0] * (len(whole) + len(other)):
                    found.append(fp)
        fps = np.array(found, np.int64)
        return pa.table({"fp": np.maximum(fps, hub), "root": np.minimum(fps, hub)})

    return once.join(places, "text_hash").select("b", "block", "fp", "text").groupBy("b", "block").applyInArrow(verify, "fp long, root long")


def _classes(crowd: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, rep, core, n): the sets ``crowd`` in classes, each named by one of them.

    Sets of one class have the same size and the same shingles besides those that no other of them has, ``core``
    of them.  They share just these, so all of a class are alike to each other or none are, and a set is alike
    to all of a class or to none.
    """
    known = few(crowd.join(sets.select("fp", "n", "text_hash"), "fp"))
    both = texts_of(texts, known).join(known.select("text_hash", "fp"), "text_hash").select("fp", "text")
    both = materialize(both)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            known: dict[str, int] = {}
            yield np.concatenate([np.zeros(0, np.int64), *[shingle_set(t, known) for t in batch.column("text").to_pylist()]])

    shared = bloom.filter_of(both, every, int(known.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0), least=2)

    def cored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, int] = {}
            found = []
            for text in batch.column("text").to_pylist():
                whole = shingle_set(text, words)
                core = whole[bloom.held(whole, shared.value)]
                found.append((set_hash(core), len(core), len(whole)))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), *[pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32()))]], names=["fp", "hash", "core", "n"])

    found = few(both.mapInArrow(cored, "fp long, hash long, core int, n int"))
    shared.unpersist()
    reps = found.groupBy("hash", "n").agg(F.min("fp").alias("rep"))
    # A class that most of the sets are in is a hot key here.
    found = found.withColumn("class", F.xxhash64("hash", "n"))
    reps = reps.select(F.xxhash64("hash", "n").alias("class"), "rep")
    return few(matched(found, reps.groupBy("class").agg(F.min("rep").alias("rep")), "class").select("fp", "rep", "core", "n"))


def _met(rows: DataFrame) -> DataFrame:
    """(a, b) of ``rows`` (s, fp, at, n, label) that share a shingle and can be alike; a null label differs from all.

    The rows of a shingle meet in blocks: a task gets BLOCK_SETS rows of either side at most for one key.
    """
    sizes = rows.groupBy("s").agg(F.count("*").alias("k"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.col("label").isNull()).alias("open"))
    sizes = sizes.where("k > 1 and (open or low < high)").select("s", F.ceil(F.col("k") / BLOCK_SETS).cast("int").alias("blocks"))
    dealt = few(matched(rows, sizes, "s").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    columns = ("s", "fp", "at", "n", "label")
    x = dealt.select(*columns, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j")).alias("x")
    y = dealt.select(*columns, F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j")).alias("y")
    same = (F.col("x.s") == F.col("y.s")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    meet = same & ((F.col("x.i") < F.col("x.j")) | (F.col("x.fp") < F.col("y.fp"))) & ~F.coalesce(F.col("x.label") == F.col("y.label"), F.lit(False))
    meet = meet & _reachable(*[F.col(c) for c in ("x.n", "x.at", "y.n", "y.at")])
    return x.join(y, meet).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def _left_apart(placed: DataFrame, tried: DataFrame, sets: DataFrame, texts: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, links): those that the first ones lack, between sets of different labels that share a prefix shingle.

    ``placed``: (s, fp, at, n, label).  Where many sets of a shingle are apart, those of a class count as one: of
    many copies with a word changed, all that lack the same shingles.
    """
    apart = placed.groupBy("s").agg(F.count("*").alias("k"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("s", "k")
    grouped = few(matched(placed, apart, "s"))
    crowd = few(grouped.where(F.col("k") > CROWD).select("fp").distinct())
    rows, more, classes = grouped.select("s", "fp", "at", "n", "label"), None, None
    if crowd.take(1):
        classes = _classes(crowd, sets, texts)
        alike = _alike(F.col("core"), F.col("n"), F.col("n"))
        more = few(classes.where(alike & (F.col("fp") != F.col("rep"))).select(F.greatest("fp", "rep").alias("fp"), F.least("fp", "rep").alias("root")))
        # A class of which none is alike to another has no label, unless it is of one set.
        lone = classes.groupBy("rep").agg((F.first(alike) | (F.count("*") == 1)).alias("one"))
        reps = rows.select("fp", "label").distinct().join(classes.select("fp", "rep"), "fp", "left").select("fp", "label", F.coalesce("rep", "fp").alias("rep"))
        reps = few(reps.join(lone, "rep", "left").where("fp = rep").select("fp", F.when(F.coalesce("one", F.lit(True)), F.col("label")).alias("label")))
        # Of shingles whose sets have one label, only those of a set without a label are to be looked at.
        opened = reps.where("label is null")
        if opened.take(1):
            wanted = apart.select("s").union(placed.join(opened.select("fp"), "fp", "left_semi").select("s"))
            grouped = matched(placed, few(wanted.distinct()), "s")
        rows = few(grouped.select("s", "fp", "at", "n").join(reps, "fp").select("s", "fp", "at", "n", "label"))
    pairs = few(_met(rows))
    pairs = few(pairs.join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti")) if classes is None else pairs
    if not pairs.take(1):
        return None, more
    links = few(_verified(pairs, sets, texts))
    if classes is not None:
        # What one of a class is linked with, all are.
        ends = links.select(F.col("fp").alias("rep"), F.col("root").alias("to")).union(links.select("root", "fp")).groupBy("rep").agg(F.min("to").alias("to"))
        rest = matched(classes.where("fp <> rep"), ends, "rep").select(F.greatest("fp", "to").alias("fp"), F.least("fp", "to").alias("root"))
        links = few(links.union(rest))
    return links, more


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, label, component): one row per input row.

    ``label`` names the component; ``component`` is the smallest id of its documents (null if none of them
    has an id), which two components may share where ids repeat.  Texts without a word are copies of each other.
    """
    spark = docs.sparkSession
    slim = long_texts(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    sampled = smallest(slim.select("text").where("text is not null"), F.xxhash64("text"), SAMPLE_TEXTS).distinct().select(_shingles("text").alias("shingles"))
    counted = sampled.select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 1").toPandas().sort_values("s")
    often = spark.sparkContext.broadcast((counted["s"].to_numpy(np.int64), counted["count"].to_numpy(np.int64)))

    @pandas_udf("fp long, n int, sim long")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sets in _hashed(texts):
            yield pd.DataFrame({"fp": list(map(set_hash, sets)), "n": list(map(len, sets)), "sim": list(map(set_fingerprint, sets))}).astype("int64").astype({"n": "int32"})

    prints = materialize(slim.select("id", F.xxhash64("text").alias("text_hash"), hashed("text").alias("set")).select("id", "text_hash", "set.*"))
    # Copies of a set are one.
    first = F.min(F.struct("text_hash", "id"))
    sets = prints.groupBy("fp").agg(F.first("n").alias("n"), F.first("sim").alias("sim"), first.alias("first"), F.min("id").alias("first_id"))
    sets = few(sets.select("fp", "n", "sim", "first_id", "first.text_hash", F.xxhash64("first.id", "first.text_hash").alias("key")))
    keyed = slim.select(F.xxhash64("id", F.xxhash64("text")).alias("key"), "text")

    # What the fingerprints link: sets of one fingerprint with one of them, and those with each other.
    one = sets.groupBy("sim").agg(F.min("fp").alias("one"))
    far = _links(one.select(F.col("sim").alias("fp")), THRESHOLD)
    ends = far.join(one.withColumnsRenamed({"sim": "fp", "one": "a"}), "fp").join(one.withColumnsRenamed({"sim": "root", "one": "b"}), "root").select("a", "b")
    near = sets.join(one, "sim").where("fp <> one").select(F.col("fp").alias("a"), F.col("one").alias("b"))

    placed = _shared_prefixes(keyed, sets, often)

    # The set with the fewest shingles of its own is drawn: of a text and its edited copies, the text.
    drawn = placed.groupBy("s").agg(F.count("*").alias("sets"), F.min(F.struct("own", F.xxhash64("fp").alias("h"), "fp", "at", "n")).alias("drawn")).where("sets > 1").select("s", "drawn")
    placed = few(matched(placed, drawn, "s"))
    hub = F.col("drawn")
    stars = placed.where((F.col("fp") != hub["fp"]) & _reachable(F.col("n"), F.col("at"), hub["n"], hub["at"])).select(F.col("fp").alias("a"), hub["fp"].alias("b"))
    # Each set is tried with the one it shares most of these shingles with; what that leaves apart is the rest's.
    stars = stars.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))
    tried = few(stars.union(ends).union(near).distinct())
    links = few(_verified(tried, sets, slim))
    labels = _labels(links)

    placed = few(placed.join(labels, "fp", "left").select("s", "fp", "at", "n", F.coalesce("label", "fp").alias("label")))
    rest, more = _left_apart(placed, tried, sets, slim)
    if more is not None:
        links = links.union(more)
    if rest is not None:
        links = links.union(rest)
    if more is not None or rest is not None:
        labels = _labels(links)

    labelled = few(sets.select("fp", "first_id").join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "first_id"))
    components = labelled.groupBy("label").agg(F.min("first_id").alias("component"))
    component_of = labelled.join(components, "label").select("fp", "label", "component")
    return matched(prints.select("id", "text_hash", "fp"), component_of, "fp").select("id", "text_hash", "label", "component")
