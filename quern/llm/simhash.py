"""SimHash near-duplicate components by anchor-point covering.

Anchors are the pairs of codewords of the perfect binary Golay code on two times 23 of the 64 bits: 2^24
of them.  Every fingerprint lies within covering radius 3 of exactly one codeword in either half, its home.
A fingerprint is replicated to the anchors within covering radius plus threshold (shared out over the
halves), so it meets, at their homes, all fingerprints within the threshold.  Each anchor compares its
residents with its replicas on all 64 bits.

Copies share a fingerprint and enter once.  Replicas of anchors where nobody lives are never sent: the
occupied ones are a bitmap of 2^24 bits, whatever the input.  Busy anchors are split into blocks of residents
times replicas; a block returns a spanning forest, never its pairs.  The forests are joined into components
by label propagation with pointer jumping over DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.llm.bloom import packed
from quern.llm.common import UPPER, WORD, few, long_texts, matched, materialize, replaced, shuffle_width, unestimated

#: Fixed values of the binary Golay code (23,12): length, covering radius, generator polynomial.
CODE_BITS = 23
CODE_RADIUS = 3
CODE_GENERATOR = 0b101011100011
#: Bits of an anchor: twelve for the codeword of either half.
ANCHOR_BITS = 24
#: Residents of an anchor from which it is split, and residents in a block.
BUSY_RESIDENTS = 4096
#: Residents and replicas that a task compares at a time, about.
BUCKET_ENTRIES = 1 << 20
#: Fingerprints whose replicas are made at a time.
BATCH_PRINTS = 2048

_LOWER = str.maketrans(UPPER, UPPER.lower())
_WORDS = regex.compile(WORD)


def fingerprint_text(text: str | None, shingle_words: int = 3) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of every word shingle; no word: 0; few words: one shingle."""
    if not text:
        return 0
    words = _WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[k:] for k in range(shingle_words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[start : start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", shingle_words: int = 3) -> DataFrame:
    """``docs`` with ``out``, the fingerprint as a (signed) long; an input column of that name is replaced."""

    @pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_text(t, shingle_words) for t in texts], dtype=np.uint64).view(np.int64))

    return replaced(long_texts(docs), **{out: simhash(F.col(f"`{text_col}`"))})


@lru_cache(maxsize=4)
def _error_patterns(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, start, syndrome of each bit): error patterns up to ``radius`` bits, grouped by syndrome."""
    parity = CODE_BITS - 12

    def remainder(word: int) -> int:
        for bit in range(CODE_BITS - 1, parity - 1, -1):
            if word >> bit & 1:
                word ^= CODE_GENERATOR << (bit - parity)
        return word

    of_bit = np.array([remainder(1 << b) for b in range(CODE_BITS)], dtype=np.int32)
    patterns, syndromes = [np.zeros(1, np.int32)], [np.zeros(1, np.int32)]
    for weight in range(1, radius + 1):
        bits = np.array(list(combinations(range(CODE_BITS), weight)), dtype=np.int32)
        patterns.append((1 << bits).sum(axis=1, dtype=np.int32))
        syndromes.append(np.bitwise_xor.reduce(of_bit[bits], axis=1))
    pattern, syndrome = np.concatenate(patterns), np.concatenate(syndromes)
    order = np.argsort(syndrome, kind="stable")  # within a syndrome, light patterns first
    return pattern[order], np.searchsorted(syndrome[order], np.arange((1 << parity) + 1)), of_bit


@lru_cache(maxsize=4)
def _reach(threshold: int) -> np.ndarray:
    """How many codewords lie within radius + 0, 1, .. ``threshold`` bits of the words of each syndrome."""
    pattern, start, _ = _error_patterns(CODE_RADIUS + threshold)
    weight = np.bitwise_count(pattern.view(np.uint32))
    return np.array([[int((weight[a:b] <= CODE_RADIUS + e).sum()) for e in range(threshold + 1)] for a, b in zip(start, start[1:])])


def _syndromes(words: np.ndarray, of_bit: np.ndarray) -> np.ndarray:
    syndrome = np.zeros(len(words), np.int32)
    for bit in range(CODE_BITS):
        syndrome ^= np.where(words >> bit & 1, of_bit[bit], 0).astype(np.int32)
    return syndrome


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def anchors_within(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(homes, anchors, owners): each fingerprint's home, and all anchors it is replicated to.

    A fingerprint within ``threshold`` bits, e in one half and the rest elsewhere, has its home within
    CODE_RADIUS + e of this one's word in that half.
    """
    pattern, start, of_bit = _error_patterns(CODE_RADIUS + threshold)
    reach, parity, mask = _reach(threshold), CODE_BITS - 12, np.uint64((1 << CODE_BITS) - 1)
    words = [((fps >> np.uint64(shift)) & mask).astype(np.int32) for shift in (0, CODE_BITS)]
    syndromes = [_syndromes(w, of_bit) for w in words]
    homes = [(w ^ pattern[start[s]]) >> parity for w, s in zip(words, syndromes)]
    # All patterns of the second half; each goes with those of the first half that the rest of the threshold allows.
    counts = reach[syndromes[1], threshold]
    owner, at = np.repeat(np.arange(len(fps)), counts), _ragged(counts)
    second = pattern[start[syndromes[1]][owner] + at]
    spent = np.maximum(np.bitwise_count(second.view(np.uint32)).astype(np.int64) - CODE_RADIUS, 0)
    second = (words[1][owner] ^ second) >> parity
    counts = reach[syndromes[0][owner], threshold - spent]
    again = np.repeat(np.arange(len(owner)), counts)
    owners = owner[again]
    first = (words[0][owners] ^ pattern[start[syndromes[0]][owners] + _ragged(counts)]) >> parity
    return homes[1] << 12 | homes[0], second[again] << 12 | first, owners


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one connected to it) of edges between fingerprints, without those that are their own."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while len(left):
        la, lb = label[left], label[right]
        apart = la != lb
        left, right, la, lb = left[apart], right[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(jumped := label[label], label):
            label = jumped
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def compare(anchors: np.ndarray, fps: np.ndarray, resident: np.ndarray, threshold: int, pairs_at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the fingerprints that meet at one of ``anchors``, residents with replicas, within ``threshold``."""
    order = np.argsort(anchors, kind="stable")
    anchors, fps, resident = anchors[order], fps[order], resident[order]
    here, there = np.flatnonzero(resident), np.flatnonzero(~resident)
    low, high = (np.searchsorted(anchors[there], anchors[here], side=side) for side in ("left", "right"))
    counts = high - low
    found: list[tuple[np.ndarray, np.ndarray]] = []
    start, done = 0, np.cumsum(counts)
    while start < len(here):
        end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + pairs_at_once, side="right")))
        who = np.repeat(here[start:end], counts[start:end])
        whom = there[np.repeat(low[start:end], counts[start:end]) + _ragged(counts[start:end])]
        near = np.bitwise_count(fps[who] ^ fps[whom]) <= threshold
        found.append(forest(fps[who[near]], fps[whom[near]]))
        start = end
    return forest(*(np.concatenate(x) for x in zip(*found))) if found else (fps[:0], fps[:0])


def _links(distinct: DataFrame, threshold: int) -> DataFrame:
    """(fp, root): edges that connect all of ``distinct``'s fingerprints within ``threshold``."""
    spark = distinct.sparkSession

    @pandas_udf("int")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for fps in batches:
            yield pd.Series(anchors_within(fps.to_numpy(np.int64).view(np.uint64), 0)[0])

    lived = materialize(distinct.select(home("fp").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")))
    # A bit for each anchor: 2^18 numbers at most.
    words = lived.groupBy(F.expr("anchor div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, anchor % 64)")).alias("bits")).toPandas()
    bits = np.zeros(1 << (ANCHOR_BITS - 6), np.int64)
    bits[words["word"]] = words["bits"]
    # One row for each BUSY_RESIDENTS fingerprints at most.
    busy = lived.where(F.col("n") > BUSY_RESIDENTS).orderBy("anchor").toPandas()
    blocks = -(-busy["n"].to_numpy(np.int64) // BUSY_RESIDENTS)
    n = lived.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-n // (BUCKET_ENTRIES // 256)))
    shared = spark.sparkContext.broadcast((bits, busy["anchor"].to_numpy(np.int64), blocks))

    def blocked(anchors: np.ndarray, fps: np.ndarray, resident: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, anchor, fingerprint): rows of busy anchors once for each block of the other side."""
        _, hot, blocks = shared.value
        at = np.minimum(np.searchsorted(hot, anchors), max(len(hot) - 1, 0))
        ni = np.where(hot[at] == anchors, blocks[at], 1) if len(hot) else np.ones(len(anchors), np.int64)
        nj = np.where(ni > 1, 4 * ni, 1)
        own, other = (ni, nj) if resident else (nj, ni)
        mixed = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        mine, across = np.repeat(mixed.astype(np.int64) % own, other), _ragged(other)
        i, j = (mine, across) if resident else (across, mine)
        anchors, fps = np.repeat(anchors, other), np.repeat(fps, other)
        key = ((anchors * 1_000_003 + i) * 1_000_003 + j).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((key >> np.uint64(33)).astype(np.int64) % buckets), key.view(np.int64), fps

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value[0]
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for start in range(0, len(fps), BATCH_PRINTS):
                part = fps[start : start + BATCH_PRINTS]
                homes, anchors, owners = anchors_within(part, threshold)
                kept = (bits[anchors >> 6] >> (anchors & 63) & 1).astype(bool)
                sides = [(*blocked(homes.astype(np.int64), part, True), True), (*blocked(anchors[kept].astype(np.int64), part[owners[kept]], False), False)]
                rows = [(*row, lives) for keys, at, who, lives in sides for row in packed(keys, at, who)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.bool_()))], names=["bucket", "anchors", "fps", "resident"])

    def meet(bucket: pa.Table) -> pa.Table:
        joined = lambda c, t: [np.frombuffer(b, t) for b in bucket.column(c).to_pylist()]
        anchors, fps = joined("anchors", np.int64), joined("fps", np.uint64)
        resident = np.repeat(bucket.column("resident").to_numpy(), [len(x) for x in fps])
        fp, root = compare(np.concatenate(anchors), np.concatenate(fps), resident, threshold)
        return pa.table({"fp": fp.view(np.int64), "root": root.view(np.int64)})

    sent = distinct.select("fp").mapInArrow(replicate, "bucket long, anchors binary, fps binary, resident boolean")
    return sent.groupBy("bucket").applyInArrow(meet, "fp long, root long")


def _labels(links: DataFrame) -> DataFrame:
    """(fp, label): the smallest (signed) fingerprint connected to each linked fingerprint."""
    links = few(links.distinct())
    both = few(links.select(F.col("fp").alias("u"), F.col("root").alias("v")).union(links.select(F.col("root").alias("u"), F.col("fp").alias("v"))))
    labels = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        # The least label among a vertex's neighbours goes to the vertex and to the one that it is named after, so
        # that chains take few rounds.
        offered = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("offer"))
        met = few(offered.join(labels, "u"))
        hooked = met.select("u", F.least("label", "offer").alias("label")).union(met.where("offer < label").select("label", "offer"))
        lower = few(hooked.groupBy("u").agg(F.min("label").alias("label")))
        above = lower.select(F.col("u").alias("at"), F.col("label").alias("further"))
        jumped = few(lower.join(above, lower["label"] == above["at"], "left").select("u", F.least("label", F.coalesce("further", "label")).alias("label")))
        moved = jumped.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("total")).first()[0]
        before = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("total")).first()[0]
        labels = unestimated(jumped)
        if moved == before:  # labels only ever fall, so an equal sum means an equal labelling
            return labels.select(F.col("u").alias("fp"), "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 3, shingle_words: int = 3) -> DataFrame:
    """(id, text_hash, fingerprint long, label, component): one row per input row.

    Fingerprints within ``threshold`` bits (0 to 4) are linked; ``label`` names the connected documents,
    ``component`` is the smallest id of them (null if none has an id), which two components may share where
    ids repeat.  Null, empty and wordless texts have fingerprint 0 and are linked like any other; repeated
    rows are one class.
    """
    if not 0 <= threshold <= 4:
        raise ValueError("threshold is 0 to 4 bits")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prints = fingerprints(slim, "text", "fingerprint", shingle_words)
    prints = materialize(prints.select("id", F.xxhash64("text").alias("text_hash"), F.col("fingerprint").alias("fp")))
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    labels = _labels(_links(distinct.select("fp"), threshold))
    labelled = materialize(distinct.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "first_id"))
    components = materialize(labelled.groupBy("label").agg(F.min("first_id").alias("component")))
    component_of = labelled.join(components, "label").select("fp", "label", "component")
    return matched(prints, component_of, "fp").select("id", "text_hash", F.col("fp").alias("fingerprint"), "label", "component")
