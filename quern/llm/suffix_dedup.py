"""Deduplication of long byte strings over whole documents by column-wise suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, in any document.

The collection is cut into segments so that equal strings meet in one place and in one column: each string
belongs to its anchor, the ANCHOR bytes within it whose hash is least.  A segment is a run of starts with one
anchor, and the bytes they reach.  Segments around equal anchors are one collection, aligned at the anchor.
Columns are then inserted from the right, one symbol of each segment a round: the round sorts the segments'
suffixes by their new symbol, stably, which gives the collection's Burrows-Wheeler column, and takes the
lengths of common prefixes along.  Neighbours with LENGTH bytes in common start the same string.  The columns
lie in a sequential file beside the task; only one of them, the order and the prefixes are held.

Copies of a whole segment are counted before that and enter as one.  Anchors around which very many different
segments lie (the ends of a passage that many documents share) are not one task's work: there the strings that
can be repeated at all, as CORE bytes in their middle are, are counted by a 128-bit hash each.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.llm import bloom
from quern.llm.common import long_texts, matched, materialize, row_key, shuffle_width
from quern.llm.near_copies import texts_of

#: Fixed value: bytes of a string that must not be there twice.
LENGTH = 400
#: Bytes of an anchor, and k-grams among which one is the anchor of a string.
ANCHOR = 100
REACH = LENGTH - ANCHOR + 1
#: Bytes that are searched for anchors at once, bytes of segments in a task, about.
PIECE, BUCKET_BYTES = 1 << 20, 16 << 20
#: Segments around one anchor that are sorted in one task; beyond them, starts whose strings share a core.
TOGETHER, STEP = 4_096, 16
CORE = LENGTH - STEP + 1

_PLACE = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B185EBCA87
_rng = np.random.default_rng(400)
_SYMBOLS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = np.cumprod(np.r_[1, np.full(2 * PIECE + LENGTH, _BASE, np.uint64)].astype(np.uint64))
_BACK = np.cumprod(np.r_[1, np.full(2 * PIECE + LENGTH, pow(_BASE, -1, 1 << 64), np.uint64)].astype(np.uint64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ANCHOR bytes from each place."""
    sums = np.cumsum(_SYMBOLS[data] * _POWERS[: len(data)])
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    hashes = (sums[ANCHOR:] - sums[:-ANCHOR]) * _BACK[: len(data) - ANCHOR + 1]
    hashes ^= hashes >> np.uint64(31)
    hashes *= _MIX
    return hashes ^ (hashes >> np.uint64(29))


def anchored(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, first, n, back, anchor) of the runs of starts with one anchor.

    ``data`` holds pieces one after the other, which begin at ``starts``; ``first`` is a place in ``data``,
    ``back`` how far the anchor lies behind it, ``anchor`` the anchor's hash.
    """
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = _gram_hashes(data)
    least, size = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * size <= REACH:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    rest = REACH - size
    least = np.minimum(least[: len(least) - rest], least[rest:])
    at = (least & _PLACE).astype(np.int64)
    ends = np.r_[starts[1:], len(data)]
    stops = np.maximum(ends - LENGTH + 1, starts)  # past the last start of each piece
    bounds = np.unique(np.concatenate([np.flatnonzero(np.diff(at)) + 1, starts, stops, [0, len(at)]]))
    bounds = bounds[bounds <= len(at)]
    first, n = bounds[:-1], np.diff(bounds)
    piece = np.searchsorted(starts, first, side="right") - 1
    inside = first < stops[piece]
    first, n, piece = first[inside], n[inside], piece[inside]
    return piece, first, n, at[first] - first, hashes[at[first]].view(np.int64)


def _pieces(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int]]]]:
    """(bytes, starts, (row, offset) of each): pieces of some PIECE bytes together; longer texts overlap in LENGTH - 1."""
    held, at, whose = [], [], []
    size = 0
    for row, text in enumerate(texts):
        raw = (text or "").encode("utf-8")
        for offset in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
            part = raw[offset : offset + PIECE + LENGTH - 1]
            held.append(part)
            at.append(size)
            whose.append((row, offset))
            size += len(part)
            if size >= PIECE:
                yield b"".join(held), np.array(at), whose
                held, at, whose, size = [], [], [], 0
    if held:
        yield b"".join(held), np.array(at), whose


def _all_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        found = [anchored(np.frombuffer(raw, np.uint8), starts)[4] for raw, starts, _ in _pieces(batch.column("text").to_pylist())]
        yield np.concatenate([np.zeros(0, np.int64), *found])


_SEGMENT = "at long, n int, back int, anchor long, seg binary"


def _segments(slim: DataFrame, least: int = 2) -> DataFrame:
    """(id, text_hash, at, n, back, anchor, seg): segments around anchors that are there twice, and a few others."""
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = 2 * size // REACH
    # One anchor in four is taken to be there again.
    twice = bloom.filter_of(slim.select("text"), _all_anchors, expected // 4, least=least)
    kind = slim.schema["id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, starts, whose in _pieces(batch.column("text").to_pylist()):
                piece, first, n, back, anchor = anchored(np.frombuffer(raw, np.uint8), starts)
                there = np.flatnonzero(bloom.held(anchor, twice.value))
                piece, first, n, back, anchor = (x[there] for x in (piece, first, n, back, anchor))
                if len(there):
                    head = np.stack([anchor, back], axis=1).tobytes()
                    seg = [xxhash.xxh3_128_digest(head[16 * i : 16 * i + 16] + raw[a : a + k + LENGTH - 1]) for i, (a, k) in enumerate(zip(first.tolist(), n.tolist()))]
                    rows, offsets = (np.array(x)[piece] for x in zip(*whose))
                    rows = pa.array(rows)
                    columns = [batch.column("id").take(rows), batch.column("text_hash").take(rows), pa.array(first - starts[piece] + offsets), pa.array(n.astype(np.int32)), pa.array(back.astype(np.int32)), pa.array(anchor), pa.array(seg, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "at", "n", "back", "anchor", "seg"])

    return slim.mapInArrow(found, f"id {kind}, text_hash long, {_SEGMENT}")


def suffix_rounds(columns, rows: int, rounds: int, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(order, common) after each round: the suffixes that begin in a column, sorted within their groups.

    ``columns`` is a file with a byte of every segment for each column, the last column first; ``group`` numbers
    the segments' collections in ascending order.  ``common[i]`` is how many bytes the suffixes at ``order[i - 1]``
    and ``order[i]`` have in common, 0 across groups; what lies past a segment's end counts as zero bytes.
    """
    order = np.arange(rows)
    same = np.r_[False, group[1:] == group[:-1]]
    common = np.where(same, rounds, 0).astype(np.int32)  # nothing has told them apart yet
    for _ in range(rounds):
        symbols = np.fromfile(columns, np.uint8, rows)[order].astype(np.int64)
        moved = np.argsort(group << 8 | symbols, kind="stable")  # groups stay where they are
        before, after = moved[:-1], moved[1:]
        equal = same[1:] & (symbols[before] == symbols[after])
        shared = np.zeros(rows, np.int32)
        pairs = np.flatnonzero(equal)
        # Of equal symbols the least common prefix of all that lay between, as a range of the old order.
        spans = np.stack([before[pairs] + 1, after[pairs] + 1], axis=1).ravel()
        if len(spans):
            shared[pairs + 1] = np.minimum.reduceat(np.append(common, 0), spans)[::2] + 1
        order, common = order[moved], shared
        yield order, common


def _repeated_starts(group: np.ndarray, back: np.ndarray, n: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Rows by starts: whether the string that starts there also starts elsewhere in the segment's group; sorted by group."""
    left = int(back.max())
    sizes = np.array(list(map(len, texts)))
    width = int((left - back + sizes).max())
    marked = np.zeros((len(texts), int(n.max())), bool)
    with tempfile.TemporaryFile() as columns:
        matrix = np.zeros((len(texts), width), np.uint8)
        for i, (text, shift) in enumerate(zip(texts, (left - back).tolist())):
            matrix[i, shift : shift + len(text)] = np.frombuffer(text, np.uint8)
        np.ascontiguousarray(matrix.T[::-1]).tofile(columns)
        del matrix
        columns.seek(0)
        rows = len(texts)
        same = np.r_[False, group[1:] == group[:-1]]
        for column, (order, common) in zip(range(width - 1, -1, -1), suffix_rounds(columns, rows, width, group)):
            start = column - left + back  # of each segment, among its own
            own = ((start >= 0) & (start < n))[order]
            if not own.any():
                continue
            heads = np.flatnonzero(~(same & (common >= LENGTH)))
            together = np.repeat(np.add.reduceat(own.astype(np.int32), heads), np.diff(np.r_[heads, rows]))
            hit = order[own & (together > 1)]
            marked[hit, start[hit]] = True
    return marked


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the runs of marks."""
    edges = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    return row, start, np.nonzero(edges == -1)[1]


_MARKS = "seg binary, low int, high int"


def _marks(seg: list[bytes], marked: np.ndarray) -> pa.Table:
    row, low, high = _runs(marked)
    return pa.table({"seg": pa.array([seg[i] for i in row.tolist()], pa.binary()), "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32))})


def _sorted_marks(bucket: pa.Table) -> pa.Table:
    bucket = bucket.sort_by("anchor")
    if bucket.num_rows < 2:
        return _marks([], np.zeros((0, 1), bool))
    group = np.unique(bucket.column("anchor").to_numpy(), return_inverse=True)[1]
    back, n = (bucket.column(c).to_numpy().astype(np.int64) for c in ("back", "n"))
    return _marks(bucket.column("seg").to_pylist(), _repeated_starts(group, back, n, bucket.column("bytes").to_pylist()))


def _cores(back: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, core): starts of a segment that share a core, and where that begins; steps are counted from the anchor."""
    low = 0
    while low < n:
        step = (low - back) // STEP
        high = min(n, (step + 1) * STEP + back)
        yield low, high, (step + 1) * STEP + back - 1
        low = high


def _core_hash(anchor: int, low: int, back: int, core: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(core, ((low - back) // STEP ^ anchor) & (1 << 64) - 1)).view(np.int64))


def _counted_marks(hot: DataFrame, bytes_of: int) -> DataFrame:
    """(seg, low, high) of the repeated strings of ``hot``, by counting them; ``bytes_of`` them in all."""

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        yield from zip(*[batch.column(c).to_pylist() for c in ("seg", "anchor", "back", "n", "bytes")])

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield np.array([_core_hash(anchor, low, back, raw[c : c + CORE]) for _, anchor, back, n, raw in each(batch) for low, _, c in _cores(back, n)], np.int64)

    twice = bloom.filter_of(hot, cores, bytes_of // LENGTH, least=2)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seg, anchor, back, n, raw in each(batch):
                spans = list(_cores(back, n))
                there = bloom.held(np.array([_core_hash(anchor, low, back, raw[c : c + CORE]) for low, _, c in spans], np.int64), twice.value)
                rows += [(seg, s, xxhash.xxh3_128_digest(raw[s : s + LENGTH])) for (low, high, _), t in zip(spans, there) if t for s in range(low, high)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.binary(), pa.int32(), pa.binary()))], names=["seg", "low", "string"])

    found = materialize(hot.mapInArrow(strings, "seg binary, low int, string binary"))
    again = found.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").select("string")
    return found.join(again, "string", "left_semi").select("seg", "low", (F.col("low") + 1).alias("high"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key struct<id,text_hash>, spans array<struct<start,end>>): bytes to remove, unmerged, for rows that lose any."""
    text = F.col(f"`{text_col}`")
    slim = long_texts(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where(F.octet_length(text) >= LENGTH))
    spark = docs.sparkSession
    # Rows that are alike in id and text are one, with their number.
    places = _segments(slim).groupBy("id", "text_hash", "at", "n", "back", "anchor", "seg").agg(F.count("*").alias("times"))
    places = materialize(places)
    segs = places.groupBy("seg", "anchor", "back", "n").agg(F.sum("times").alias("times"), F.min(F.struct("text_hash", "at")).alias("rep"))
    segs = materialize(segs)
    kinds = segs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = materialize(matched(segs, kinds, "anchor").select("seg", "anchor", "back", "n", "kinds", "rep.*"))

    # The bytes of one copy of each segment that has others around its anchor.
    reps = several.groupBy("text_hash").agg(F.collect_list(F.struct("at", "n", "back", "anchor", "seg", "kinds")).alias("reps"))
    texts = texts_of(slim.select("text"), several.select("text_hash"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, reps in zip(batch.column("raw").to_pylist(), batch.column("reps").to_pylist()):
                rows = [(r["seg"], r["anchor"], r["back"], r["n"], r["kinds"], raw[r["at"] : r["at"] + r["n"] + LENGTH - 1]) for r in reps]
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["seg", "anchor", "back", "n", "kinds", "bytes"])

    whole = texts.join(reps, "text_hash").select(F.col("text").cast("binary").alias("raw"), "reps").mapInArrow(cut, "seg binary, anchor long, back int, n int, kinds long, bytes binary")
    whole = materialize(whole)
    sizes = whole.agg(F.sum(F.octet_length("bytes")), F.sum(F.when(F.col("kinds") > TOGETHER, F.octet_length("bytes")))).first()
    buckets = max(shuffle_width(spark), (sizes[0] or 0) // BUCKET_BYTES + 1)
    few = whole.where(F.col("kinds") <= TOGETHER).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    marks = few.select("bucket", "seg", "anchor", "back", "n", "bytes").groupBy("bucket").applyInArrow(_sorted_marks, _MARKS)
    if sizes[1]:
        marks = marks.unionByName(_counted_marks(whole.where(F.col("kinds") > TOGETHER), sizes[1]))
    # All strings of a segment that is there twice are.
    marks = marks.unionByName(segs.where("times > 1").select("seg", F.lit(0).alias("low"), F.col("n").alias("high")))
    marks = materialize(marks.groupBy("seg").agg(F.collect_set(F.struct("low", "high")).alias("marks")))
    found = matched(places.select("id", "text_hash", "at", "seg"), marks, "seg")
    spans = F.transform("marks", lambda m: F.struct((F.col("at") + m["low"]).alias("start"), (F.col("at") + m["high"] + LENGTH - 1).alias("end")))
    return found.groupBy("id", "text_hash").agg(F.flatten(F.collect_list(spans)).alias("spans")).select(F.struct("id", "text_hash").alias("key"), "spans")


_REPORT = "n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"


def _removed(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """The report of a text: its spans merged, and what they leave."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    apart = np.r_[True, starts[1:] > reach[:-1]]
    starts, ends = starts[apart].tolist(), reach[np.r_[np.flatnonzero(apart)[1:] - 1, len(reach) - 1]].tolist()
    kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)]))
    return len(raw), len(raw) - len(kept), len(starts), kept, [{"start": a, "end": b} for a, b in zip(starts, ends)]


def dedup_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``string_report`` struct<n_bytes,n_removed,n_spans,kept,spans>; an input column of that name is replaced.

    ``kept`` are the bytes that stay, which need not be valid UTF-8; ``spans`` the maximal removed runs.  A null
    text is empty; texts of under 400 bytes keep all.  Repeated rows are documents of their own, so all their
    strings go; rows without an id take part like others.  Strings are judged on the input.
    """
    found = materialize(repeated_spans(docs, id_col, text_col))
    columns = [c for c in docs.columns if c.lower() != "string_report"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("raw"), row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"))
    touched = bloom.filter_of(found.select(F.xxhash64("key").alias("hash")), "hash", found.count())
    rows = rows.withColumn("touched", bloom.maybe(F.xxhash64("key"), touched))
    spans = found.select(F.col("key").alias("marked"), "spans")
    same = F.col("key.id").eqNullSafe(F.col("marked.id")) & (F.col("key.text_hash") == F.col("marked.text_hash"))
    joined = rows.where("touched").join(spans, same, "left")

    @pandas_udf(_REPORT)
    def cut(raws: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        found = [_removed(raw, np.asarray(a, np.int64), np.asarray(b, np.int64)) for raw, a, b in zip(raws, starts, ends)]
        return pd.DataFrame(found, columns=["n_bytes", "n_removed", "n_spans", "kept", "spans"])

    zero = F.lit(0).cast("long")
    whole = F.struct(F.octet_length("raw").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("raw").alias("kept"), F.lit([]).cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    some = joined.where("spans is not null").select("row", cut("raw", "spans.start", "spans.end").alias("string_report"))
    rest = joined.where("spans is null").unionByName(rows.where("not touched"), allowMissingColumns=True).select("row", whole.alias("string_report"))
    return some.unionByName(rest).select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "string_report")
