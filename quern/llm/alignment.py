"""Alignment of two tokenizers' tokens by the bytes they stand for.

Each byte of a text has an owner among the tokens of A and one among those of B (``np.repeat`` of token
numbers).  Consecutive distinct owner pairs are the overlaps; where both owners change at once is a cut.
The tokens between two cuts are a group, and every A token of a group is linked with every B token of it.

Corpus-wide counts of linked id pairs are documents, not occurrences.  A task tallies them for blocks of
documents, so that a pair is one row a block, however common; the summed counts come back to the blocks in
the same form.  What is held for a document in between is its distinct pairs, as places in its block's list.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from tokenizers import Tokenizer

from quern.llm.common import long_texts, new_folder

VOCABULARY_A, RANKS_A, VOCABULARY_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: An id pair is one number, A's id above these bits.
B_BITS = 15
#: Pairs of a block's documents, about, and bytes of text that are aligned at once.
BLOCK_PAIRS, TEXT_BYTES = 1 << 21, 1 << 21
#: Links of a group that are listed one by one; larger groups are counted by their distinct ids.
LISTED_LINKS = 1 << 12

#: Texts of these characters are split alike by either library's patterns, whatever their Unicode version.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-ɏ]*").fullmatch


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, ranks_a: str, path_b: str):
        self.slow = Tokenizer.from_file(path_a)
        self.slow.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        of_char = _byte_of_char()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        with open(ranks_a, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        # The ranks are a quicker way to the same ids, where they are the same vocabulary.
        same = all(self.bytes_a[i] == token for token, i in ranks.items())
        self.quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        assert len(self.bytes_b) <= 1 << B_BITS
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # How a token is written inside a group and at the end of its side.
        self.written = [f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))] + [f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and of B; none if either side does not give back a space and the text."""
        if not text:
            return [], []
        spaced = " " + text
        raw = spaced.encode("utf-8")
        if self.quick and _PLAIN(text):
            a = self.quick.encode_ordinary(spaced)
        else:
            a = self.slow.encode(spaced, add_special_tokens=False).ids
        b = self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return [], []
        return a, b


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, turned round."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def pair(path_a: str, ranks_a: str, path_b: str) -> Pair:
    """The tokenizers of these files; a Python worker loads them once."""
    return Pair(path_a, ranks_a, path_b)


def default_paths() -> tuple[str, str, str]:
    return tuple(map(public_tokenizers.path, (VOCABULARY_A, RANKS_A, VOCABULARY_B)))


class Aligned:
    """Groups of the tokens of several texts in a row; each text's bytes are the same on both sides."""

    def __init__(self, tokens: list[tuple[list[int], list[int]]], length_a: np.ndarray, length_b: np.ndarray):
        self.texts = len(tokens)
        self.a, self.b = (np.array([i for t in tokens for i in t[side]], np.int64) for side in (0, 1))
        self.text_a, self.text_b = (np.repeat(np.arange(self.texts), [len(t[side]) for t in tokens]) for side in (0, 1))
        owner_a, owner_b = (np.repeat(np.arange(len(ids)), length[ids]) for ids, length in ((self.a, length_a), (self.b, length_b)))
        new_a, new_b = (np.diff(owner, prepend=-1) != 0 for owner in (owner_a, owner_b))
        cut = new_a & new_b
        group = np.cumsum(cut) - 1
        self.group_a, self.group_b = group[new_a], group[new_b]
        self.groups = int(cut.sum())
        self.size_a, self.size_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        self.text_of_group = self.text_a[np.cumsum(self.size_a) - self.size_a]
        overlap = np.flatnonzero(new_a | new_b)
        self.n_overlaps = np.bincount(self.text_a[owner_a[overlap]], minlength=self.texts)

    def per_text(self, texts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(self.texts, np.int64)
        np.add.at(total, texts, weights)
        return total

    def counted_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) of the distinct id pairs of each text, ordered."""
        start_b = np.cumsum(self.size_b) - self.size_b
        listed = (self.size_a * self.size_b <= LISTED_LINKS)[self.group_a]
        times = np.where(listed, self.size_b[self.group_a], 0)
        at_a = np.repeat(np.arange(len(self.a)), times)
        at_b = start_b[self.group_a[at_a]] + np.arange(len(at_a)) - np.repeat(np.cumsum(times) - times, times)
        keys, links = np.unique(self.text_a[at_a] << 31 | self.a[at_a] << B_BITS | self.b[at_b], return_counts=True)
        more = [(keys, links)]
        start_a = np.cumsum(self.size_a) - self.size_a
        for g in np.flatnonzero(self.size_a * self.size_b > LISTED_LINKS):
            (a, n), (b, m) = (np.unique(ids[s[g] : s[g] + k[g]], return_counts=True) for ids, s, k in ((self.a, start_a, self.size_a), (self.b, start_b, self.size_b)))
            more.append(((self.text_of_group[g] << 31 | a[:, None] << B_BITS | b).ravel(), np.outer(n, m).ravel()))
        if len(more) > 1:
            every, each = (np.concatenate(x) for x in zip(*more))
            keys, place = np.unique(every, return_inverse=True)
            links = np.zeros(len(keys), np.int64)
            np.add.at(links, place, each)
        return keys >> 31, keys & (1 << 31) - 1, links

    def written(self, table: list[str], ids_a: int) -> list[str]:
        """Each text's groups as ids, ``a1,a2|b1;a3|b2``; ``table``: see Pair.written, ``ids_a``: how many ids A has."""
        before_b, after_a = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a)
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (self.group_a, self.group_b))
        ids_b = len(table) // 2 - ids_a
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + np.where(last_a, ids_a, 0)
        order[np.arange(len(self.b)) + after_a[self.group_b]] = self.b + np.where(last_b, ids_b, 0) + 2 * ids_a
        parts = list(map(table.__getitem__, order.tolist()))
        ends = np.cumsum(self.n_tokens(0) + self.n_tokens(1)).tolist()
        return ["".join(parts[start:end])[:-1] for start, end in zip([0, *ends], ends)]

    def n_tokens(self, side: int) -> np.ndarray:
        return np.bincount((self.text_a, self.text_b)[side], minlength=self.texts)


def _packed(places: np.ndarray, links: np.ndarray) -> bytes:
    """Ascending places and the links of each."""
    both = np.stack([np.diff(places, prepend=0), links]).astype("<u4")
    return both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4")[..., 0].astype(np.int64)
    return np.cumsum(both[0]), both[1]


_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


class _Block:
    """Documents of a task and their distinct pairs, until there are enough of them."""

    def __init__(self) -> None:
        self.rows: list[pa.RecordBatch] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.texts = self.size = 0

    def add(self, ids: pa.Array, found: Aligned, one: Pair) -> None:
        texts, pairs, links = found.counted_pairs()
        groups = found.per_text(found.text_of_group, np.ones(found.groups, np.int64))
        n_links = found.per_text(found.text_of_group, found.size_a * found.size_b)
        measures = (found.n_tokens(0), found.n_tokens(1), groups, n_links, found.n_overlaps)
        hashes = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in found.written(one.written, len(one.bytes_a))]
        self.rows.append(pa.RecordBatch.from_arrays([ids, *[pa.array(m, pa.int64()) for m in measures], pa.array(hashes, pa.string())], names=["id", *_MEASURES, "groups_sha256"]))
        self.pairs.append((texts + self.texts, pairs, links))
        self.texts += found.texts
        self.size += len(pairs) + found.texts

    def flush(self, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The documents, then the block's pairs with how many of its documents have them."""
        if not self.texts:
            return
        texts, pairs, links = (np.concatenate(x) for x in zip(*self.pairs))
        known, place, docs = np.unique(pairs, return_inverse=True, return_counts=True)
        # Common pairs come first, so that a document's places lie close together.
        order = np.argsort(-docs, kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        place = rank[place]
        sort = np.argsort(texts << 32 | place, kind="stable")
        ends = np.searchsorted(texts, np.arange(1, self.texts + 1))
        place, links = place[sort], links[sort]
        squeeze = zstandard.ZstdCompressor(level=3).compress
        packed = [squeeze(_packed(place[i:j], links[i:j])) for i, j in zip([0, *ends], ends)]
        rows = pa.Table.from_batches(self.rows).append_column("packed", pa.array(packed, pa.binary()))
        cells = pa.table({"place": pa.array(np.arange(len(known)), pa.int32()), "pair": pa.array(known[order], pa.int64()), "docs": pa.array(docs[order], pa.int64())})
        for table in (rows, cells):
            table = table.append_column("block", pa.array([name] * table.num_rows, pa.string()))
            for field in schema:
                if field.name not in table.column_names:
                    table = table.append_column(field.name, pa.nulls(table.num_rows, field.type))
            yield from table.select(schema.names).cast(schema).to_batches(max_chunksize=20_000)
        self.__init__()


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= TEXT_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): measures of every row of ``docs``, and (a, b, docs, best) of every linked id pair.

    Documents have id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best and count_sum.  A null or
    empty text, and one that either tokenizer does not give back, has no tokens: zeros and an empty hash.
    Repeated rows count as documents of their own; ids may be null.  ``paths``: A's file, the same vocabulary
    as ranks, B's file.
    """
    spark, paths = docs.sparkSession, paths or default_paths()
    slim = long_texts(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    kind = slim.schema["id"].dataType.simpleString()
    columns = f"id {kind}, {', '.join(f'{m} long' for m in _MEASURES)}, groups_sha256 string, packed binary, block string, place int, pair long, docs long"

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, held, blocks = pair(*paths), _Block(), 0
        task, schema = TaskContext.get().partitionId(), None
        for batch in batches:
            if schema is None:
                long, text = pa.int64(), pa.string()
                schema = pa.schema([("id", batch.schema.field("id").type), *[(m, long) for m in _MEASURES], ("groups_sha256", text), ("packed", pa.binary()), ("block", text), ("place", pa.int32()), ("pair", long), ("docs", long)])
            texts = batch.column("text").to_pylist()
            for start, end in _chunks(texts):
                held.add(batch.column("id").slice(start, end - start), Aligned([one.tokens(t) for t in texts[start:end]], one.length_a, one.length_b), one)
                if held.size >= BLOCK_PAIRS:
                    yield from held.flush(f"{task}-{blocks}", schema)
                    blocks += 1
        yield from held.flush(f"{task}-{blocks}", schema)

    # The names of blocks are those of one run of each task: the table is written before it is read.
    folder = new_folder(spark, "alignment")
    slim.mapInArrow(tallied, columns).write.parquet(folder)
    rows, cells = (spark.read.schema(columns).parquet(folder).where(f"place is {which}") for which in ("null", "not null"))
    rows, cells = rows.select("block", "id", *_MEASURES, "groups_sha256", "packed"), cells.select("block", "place", "pair", "docs")
    counts = cells.groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = counts.withColumn("a", F.shiftright("pair", B_BITS))
    # One row for each id of A at most: the vocabulary bounds it.
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    counts = counts.join(F.broadcast(most), "a").select("pair", "a", "docs", (F.col("docs") == F.col("most")).alias("best"))
    back = cells.select("block", "place", "pair").join(counts.select("pair", "docs", "best"), "pair").select("block", "place", "docs", "best")

    def scored(rows: pa.Table, cells: pa.Table) -> pa.Table:
        count, best = np.zeros(cells.num_rows, np.int64), np.zeros(cells.num_rows, bool)
        place = cells.column("place").to_numpy()
        count[place], best[place] = cells.column("docs").to_numpy(), cells.column("best").to_numpy()
        open_up = zstandard.ZstdDecompressor().decompress
        found = []
        for raw in rows.column("packed").to_pylist():
            places, links = _unpacked(open_up(raw)) if raw else (place[:0], place[:0])
            found.append((int(links[best[places]].sum()), int((links * count[places]).sum())))
        n_best, count_sum = zip(*found) if found else ((), ())
        return rows.drop_columns(["block", "packed"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    done = f"id {kind}, {', '.join(f'{m} long' for m in _MEASURES)}, groups_sha256 string, n_best long, count_sum long"
    scores = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(scored, done)
    return scores, counts.select(F.col("a").cast("int").alias("a"), F.expr(f"cast(pair & {(1 << B_BITS) - 1} as int)").alias("b"), "docs", "best")


def groups(text: Column, paths: tuple[str, str, str] | None = None) -> Column:
    """array<struct<a array<int>, b array<int>, bytes int>>: the groups of a text, in order, as ids and their bytes."""
    paths = paths or default_paths()

    @pandas_udf("array<struct<a:array<int>,b:array<int>,bytes:int>>")
    def aligned_groups(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = pair(*paths)
        for texts in batches:
            out = []
            for text in texts:
                found = Aligned([one.tokens(text)], one.length_a, one.length_b)
                ends_a, ends_b = np.cumsum(found.size_a), np.cumsum(found.size_b)
                sides = (found.a, found.size_a, ends_a), (found.b, found.size_b, ends_b)
                a, b = ([ids[e - n : e].tolist() for n, e in zip(size, ends)] for ids, size, ends in sides)
                out.append([{"a": x, "b": y, "bytes": int(one.length_a[x].sum())} for x, y in zip(a, b)])
            yield pd.Series(out, dtype=object)

    return aligned_groups(text)
