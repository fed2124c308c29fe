"""Byte-level BPE encoding and decoding of whole texts.

Token bytes are mapped to Latin-1 and put into an Aho-Corasick automaton.  Each pre-token takes the
longest match at every position and backtracks to shorter ones where two adjacent tokens could not
both come out of the merges; whether they can is memoised by pair.  A chain of compatible tokens is
the result of the merges, so the outcome is exact, in time linear in the pre-token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Pre-tokens and pairs in one generation of a worker's memo; two generations are held.
MEMO_PIECES = 40_000
#: Longer pre-tokens are encoded each time.
MEMO_CHARS = 64

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def default_vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Encoder and decoder of one vocabulary file (base64 token, rank on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = list(map(len, self.tokens))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        #: The two tokens a token is merged from; a byte has none.
        self.halves: list[tuple[int, int] | None] = [None] * len(self.tokens)
        self.automaton = ahocorasick.Automaton()
        # A token that its own merges do not rebuild only stands for a whole pre-token.
        usable = [rank for rank, token in enumerate(self.tokens) if token and self._halve(rank)]
        for rank in usable:
            self.automaton.add_word(self.tokens[rank].decode("latin-1"), rank)
        self.automaton.make_automaton()
        #: The longest usable token that a token starts with, itself left out; -1: none.
        self.shorter = [-1] * len(self.tokens)
        known = set(usable)
        for rank in usable:
            token = self.tokens[rank]
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n], -1)) in known), -1)

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """The merges themselves, lowest rank first, of ranks under ``below``; for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halve(self, rank: int) -> bool:
        """Find the halves of a token; whether its merges rebuild it."""
        if self.lengths[rank] == 1:
            return True
        halves = self.merged(self.tokens[rank], below=rank)
        if len(halves) != 2:
            return False
        self.halves[rank] = (halves[0], halves[1])
        return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether both tokens can stand side by side, memoised."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMO_PIECES:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo the later of the two sides' last merges, again and again: whenever the tokens that then
        touch would have merged before that, the boundary would not have survived."""
        undone = 1 << 60
        while True:
            if self.ranks.get(self.tokens[left] + self.tokens[right], undone) < undone:
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            # Of equal ranks the left one is merged first, so the right one is undone first.
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        longest = [-1] * len(raw)
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        for end, rank in self.automaton.iter(piece if len(raw) == len(piece) else raw.decode("latin-1")):
            longest[end - lengths[rank] + 1] = rank  # of those that start there, the longest ends last
        chain: list[int] = []
        dead = bytearray(len(raw) + 1)  # ends that led nowhere
        at, last, token = 0, -1, longest[0]
        while True:
            while token >= 0:
                end = at + lengths[token]
                if not dead[end] and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                chain.append(token)
                if end == len(raw):
                    return chain
                at, last, token = end, token, longest[end]
            else:
                dead[at] = 1
                token = chain.pop()
                at -= lengths[token]
                last, token = (chain[-1] if chain else -1), shorter[token]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        known, out = self.pieces, []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = np.array(self.encode_piece(piece), dtype="<u4").tobytes()
                if len(piece) <= MEMO_CHARS:
                    if len(known) >= MEMO_PIECES:
                        self.older, self.pieces = known, {}
                        known = self.pieces
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file; a Python worker builds it once."""
    return Encoder(path)


def encode(text: Column, path: str | None = None) -> Column:
    """Token ids of ``text`` as packed little-endian unsigned 32-bit integers; null is an empty text.

    The vocabulary file is read on every worker; by default it is the installed public one.
    """
    path = path or default_vocabulary()

    @pandas_udf("binary")
    def bpe_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder(path).encode
        for texts in batches:
            yield pd.Series([one(t or "") for t in texts], dtype=object)

    return bpe_encode(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes that packed token ids stand for; null decodes to nothing."""
    path = path or default_vocabulary()

    @pandas_udf("binary")
    def bpe_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder(path).decode
        for packed in batches:
            yield pd.Series([one(bytes(p or b"")) for p in packed], dtype=object)

    return bpe_decode(ids)


def encode_decode(text: Column, path: str | None = None) -> Column:
    """struct<ids,decoded>: ``encode`` and ``decode`` of its result in one pass of one Python worker."""
    path = path or default_vocabulary()

    @pandas_udf("ids binary, decoded binary")
    def bpe_both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for texts in batches:
            ids = [bpe.encode(t or "") for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    return bpe_both(text)
