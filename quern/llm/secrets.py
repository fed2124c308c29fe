"""Secret scan by grammar inference.

Rules with known keywords and prefixes label credentials.  Their strings form a prefix tree, whose
states are merged wherever their statistics are compatible (Hoeffding bounds); the result is a
probabilistic automaton for each format.  Its moves are by classes of characters, and each move also knows
how often which character made it, so literal prefixes are learned.  Every candidate token of every text
is then scored by its likelihood under each format against ordinary words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log2, sqrt

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.llm.common import WORD, long_texts, replaced, smallest

#: Labelled credentials of a kind, and ordinary words of so many texts, that the automata learn from at most.  The first
#: are ranked within their kind: up to a thousand Spark cuts them before the shuffle, more would meet in three tasks.
SAMPLE_CREDENTIALS = 600
SAMPLE_WORDS = 3000
SAMPLE_WORD_DOCS = 300
#: Longer credentials are scored, but not learned from.
LEARNED_CHARS = 256
#: Counts that a move's characters are taken to have had before any was seen.
BACKOFF = 4.0
#: Confidence parameter of the merge test.
ALPHA = 0.05
#: Share of the labelled credentials that may fall below the threshold, and what lies above all words.
MISSED_SHARE = 0.02
MARGIN = 0.25
#: The shortest labelled credential; every token of so many characters is scored.
CANDIDATE_CHARS = 6

#: The base rules; kinds in the order of the output.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

_ASSIGN = regex.compile(ASSIGN, regex.ASCII)
_ACCESS = regex.compile(ACCESS)
_HEX = regex.compile(HEX)
_CANDIDATE = regex.compile(rf"[A-Za-z0-9+/_.=-]{{{CANDIDATE_CHARS},}}")

#: Classes of characters; a character that a move has not seen shares what is left with the others of its class.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-")
_CLASS_OF = {c: k for k, chars in enumerate(CLASSES) for c in chars}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans by start, then kind; (kind, start, end) in code points."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class Automaton:
    """Arrivals, endings and {symbol: (state, count, {character: count})} of each state; state 0 starts."""

    arrivals: list[int]
    endings: list[int]
    moves: list[dict[int, tuple[int, int, dict[str, int]]]]

    def bits(self, token: str) -> float:
        """log2 of the probability of a token, unseen moves at a tenth of a count."""
        state, total, kinds = 0, 0.0, len(CLASSES) + 1
        for character in token:
            symbol = _CLASS_OF[character]
            n = self.arrivals[state] if state is not None else 0
            following, count, seen = self.moves[state].get(symbol, (None, 0, {})) if state is not None else (None, 0, {})
            likely = (seen.get(character, 0) + BACKOFF / len(CLASSES[symbol])) / (count + BACKOFF)
            total += log2((count + 0.1) / (n + 0.1 * kinds)) + log2(likely)
            state = following
        n, ended = (self.arrivals[state], self.endings[state]) if state is not None else (0, 0)
        return total + log2((ended + 0.1) / (n + 0.1 * kinds))


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge statistically compatible states of the strings' prefix tree, breadth first."""
    arrivals, endings, moves = [0], [0], [{}]
    for string in strings:
        state = 0
        arrivals[0] += 1
        for character in string:
            symbol = _CLASS_OF[character]
            if symbol not in moves[state]:
                moves[state][symbol] = [len(arrivals), 0, Counter()]
                arrivals.append(0), endings.append(0), moves.append({})
            moves[state][symbol][1] += 1
            moves[state][symbol][2][character] += 1
            state = moves[state][symbol][0]
            arrivals[state] += 1
        endings[state] += 1
    bound = sqrt(0.5 * log(2 / alpha))

    def alike(n: int, a: int, m: int, b: int) -> bool:
        return abs(a / n - b / m) < bound * (1 / sqrt(n) + 1 / sqrt(m))

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = arrivals[a], arrivals[b]
            if not alike(n, endings[a], m, endings[b]):
                return False
            for symbol in moves[a].keys() | moves[b].keys():
                to_a, count_a, _ = moves[a].get(symbol, (None, 0, None))
                to_b, count_b, _ = moves[b].get(symbol, (None, 0, None))
                if not alike(n, count_a, m, count_b):
                    return False
                if to_a is not None and to_b is not None and to_a != to_b:
                    stack.append((to_a, to_b))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            arrivals[a] += arrivals[b]
            endings[a] += endings[b]
            for symbol, (to, count, seen) in moves[b].items():
                if symbol in moves[a]:
                    moves[a][symbol][1] += count
                    moves[a][symbol][2] += seen
                    stack.append((moves[a][symbol][0], to))
                else:
                    moves[a][symbol] = [to, count, Counter(seen)]

    red, at = [0], 0
    frontier = [(0, s) for s in sorted(moves[0])]
    settled = {0}
    while at < len(frontier):
        parent, symbol = frontier[at]
        at += 1
        blue = moves[parent][symbol][0]
        if blue in settled:
            continue
        for state in red:
            if compatible(state, blue):
                moves[parent][symbol][0] = state
                fold(state, blue)
                frontier += [(r, s) for r in red for s in sorted(moves[r]) if moves[r][s][0] not in settled and (r, s) not in frontier[at:]]
                break
        else:
            red.append(blue)
            settled.add(blue)
            frontier += [(blue, s) for s in sorted(moves[blue])]
    number = {state: k for k, state in enumerate(red)}
    kept = [{s: (number[to], n, dict(seen)) for s, (to, n, seen) in moves[r].items()} for r in red]
    return Automaton([arrivals[r] for r in red], [endings[r] for r in red], kept)


def numbers(seed: int = 11) -> list[str]:
    """Ordinary numbers, as a sample of texts hardly has them: runs of digits of every length, dates, groups, amounts."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    made = [digits(n) for n in range(CANDIDATE_CHARS, 65) for _ in range(4)] + [digits(n) for n in range(65, LEARNED_CHARS, 8)]
    for _ in range(40):
        year, month, day = rng.integers(1900, 2100), rng.integers(1, 13), rng.integers(1, 29)
        made += [f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{year}/{month:02}/{day:02}", f"{year}{month:02}{day:02}T{digits(6)}Z", f"{digits(int(rng.integers(1, 9)))}.{digits(int(rng.integers(1, 5)))}"]
        for sizes in ((4, 4, 4, 4), (3, 2, 4), (3, 3, 4), (4, 6, 5), (2, 3, 3, 3)):
            made += [mark.join(map(digits, sizes)) for mark in "-./"]
    return sorted(set(made))


#: What a token can have for evidence.
_EVIDENCE = {"letter": regex.compile("[A-Za-z]").search, "digit": regex.compile("[0-9]").search}


@dataclass
class Grammar:
    formats: dict[str, Automaton]
    words: Automaton
    thresholds: dict[str, float]
    #: What nearly all labelled credentials of a format have: a token without it has another format.
    evidence: dict[str, tuple[str, ...]]

    def score(self, token: str) -> dict[str, float]:
        """Bits per character that each format explains a token better than words do."""
        plain = self.words.bits(token)
        return {k: (a.bits(token) - plain) / max(1, len(token)) for k, a in self.formats.items()}

    def secret(self, token: str) -> bool:
        likely = [k for k in self.formats if all(_EVIDENCE[e](token) for e in self.evidence[k])]
        return bool(likely) and any(s >= self.thresholds[k] for k, s in self.score(token).items() if k in likely)


def learn(credentials: dict[str, list[str]], words: list[str]) -> Grammar:
    """Automata of the labelled credentials; thresholds that no ordinary word or number reaches."""
    # A word is ordinary in any case of its letters.
    usable = sorted({v for w in words if all(c in _CLASS_OF for c in w) for v in (w, w.upper(), w.capitalize())} | set(numbers()))
    formats = {k: infer(vs) for k, vs in credentials.items() if vs}
    evidence = {k: tuple(e for e, there in _EVIDENCE.items() if sum(map(bool, map(there, credentials[k]))) >= (1 - MISSED_SHARE) * len(credentials[k])) for k in formats}
    grammar = Grammar(formats, infer(usable), {}, evidence)
    of_words = [(w, grammar.score(w)) for w in usable if len(w) >= CANDIDATE_CHARS]
    for kind in grammar.formats:
        own = [grammar.score(v)[kind] for v in credentials[kind]]
        likely = [s[kind] + MARGIN for w, s in of_words if all(_EVIDENCE[e](w) for e in evidence[kind])]
        grammar.thresholds[kind] = max([float(np.quantile(own, MISSED_SHARE)), *likely])
    return grammar


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_CREDENTIALS, sample_words: int = SAMPLE_WORDS, sample_word_docs: int = SAMPLE_WORD_DOCS) -> Grammar:
    """Learn from at most ``sample`` credentials of each kind that the rules label, and ``sample_words`` ordinary words
    of ``sample_word_docs`` texts (smallest hashes; repeats count once)."""
    text = F.col(f"`{text_col}`")

    def values(kind: str, pattern: str, group: int, least: int):
        usable = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.char_length(v).between(least, LEARNED_CHARS))
        return F.transform(usable, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(values("assign", ASSIGN, 2, ASSIGN_CHARS), values("access", ACCESS, 0, ACCESS_CHARS), values("hex", HEX, 0, HEX_CHARS))
    labelled = docs.where(text.rlike("AKIA|[:=]|[0-9a-f]{24}")).select(F.explode(found).alias("c")).select("c.*").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    credentials: dict[str, list[str]] = {k: [] for k in KINDS[:3]}
    for r in labelled.withColumn("place", place).where(F.col("place") <= sample).collect():
        credentials[r.kind].append(r.value)
    few = smallest(docs.select(text.alias("text")).where("text is not null"), F.xxhash64("text"), sample_word_docs)
    words = few.distinct().select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).where(~F.col("word").rlike("[0-9:=]") | F.col("word").rlike("^[0-9]+$")).distinct()
    words = words.orderBy(F.xxhash64("word"), "word").limit(sample_words).collect()
    return learn({k: sorted(v) for k, v in credentials.items()}, sorted(r.word for r in words))


def scan_text(text: str | None, grammar: Grammar, known: dict[str, bool] | None = None) -> list[tuple[str, int, int]]:
    """All spans of a whole text by start, then kind: the rules' and those of learned formats.

    ``known`` keeps verdicts on tokens between calls.
    """
    if not text:
        return []
    spans = base_spans(text)
    learned = []
    known = {} if known is None else known
    for m in _CANDIDATE.finditer(text):
        token = m.group()
        if (secret := known.get(token)) is None:
            secret = known[token] = grammar.secret(token)
        if secret and not any(s < m.end() and m.start() < e for _, s, e in spans):
            learned.append(("learned", m.start(), m.end()))
    return sorted(spans + learned, key=lambda s: (s[1], KINDS.index(s[0]))) if learned else spans


def find_secrets(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets`` array<struct<kind,start,end>>, by start, then kind as listed.

    Spans of one kind do not overlap; ``learned`` spans overlap no other.  Null texts have none; an
    input column named ``secrets`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, bool] = {}
        for texts in batches:
            if len(known) > 500_000:
                known.clear()
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t, shared.value, known)] for t in texts], dtype=object)

    return replaced(long_texts(docs), secrets=scan(F.col(f"`{text_col}`")))
