"""Quality rules: isolation forests on rule statistics.

Each document gets the statistics that hand-written quality rules look at.  Trees of random splits are
grown on a few documents each, which are dealt out from half of all labelled ones; documents that a few
splits isolate are anomalous.  The path length up to which a document is rejected is calibrated on the
other half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.llm.common import WORD, long_texts, materialize, replaced

TREES = 200
#: Documents of a tree: few, so that bad ones that are alike do not hide each other.
TREE_DOCS = 64
#: Levels that a threshold has: labelled documents are counted at each.
LEVELS = 1 << 16
#: How many times worse it is to reject a good document than to keep a bad one.
GOOD_WEIGHT = 100

_WORDS = regex.compile(WORD)
_SYMBOLS = regex.compile(r"[#*$%&|<>]")
_MARKS = regex.compile(r"[!?]")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: All rule statistics, as rates or logarithms; each group has a forest of its own, as statistics that
#: tell nothing would outvote the others in a common one.
GROUPS = (("symbols", "marks", "word_length"), ("dup_lines", "repeat_words", "distinct", "log_words"))
FEATURES = tuple(f for group in GROUPS for f in group)
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def statistics(text: str | None) -> tuple[float, ...]:
    """The rule statistics of a whole text: COUNTS, then FEATURES (rates, comparable over lengths)."""
    text = text or ""
    words = _WORDS.findall(text)
    n = len(words)
    if not n:
        return (0, 0, len(_SYMBOLS.findall(text)), 0, 0, *[0.0] * len(FEATURES))
    chars = sum(map(len, words))
    ids: dict[str, int] = {}
    order = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    repeat = 0
    if n > 3:
        pairs = np.unique(order[:-1] * len(ids) + order[1:], return_inverse=True)[1]
        _, at, times = np.unique(pairs[:-1] * len(ids) + order[2:], return_inverse=True, return_counts=True)
        starts = times[at] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : k + len(starts)] |= starts
        repeat = int(covered.sum())
    lines = [line for line in text.split("\n") if _WORDS.search(line)]
    duplicates = len(lines) - len(set(lines))
    symbols = len(_SYMBOLS.findall(text))
    rates = (symbols / n, len(_MARKS.findall(text)) / n, chars / n, duplicates / max(1, len(lines)), repeat / n, len(ids) / n, float(np.log(n)))
    return (n, chars, symbols, duplicates, repeat, *rates)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``rules``, the statistics of each text (null: an empty text)."""

    @pandas_udf(SCHEMA)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=COUNTS + FEATURES)

    return replaced(long_texts(docs), rules=rules(F.col(f"`{text_col}`")))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, rules) of each document, computed once: its id, a hash of its text and its statistics."""
    rows = with_statistics(docs, text_col)
    return materialize(rows.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), "rules"))


def base_failed(rules: str) -> Column:
    """The plain rules: under 50 words, or over half of the words in repeated windows."""
    words, repeats = F.col(f"{rules}.n_words"), F.col(f"{rules}.n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n``: the unit of path lengths."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(data: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree as arrays (feature or -1, split, left child; the right one follows it, path at leaf)."""
    limit = int(np.ceil(np.log2(max(len(data), 2))))
    feature, split, child, path = [], [], [], []
    queue = [(data, 0)]
    while len(feature) < len(queue):
        rows, depth = queue[len(feature)]
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(data.shape[1]),) * 2
        open_ = np.flatnonzero(high > low)
        if depth >= limit or not len(open_):
            feature.append(-1), split.append(0.0), child.append(0), path.append(depth + float(average_path(len(rows))))
            continue
        f = int(rng.choice(open_))
        s = rng.uniform(low[f], high[f])
        feature.append(f), split.append(s), child.append(len(queue)), path.append(0.0)
        queue += [(rows[rows[:, f] < s], depth + 1), (rows[rows[:, f] >= s], depth + 1)]
    return np.array(feature), np.array(split), np.array(child), np.array(path)


@dataclass
class Forest:
    trees: list[tuple[np.ndarray, ...]]
    unit: float
    #: Documents with a higher anomaly score are rejected.
    threshold: float

    def score(self, data: np.ndarray) -> np.ndarray:
        """Anomaly score in 0..1: 2 to the minus mean path in units."""
        total = np.zeros(len(data))
        rows = np.arange(len(data))
        for feature, split, child, path in self.trees:
            at = np.zeros(len(data), dtype=np.int64)
            while (f := feature[at]).max(initial=-1) >= 0:
                at = np.where(f < 0, at, child[at] + (data[rows, np.maximum(f, 0)] >= split[at]))
            total += path[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / self.unit)


def fit_forest(data: np.ndarray, quality: np.ndarray, judged: np.ndarray, seed: int = 11) -> Forest:
    """Grow trees on samples of one half of ``data``; the other calibrates the threshold by ``quality`` (1 good, 0 bad).

    Only ``judged`` rows, which pass the plain rules, calibrate.  The threshold is the score with the
    best balance of bad rows found against good rows rejected, ``GOOD_WEIGHT`` to one; of equals the
    highest.  Without good or bad rows nothing is rejected.
    """
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(data)) % 2 == 1
    grown = data[~held]
    forest = plant([grown[rng.choice(len(grown), min(TREE_DOCS, len(grown)), replace=False)] for _ in range(TREES if len(grown) else 0)], rng)
    scores, good = forest.score(data[held & judged]), quality[held & judged]
    levels, at = np.unique(np.concatenate([scores, [1.0]]), return_inverse=True)
    count = lambda q: np.bincount(at[:-1][good == q], minlength=len(levels))
    forest.threshold = calibrated(levels, count(1), count(0))
    return forest


def plant(samples: list[np.ndarray], rng: np.random.Generator) -> Forest:
    """A tree for each sample; nothing is rejected yet."""
    return Forest([grow(rows, rng) for rows in samples], float(average_path(max(2, max(map(len, samples), default=0)))), 1.0)


def calibrated(levels: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold among ``levels`` (ascending, the last one 1), at which so many good and bad rows have their score."""
    if not good.sum() or not bad.sum():
        return 1.0
    found, rejected = 1 - bad.cumsum() / bad.sum(), 1 - good.cumsum() / good.sum()
    balance = found - GOOD_WEIGHT * rejected
    return float(levels[np.flatnonzero(balance >= balance.max() - 1e-12).max()])


@dataclass
class Forests:
    """A forest for each group of statistics."""

    forests: list[Forest]

    def judge(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(highest anomaly score, whether no forest rejects) of each row of FEATURES."""
        ends = np.cumsum([len(g) for g in GROUPS])
        scores = [f.score(part) for f, part in zip(self.forests, np.split(data, ends[:-1], axis=1))]
        normal = [s <= f.threshold for f, s in zip(self.forests, scores)]
        return np.max(scores, axis=0), np.all(normal, axis=0)


def fit_groups(data: np.ndarray, quality: np.ndarray, judged: np.ndarray) -> Forests:
    """Fit the groups in turn; rows that one rejects no longer calibrate the next."""
    ends = np.cumsum([len(g) for g in GROUPS])
    found = []
    for part in np.split(data, ends[:-1], axis=1):
        found.append(fit_forest(part, quality, judged))
        judged = judged & (found[-1].score(part) <= found[-1].threshold)
    return Forests(found)


def dealt(rows: DataFrame) -> list[np.ndarray]:
    """The documents of each tree, out of all ``rows`` (id, f): each is dealt to so many trees that all get theirs, and a tree takes those with the smallest hashes."""
    n = rows.count()
    copies = min(TREES, 2 * TREES * TREE_DOCS // max(1, n) + 1)
    tree = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    trees = rows.select("id", "f", tree.alias("tree")).withColumn("tree", F.pmod(F.xxhash64("id", F.lit("tree")) + F.col("tree"), F.lit(TREES)))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("order", "id"))
    found = trees.withColumn("order", F.xxhash64("id", "tree")).withColumn("place", place).where(F.col("place") <= TREE_DOCS)
    parts: dict[int, list] = {}
    for r in sorted(found.select("tree", "place", "f").collect()):
        parts.setdefault(r.tree, []).append(r.f)
    return [np.array(part, dtype=float) for part in parts.values()]


def scored(rows: DataFrame, forest: Forest, features: slice) -> DataFrame:
    """``rows`` with ``score`` of those ``features`` of ``f``."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(shared.value.score(np.array(values.tolist(), dtype=float).reshape(-1, len(FEATURES))[:, features]))

    return rows.withColumn("score", score("f"))


def fit_measured(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> Forests:
    """Forests from all labelled documents of ``rows`` (id, h, rules): one half grows the trees, the other calibrates.

    Of an id with several labels the least counts, of several texts the one with the smallest hash.  The driver gets
    the documents of the trees, and for each group of statistics a count at each of so many ``LEVELS``.
    """
    labelled = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{quality_col}`").alias("q")).where("id is not null and q is not null").groupBy("id").agg(F.min("q").alias("q"))
    once = rows.join(labelled, "id").groupBy("id", "q").agg(F.min_by("rules", "h").alias("rules"))
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(2)) == 1
    once = materialize(once.select("id", "q", held.alias("held"), base_failed("rules").alias("failed"), F.array(*[F.col(f"rules.{c}") for c in FEATURES]).alias("f")))
    samples = dealt(once.where("not held"))
    judged = once.where("held and not failed")
    forests, start = [], 0
    for group in GROUPS:
        features = slice(start, start := start + len(group))
        forest = plant([part[:, features] for part in samples], np.random.default_rng(11))
        judged = scored(judged, forest, features)
        counts = judged.groupBy(F.ceil(F.col("score") * LEVELS).alias("level")).agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") == 0).alias("bad")).collect()
        levels, good, bad = np.array([*sorted(map(tuple, counts)), (LEVELS, 0, 0)]).T
        forest.threshold = calibrated(levels / LEVELS, good, bad)
        judged = judged.where(F.col("score") <= forest.threshold)
        forests.append(forest)
    return Forests(forests)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> Forests:
    """``fit_measured`` on the statistics of ``docs``."""
    return fit_measured(measured(docs, id_col, text_col), labels, id_col, quality_col)


def judge_measured(rows: DataFrame, forests: Forests) -> DataFrame:
    """``rows`` with ``verdict``, from their statistics ``rules``."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    @pandas_udf("anomaly double, normal boolean")
    def verdict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rules in batches:
            anomaly, normal = shared.value.judge(rules[list(FEATURES)].to_numpy(float))
            yield pd.DataFrame({"anomaly": anomaly, "normal": normal})

    return rows.withColumn("verdict", verdict("rules"))


def judge(docs: DataFrame, forests: Forests, text_col: str = "text") -> DataFrame:
    """``docs`` with ``verdict``: the statistics, ``anomaly`` and ``normal`` (false: rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(forests)

    @pandas_udf(SCHEMA + ", anomaly double, normal boolean")
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([statistics(t) for t in texts], columns=COUNTS + FEATURES)
            anomaly, normal = shared.value.judge(out[list(FEATURES)].to_numpy(float))
            yield out.assign(anomaly=anomaly, normal=normal)

    return replaced(long_texts(docs), verdict=verdict(F.col(f"`{text_col}`")))
