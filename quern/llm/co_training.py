"""Quality classifier by co-training of a text view and a metadata view.

One logistic regression sees only the text (hashed byte trigrams and rates), the other only the
metadata (language, source, length).  In each round either view labels the pool documents it is most
sure of, for the other view to learn from, as far as such labels prove right on documents held back.  Both are then calibrated, and their calibrated log odds
are combined to score all documents.

The classifiers are fitted on a bounded sample of labelled documents: a part of it is the seed, a part
the pool whose labels are withheld, a part calibrates, and a part sets the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.llm.common import long_texts, one_text_each, replaced

#: Labelled documents in the sample at most (the smallest hashes of ids).
SAMPLE_DOCS = 4000
BUCKETS = 1024
META_BUCKETS = 64
ROUNDS = 4
#: Documents whose labels the views start from; those of the others in the sample are withheld.
SEED_DOCS = 1500
#: Pool documents of a class that a view labels in a round; how sure it must be, and how often right when it is,
#: on at least so many documents held back.
PER_ROUND = 100
SURE = 0.97
PROVEN = 10
#: How many times worse it is to reject a good document than to keep a bad one.
GOOD_WEIGHT = 20


def text_view(text: str | None) -> np.ndarray:
    """Square roots of hashed trigram rates, then rates of character kinds and of immediate repeats."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(BUCKETS + 6, dtype=np.float32)
    if len(raw) < 3:
        return out
    b = raw.astype(np.uint32)
    grams = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(22)
    out[:BUCKETS] = np.sqrt(np.bincount(grams, minlength=BUCKETS) / len(grams))
    kinds = np.bincount(raw, minlength=256)
    upper, lower, digit, space = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum(), kinds[9:14].sum() + kinds[32]
    words = (text or "").split()
    repeats = sum(map(str.__eq__, words, words[1:])) / max(1, len(words))
    rest = len(raw) - upper - lower - digit - space - kinds[128:].sum()
    out[BUCKETS:] = (upper / len(raw), digit / len(raw), rest / len(raw), repeats, len(set(words)) / max(1, len(words)) ** 0.8, space / len(raw))
    return out


def meta_view(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed language and source, and the length in octaves; nulls are values of their own."""
    out = np.zeros(2 * META_BUCKETS + 24, dtype=np.float32)
    out[xxhash.xxh64_intdigest(repr(lang)) % META_BUCKETS] = 1
    out[META_BUCKETS + xxhash.xxh64_intdigest(repr(source)) % META_BUCKETS] = 1
    length = 0 if n_chars is None or n_chars != n_chars else min(22, 1 + int(max(0, n_chars)).bit_length())
    out[2 * META_BUCKETS + length] = 1
    return out


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    #: Calibration of the log odds.
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * ((x - self.mean) / self.scale @ self.weights + self.bias) + self.shift


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent."""
    rate = 4.0 / (np.linalg.norm(x, 2) ** 2 / len(x) + 1 + 4 * ridge)
    w = ahead = np.zeros(x.shape[1] + 1)
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30)))
        gradient = np.append(x.T @ (p - y) / len(x) + ridge * ahead[:-1], (p - y).mean())
        w, last = ahead - rate * gradient, w
        ahead = w + step / (step + 3) * (w - last)
    return w[:-1], float(w[-1])


def fit_view(x: np.ndarray, y: np.ndarray, ridge: float) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    w, b = _logistic((x - mean) / scale, y, ridge)
    return View(mean, scale, w, b)


@dataclass
class Model:
    text: View
    meta: View
    weights: np.ndarray
    bias: float
    #: Documents with a lower probability are rejected.
    keep_from: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by text, by metadata, combined."""
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, self.weights[0] * a + self.weights[1] * b + self.bias))


def co_train(text: np.ndarray, meta: np.ndarray, quality: np.ndarray, rounds: int = ROUNDS, seed_rows: int = SEED_DOCS) -> Model | None:
    """Fit on the rows' views; None if good or bad rows are missing where they are needed.

    Every fourth row is held back: of those, half calibrate the log odds and half set the threshold (all do
    both, where a half has no good or no bad row).  Of the others ``seed_rows`` (two thirds of them at most) are the seed; the labels of the rest are withheld.
    ``rounds`` = 0 gives the classifiers of the seed alone.
    """
    at = np.arange(len(quality))
    held, limit, free = np.flatnonzero(at % 8 == 3), np.flatnonzero(at % 8 == 7), np.flatnonzero(at % 4 != 3)
    seed, pool = np.split(free, [min(seed_rows, -(-2 * len(free) // 3))])
    if any(len(np.unique(quality[x])) < 2 for x in (held, limit)):
        held = limit = np.flatnonzero(at % 4 == 3)
    if any(len(np.unique(quality[x])) < 2 for x in (seed, held, limit)):
        return None
    views, ridges = (text, meta), (0.01, 0.05)
    rows, marks, free = [seed, seed], [quality[seed].astype(float)] * 2, [pool, pool]
    for _ in range(rounds):
        fitted = [fit_view(views[v][rows[v]], marks[v], ridges[v]) for v in (0, 1)]
        for v in (0, 1):
            other, odds = 1 - v, lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            p, checked = odds(fitted[v].log_odds(views[v][free[other]])), odds(fitted[v].log_odds(views[v][held]))
            chosen = []
            for mark, sure, proof in ((1, p, checked), (0, 1 - p, 1 - checked)):
                # A view is heard on a class only if it is right where it is sure.
                told = quality[held][proof >= SURE]
                if len(told) >= PROVEN and (told == mark).mean() >= SURE:
                    best = np.argsort(-sure, kind="stable")[:PER_ROUND]
                    chosen.append(best[sure[best] >= SURE])
            taken = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            rows[other] = np.concatenate([rows[other], free[other][taken]])
            marks[other] = np.concatenate([marks[other], (p[taken] > 0.5).astype(float)])
            free[other] = np.delete(free[other], taken)
    fitted = [fit_view(views[v][rows[v]], marks[v], ridges[v]) for v in (0, 1)]
    for v, view in enumerate(fitted):
        odds = view.log_odds(views[v][held])
        w, b = _logistic(odds[:, None], quality[held].astype(float), 1e-3)
        view.slope, view.shift = max(0.0, float(w[0])), b
    both = np.stack([fitted[v].log_odds(views[v][held]) for v in (0, 1)], axis=1)
    w, b = _logistic(both, quality[held].astype(float), 1e-3)
    model = Model(fitted[0], fitted[1], w, b, 0.0)
    p = model.scores(text[limit], meta[limit])[2]
    good, bad = np.sort(p[quality[limit] == 1]), np.sort(p[quality[limit] == 0])
    levels = np.unique(np.concatenate([[0.0], p]))
    balance = np.searchsorted(bad, levels) / len(bad) - GOOD_WEIGHT * np.searchsorted(good, levels) / len(good)
    # Halfway down to the next lower score: a good document may score a little less than these.
    best = int(np.flatnonzero(balance >= balance.max() - 1e-12).min())
    model.keep_from = float(levels[best] + levels[max(0, best - 1)]) / 2
    return model


def _views(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    meta = [meta_view(*x) for x in zip(lang, source, n_chars)]
    return np.stack([text_view(t) for t in text]), np.stack(meta)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fit on at most ``sample_docs`` labelled documents; None where good or bad ones are missing."""
    sampled = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{quality_col}`").alias("q")).where("id is not null and q is not null")
    sampled = sampled.groupBy("id").agg(F.min("q").alias("q")).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    rows = one_text_each(long_texts(docs), sampled, id_col, text_col, *_meta_columns(docs))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                text, meta = _views(batch["text"], batch["lang"], batch["source"], batch["n_chars"])
                yield pd.DataFrame({"id": batch["id"], "q": batch["q"], "t": [r.tobytes() for r in text], "m": [r.tobytes() for r in meta]})

    found = rows.mapInPandas(features, "id long, q int, t binary, m binary").collect()
    found = sorted((xxhash.xxh64_intdigest(str(r.id)), r.id, bytes(r.t), bytes(r.m), r.q) for r in found)
    if not found:
        return None
    text, meta = (np.stack([np.frombuffer(r[k], np.float32) for r in found]).astype(float) for k in (2, 3))
    return co_train(text, meta, np.array([r[4] for r in found]))


def _meta_columns(docs: DataFrame) -> list:
    """lang, source and n_chars, null where the table has no such column."""
    kinds = {"lang": "string", "source": "string", "n_chars": "double"}
    return [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]


def classify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality`` struct<by_text,by_meta,score,kept>; a column of that name is replaced.

    Null and empty texts are scored like any other.  Without a model everything scores 0.5 and is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("by_text double, by_meta double, score double, kept boolean")
    def quality(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for columns in batches:
            out = pd.DataFrame(0.5, index=range(len(columns[0])), columns=["by_text", "by_meta", "score"])
            for start in range(0, len(out) if model else 0, 256):
                scores = model.scores(*_views(*(c.iloc[start : start + 256] for c in columns)))
                out.iloc[start : start + 256] = np.stack(scores, axis=1)
            yield out.assign(kept=out["score"] >= (model.keep_from if model else 0.0))

    return replaced(long_texts(docs), quality=quality(F.col(f"`{text_col}`"), *_meta_columns(docs)))
