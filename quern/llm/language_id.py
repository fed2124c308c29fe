"""Language identification with averaged hashed subword embeddings and a linear softmax.

Character n-grams (2 to 4, of letters in lower case, anything else a word end) are hashed; the mean of
their embeddings goes through a linear softmax.  Both are trained together by stochastic gradient
descent in numpy on a bounded sample.  A part of the sample is kept back to calibrate the probability
(a temperature) and the rejection threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.llm.common import long_texts, replaced

#: Different texts that the model learns from at most, for each language (the smallest hashes of texts) and in all.
#: They are ranked within their language: up to a thousand Spark cuts them before the shuffle.
SAMPLE_DOCS, SAMPLE_TOTAL = 700, 6000
#: Languages that it tells apart at most, the commonest ones; the last stands for all others.
MAX_LANGUAGES = 200
BUCKETS = 1 << 14
WIDTH = 16
NGRAMS = (2, 3, 4)
#: Share of accepted calibration documents that must be right.
ACCEPTED_ACCURACY = 0.99

UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def subwords(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs in the whole text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters()[points]
    if not letters.any():
        return None
    points = np.concatenate([[32], np.where(letters, points, 32), [32]]).astype(np.uint64)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    rolled = points
    for n in range(2, max(NGRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n in NGRAMS:
            counts += np.bincount(((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return counts


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    #: The language that stands for the rare ones, if there are any: its predictions are rejected.
    rare: str | None = None

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        mean = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return _softmax((mean @ self.embedding @ self.softmax + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 1.5, seed: int = 7) -> Model:
    """A model from (language, buckets, counts) of each sampled document; every fifth calibrates."""
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(r[0]) for r in rows])
    calibrate = np.arange(len(rows)) % 5 == 4
    if calibrate.sum() < 5:
        calibrate[:] = False

    def dense(at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), BUCKETS), dtype=np.float32)
        for k, i in enumerate(at):
            out[k, rows[i][1]] = rows[i][2] / max(1, rows[i][2].sum())
        return out

    embedding = rng.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    fit = np.flatnonzero(~calibrate)
    steps, done = epochs * -(-len(fit) // 32), 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), -(-len(fit) // 32)):
            step = rate * (1 - done / steps)
            x = dense(batch)
            hidden = x @ embedding
            error = _softmax(hidden @ softmax + bias)
            error[np.arange(len(batch)), target[batch]] -= 1
            error /= len(batch)
            back = error @ softmax.T
            softmax -= step * hidden.T @ error
            bias -= step * error.sum(axis=0)
            # The mean spreads a gradient over thousands of buckets; its step makes up for that.
            embedding -= step * 50 * (x.T @ back)
            done += 1
    model = Model(languages, embedding, softmax, bias, 1.0, 0.0)
    held = np.flatnonzero(calibrate)
    if len(held):
        logits = np.concatenate([dense(held[i : i + 256]) @ embedding @ softmax + bias for i in range(0, len(held), 256)])
        losses = [(-np.log(_softmax(logits / t)[np.arange(len(held)), target[held]] + 1e-12).mean(), t) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)]
        model.temperature = min(losses)[1]
        p = _softmax(logits / model.temperature)
        sure, right = p.max(axis=1), p.argmax(axis=1) == target[held]
        order = np.argsort(-sure)
        good = np.cumsum(right[order]) / np.arange(1, len(held) + 1) >= ACCEPTED_ACCURACY
        model.reject_below = float(sure[order][np.flatnonzero(good).max()]) if good.any() else 1.0
        if good.all():
            model.reject_below = 0.0
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_total: int = SAMPLE_TOTAL, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """Learn from at most ``sample_docs`` different texts of each language, rare ones included, and ``sample_total`` in all.

    Beyond ``max_languages`` (by rows, ties by name) the rarer ones are one class, named after the commonest of them.
    Repeated texts count once; None if no row with a language has a letter.
    """
    rows = long_texts(docs).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()
    rare = counted[max_languages - 1].lang if len(counted) > max_languages else None
    if rare is not None:
        own = [r.lang for r in counted[: max_languages - 1]]
        rows = rows.withColumn("lang", F.when(F.col("lang").isin(own), F.col("lang")).otherwise(rare))
    share = max(1, min(sample_docs, sample_total // max(1, min(len(counted), max_languages))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = rows.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= share)
    # A row for each language: max_languages at most.
    bound = F.broadcast(docs.sparkSession.createDataFrame(least.groupBy("lang").agg(F.max("h").alias("last")).collect(), "lang string, last long"))
    chosen = rows.join(bound, "lang").where("h <= last").groupBy("lang", "h").agg(F.first("text").alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, lang, h in zip(batch["text"], batch["lang"], batch["h"]):
                counts = subwords(text)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((h, lang, at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["h", "lang", "at", "n"])

    rows = chosen.mapInPandas(features, "h long, lang string, at binary, n binary").collect()
    rows = sorted((r.h, r.lang, bytes(r.at), bytes(r.n)) for r in rows)
    if not rows:
        return None
    model = train([(lang, np.frombuffer(at, "<u2"), np.frombuffer(n, "<u4").astype(np.float32)) for _, lang, at, n in rows])
    model.rare = rare
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``language`` struct<lang,score,rejected>; an input column of that name is replaced.

    Null texts and texts without a letter are ``und``, score 0, rejected; so is everything if there is
    no model.  ``score`` is the calibrated probability; ``rejected`` marks one below the threshold, and the class of
    rare languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang string, score double, rejected boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            lang, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            for start in range(0, len(texts), 128):
                found = [(i, c) for i, t in enumerate(texts.iloc[start : start + 128], start) if model and (c := subwords(t)) is not None]
                if found:
                    p = model.probabilities(np.stack([c for _, c in found]).astype(np.float32))
                    for (i, _), row in zip(found, p):
                        best = int(row.argmax())
                        lang[i], score[i], rejected[i] = model.languages[best], min(1.0, float(row[best])), row[best] < model.reject_below or model.languages[best] == model.rare
            yield pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return replaced(long_texts(docs), language=identify(F.col(f"`{text_col}`")))
