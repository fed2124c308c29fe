"""The learned columns against plain implementations of the same models, row by row, and the pipeline's stages against brute force."""

import math
import re

import numpy as np
import pytest
import test_line_dedup
import test_near_copies
import tiktoken
from pyspark.sql import functions as F

from quern.llm import byte_bpe, co_training, language_id, pipeline, quality_rules, queries, secrets

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, spark.read.parquet(f"{sf_dir}/labels.parquet")


def plain_language(model, text):
    text = text or ""
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    points = [32, *(ord(c) if c.isalpha() else 32 for c in text.lower()), 32]
    total, n = np.zeros(language_id.WIDTH), 0
    for width in language_id.NGRAMS:
        for i in range(len(points) - width + 1):
            h = points[i]
            for p in points[i + 1 : i + width]:
                h = (h * 0x100000001B3 + p) & MASK
            total += model.embedding[((h * 0x9E3779B97F4A7C15) & MASK) >> 50]
            n += 1
    logits = (total / n @ model.softmax + model.bias) / model.temperature
    odds = [math.exp(x - max(logits)) for x in logits]
    best = int(np.argmax(odds))
    return model.languages[best], odds[best] / sum(odds)


def test_language_predictions(tables):
    docs, _ = tables
    model = language_id.fit(docs)
    some = docs.where("length(text) < 1500").limit(60)
    for r in language_id.predict(some, model).collect():
        lang, score = plain_language(model, r.text)
        assert r.language.lang == lang and abs(r.language.score - score) < 1e-3 and r.language.rejected == (r.language.score < model.reject_below)


def test_anomaly_verdicts(tables):
    docs, labels = tables
    forests = quality_rules.fit(docs, labels)

    def path(tree, row):
        feature, split, child, length = tree
        at = 0
        while feature[at] >= 0:
            at = child[at] + int(row[feature[at]] >= split[at])
        return length[at]

    ends = np.cumsum([0, *(len(g) for g in quality_rules.GROUPS)])
    for r in quality_rules.judge(docs, forests).limit(80).collect():
        values = quality_rules.statistics(r.text)[5:]
        scores = [2 ** (-sum(path(t, values[a:b]) for t in f.trees) / len(f.trees) / f.unit) for f, a, b in zip(forests.forests, ends, ends[1:])]
        assert abs(r.verdict.anomaly - max(scores)) < 1e-9
        assert r.verdict.normal == all(s <= f.threshold for s, f in zip(scores, forests.forests))


def test_learned_spans(tables):
    docs, _ = tables
    grammar = secrets.fit(docs)
    for r in secrets.find_secrets(docs, grammar).collect():
        text, base = r.text or "", secrets.base_spans(r.text or "")
        want = [("learned", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]{6,}", text) if grammar.secret(m.group()) and all(e <= m.start() or m.end() <= s for _, s, e in base)]
        assert [(x["kind"], x["start"], x["end"]) for x in r.secrets if x["kind"] == "learned"] == want


def test_quality_scores(tables):
    docs, labels = tables
    model = co_training.fit(docs, labels)
    assert model is not None
    for r in co_training.classify(docs, model).limit(60).collect():
        odds = []
        for view, x in ((model.text, co_training.text_view(r.text)), (model.meta, co_training.meta_view(r.lang, r.source, r.n_chars))):
            odds.append(view.slope * (sum((a - m) / s * w for a, m, s, w in zip(x.tolist(), view.mean, view.scale, view.weights)) + view.bias) + view.shift)
        score = 1 / (1 + math.exp(-(model.weights[0] * odds[0] + model.weights[1] * odds[1] + model.bias)))
        assert abs(r.quality.score - score) < 1e-6 and r.quality.kept == (r.quality.score >= model.keep_from)


def test_stages_against_brute_force(spark, tables, sf_dir):
    docs, labels = tables
    model = co_training.fit(docs, labels)
    kept = pipeline.quality_classifier(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in co_training.classify(docs, model).where("quality.kept").collect())

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d: t for d, _, _, t in test_line_dedup.brute(rows)}
    assert {r.doc_id: r.text or "" for r in pipeline.line_deduplication(spark, docs, sf_dir).collect()} == want

    components = test_near_copies.components(rows)
    assert sorted(r.doc_id for r in pipeline.near_deduplication(spark, docs, sf_dir).collect()) == sorted(set(components))

    counts = {r.doc_id: r.n for r in pipeline.source_mix(spark, docs, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    mixed = {r.doc_id: r.taken // r.size for r in queries.QUERIES["op7_source_mix"](spark, sf_dir).collect() if r.taken}
    assert counts == mixed

    path = byte_bpe.default_vocabulary()
    from public_tokenizers import PATTERN
    from tiktoken.load import load_tiktoken_bpe

    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    texts = dict(rows)
    for r in pipeline.byte_bpe_encoding(spark, docs, sf_dir).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == plain.encode_ordinary(texts[r.doc_id] or "") and r.round_trip
