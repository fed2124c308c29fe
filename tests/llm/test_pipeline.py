import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import byte_bpe, mixing, pipeline

NAMES = ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mix", "byte_bpe"]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_the_columns_and_run_equals_them(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "byte_bpe":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4]
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
    assert docs.where("not round_trip").count() == 0


def test_stages_on_odd_documents(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= 3 * docs.count()


def test_near_dedup_keeps_one_of_each_group(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(i, text, "en", "a", 9) for i in range(5, 50)] + [(3, text + " more", "en", "a", 9), (1, "something else entirely", "en", "a", 9), (None, text, "en", "a", 9), (1, "something else entirely", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in pipeline.near_deduplication(spark, docs, sf_dir).collect()]
    assert sorted(kept, key=str) == [1, 3, None]


def test_near_dedup_keeps_documents_of_one_id_in_different_groups(spark, sf_dir):
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(9, one, "en", "a", 9), (9, two, "en", "a", 9), (10, one + " more", "en", "a", 9), (11, two + " more", "en", "a", 9), (9, one, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(9, one), (9, two)]


def test_mix_stage_repeats_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(r.id): r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in pipeline.source_mix(spark, docs, sf_dir).groupBy("doc_id").count().collect()}
    assert got == want


def test_encoded_ids_decode(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    bpe = byte_bpe.encoder(byte_bpe.default_vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pipeline.byte_bpe_encoding(spark, docs.where(F.col("doc_id").isin(list(texts))), sf_dir).collect():
        assert len(np.frombuffer(bytes(r.ids), "<u4")) == r.n_tokens and bpe.decode(bytes(r.ids)).decode() == (texts[r.doc_id] or "")


def test_mix_stage_with_a_hot_row_and_nulls(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(pipeline, "MANY_COPIES", 100)
    rows = [(None, "the same text again", None, None, 9)] * 1500 + [(i, f"text number {i} and more", "en", ["a", "b", None][i % 3], 9) for i in range(300)] + [(None, None, "en", "a", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda r: (r.id, r.source, r.text_hash)
    want = {}
    for r in mixing.mix(docs).collect():
        want[key(r)] = want.get(key(r), 0) + r.copies
    got = pipeline.source_mix(spark, docs, sf_dir)
    assert got.columns == docs.columns
    found = got.select(F.col("doc_id").alias("id"), "source", F.xxhash64("text").alias("text_hash")).groupBy("id", "source", "text_hash").count().collect()
    assert {key(r): r["count"] for r in found} == {k: n for k, n in want.items() if n}
