import zlib

import duckdb
from pyspark.sql import functions as F

from quern.llm import language_id, mixing, queries


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = queries.QUERIES["op7_source_mix"](spark, sf_dir)
    want = con.sql(queries.SQL["op7_source_mix"])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def water_fill(sizes, weights, most):
    share = dict.fromkeys(sizes, 0.0)
    total, open_ = sum(sizes.values()), set(sizes)
    while True:
        left = total - sum(most * sizes[s] for s in sizes if s not in open_)
        level = left / max(1, sum(weights[s] for s in open_))
        over = {s for s in open_ if level * weights[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: level * weights[s] if s in open_ else float(most * sizes[s]) for s in sizes}
        open_ -= over


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 1, None: 50}, {"a": 5}, {"x": 0, "y": 7}, {c: (ord(c) * 37) % 91 for c in "abcdefghijk"}):
        table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        found = {r.source: r.target for r in mixing.source_targets(table).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
        assert all(abs(found[s] - want[s]) < 1e-6 for s in sizes)


def test_odd_documents(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.copies <= 3 for r in rows) and sum(r.size * r.copies for r in rows) >= sum(r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs).collect()))
    assert mixing.mix(no_docs).collect() == []


def test_taken_words_come_near_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 3 else "s0") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.expr("size * copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 7


def test_repeated_rows_do_not_overshoot(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MANY_REPEATS", 7)
    monkeypatch.setattr(mixing, "FEW_ENTRIES", 50)
    rows = [(1, "w " * 5, "a")] * 900 + [(i, "w " * 5, "b") for i in range(900)] + [(None, f"w{i} " * 5, "c") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    assert mixed.count() == 2700
    for r in mixed.groupBy("source").agg(F.sum(F.expr("size * copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 5


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 60)
    rows = [(i, "the quick brown fox and the lazy dog went over the hill " * 3 + str(i), "en") for i in range(400)]
    rows += [(1000 + i, "der schnelle braune fuchs und der faule hund gingen zum berg " * 3 + str(i), "de") for i in range(6)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=60)
    assert model.languages == ["de", "en"]


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op10_language_id"](spark, sf).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95


def test_language_odd_documents(odd_docs, no_docs):
    for model in (language_id.fit(odd_docs), language_id.fit(no_docs)):
        for r in language_id.predict(odd_docs, model).collect():
            if not r.text or not any(map(str.isalpha, r.text)):
                assert (r.language.lang, r.language.score, r.language.rejected) == ("und", 0.0, True)
        assert language_id.predict(no_docs, model).collect() == []


def test_many_languages_are_no_error(spark):
    rows = [(i, "the quick brown fox and the lazy dog went over the hill " * 3 + str(i), "en") for i in range(60)]
    rows += [(100 + i, "der schnelle braune fuchs und der faule hund gingen zum berg " * 3 + str(i), "de") for i in range(50)]
    rows += [(200 + i, "zzyx qqvw " * 20 + str(i), f"odd{i % 30:02}") for i in range(60)] + [(300, "zzyx qqvw", "odd00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample_total=90, max_languages=3)
    assert model.languages == ["de", "en", "odd00"] and model.rare == "odd00"
    found = {(r.lang, r.language.lang, r.language.rejected) for r in language_id.predict(docs, model).select("lang", "language").collect() if r.lang in ("en", "de")}
    assert {f[:2] for f in found} == {("en", "en"), ("de", "de")}
    assert all(r.language.lang == "odd00" and r.language.rejected for r in language_id.predict(docs.where("lang like 'odd%'"), model).collect())
