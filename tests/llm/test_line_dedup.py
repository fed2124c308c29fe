import hashlib

import duckdb
from pyspark.sql import functions as F

from quern.llm import line_dedup, queries

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5):
    holders = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                key = line.strip(SPACES).translate(LOWER)
                if len(key) >= min_chars:
                    holders.setdefault(key, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(line.strip(SPACES).translate(LOWER), set())
            if doc is None or len(held) < min_docs or doc == max(held):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(docs, **limits):
    report = line_dedup.dedup_lines(docs, **limits)
    return sorted((tuple(r) for r in report.select("doc_id", "line_report.*").collect()), key=str)


def test_odd_documents(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(odd_docs) == brute(rows)
    assert found(odd_docs, min_docs=2, min_chars=5) == brute(rows, min_docs=2, min_chars=5)


def test_other_columns_stay_and_empty_table(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert set(odd_docs.columns) == set(out.columns) and out.count() == odd_docs.count()
    assert found(no_docs) == []


def test_shuffled_and_broadcast_bitmaps_agree(odd_docs):
    bitmaps = line_dedup.keep_bitmaps(odd_docs)
    docs = odd_docs.drop("line_report")
    a = line_dedup.apply_bitmaps(docs, bitmaps.hint("merge"))
    b = line_dedup.apply_bitmaps(docs, F.broadcast(bitmaps))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_hot_line_in_most_documents(spark):
    line = "a line that stands in nearly all of the documents there are"
    rows = [(i, f"{line}\nunique line number {i} that is long enough to be looked at") for i in range(400)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id: r.n for r in out.select("doc_id", F.col("line_report.n_dropped").alias("n")).collect()}
    assert kept.pop(399) == 0 and set(kept.values()) == {1}


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(queries.SQL["op1_line_dedup"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["op1_line_dedup"](spark, sf_dir).collect())) == want
    assert want[0][3] and len(want[0][3]) == len(hashlib.sha256().hexdigest())


def test_native_plan(sample):
    plan = line_dedup.dedup_lines(sample)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_of_any_name_pass_through(spark, odd_docs):
    clash = {n: F.lit(n) for n in ("__key", "__id", "__hash", "__words", "row", "key", "words", "marked")}
    out = line_dedup.dedup_lines(odd_docs.withColumns(clash))
    assert out.where("__key = '__key' and __id = '__id' and __hash = '__hash' and words = 'words' and row = 'row'").count() == odd_docs.count()


def test_bitmaps_hold_the_lines_that_stay(spark):
    shared = "a line of forty characters or a few more, shared"
    docs = spark.createDataFrame([(i, f"first {i}\n{shared}\nlast" + "\nx" * 70) for i in range(6)], "doc_id long, text string")
    bitmaps = {r.key.id: r.words for r in line_dedup.keep_bitmaps(docs).collect()}
    assert bitmaps == {i: {0: (1 << 63) - 1 - 2} for i in range(5)}
