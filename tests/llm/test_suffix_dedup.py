import hashlib
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import queries, suffix_dedup


def brute(rows, length=400):
    """(id, n_bytes, n_removed, n_spans, kept) of (id, text) rows, by counting every string."""
    raws = [(doc, (text or "").encode()) for doc, text in rows]
    count = Counter(hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for _, raw in raws for i in range(len(raw) - length + 1))
    out = []
    for doc, raw in raws:
        gone = np.zeros(len(raw) + 1, np.int8)
        for i in range(len(raw) - length + 1):
            if count[hashlib.blake2b(raw[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = 1
        spans = int((np.diff(gone, prepend=0) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[gone[:-1] == 0].tobytes()))
    return sorted(out, key=str)


def found(docs):
    report = [f"string_report.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept")]
    out = suffix_dedup.dedup_strings(docs).select("doc_id", *report).collect()
    return sorted(((*r[:4], bytes(r[4])) for r in out), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeéfghß"), rng.integers(2, 9))) for _ in range(n))


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows)]
    got = queries.QUERIES["op11_suffix_dedup"](spark, sf_dir)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[2] > 0 for r in want) > 5


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(odd_docs) == brute(rows)
    assert found(no_docs) == []


def test_other_columns_stay(odd_docs):
    docs = odd_docs.withColumns({n: F.lit(n) for n in ("row", "raw", "spans", "touched", "marked", "String_Report")})
    out = suffix_dedup.dedup_strings(docs)
    assert {c.lower() for c in out.columns} == {c.lower() for c in docs.columns} | {"string_report"}
    assert out.where("row = 'row' and raw = 'raw' and touched = 'touched'").count() == docs.count()


def tricky(rng):
    passage, other = words(rng, 90), words(rng, 200)
    whole = words(rng, 300)
    texts = [words(rng, int(rng.integers(5, 120))) + passage + words(rng, int(rng.integers(5, 120))) for _ in range(30)]
    texts += [whole, whole[:700] + "X" + whole[701:], whole[300:], words(rng, 3) + whole[1:], other + other, passage[:399], passage[:400]]
    texts += ["a" * 1500, "ab" * 600, "b" + "a" * 450, "é" * 300, "\0" * 900, whole[:500] + "\0" * 500, other[10:420], other[11:411] + "é"]
    return [*texts, None, "", "short"]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_edits_runs_and_nul_bytes(spark, seed):
    rows = list(enumerate(tricky(np.random.default_rng(seed)))) + [(None, "no id " * 100), (None, "no id " * 100)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_hot_anchors_are_counted(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 3)  # read by the driver only
    rows = list(enumerate(tricky(np.random.default_rng(5))))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_texts_longer_than_a_piece():
    rng = np.random.default_rng(9)
    text = words(rng, 300_000)
    assert len(text.encode()) > suffix_dedup.PIECE + 400
    covered = np.zeros(len(text.encode()), np.int32)
    for raw, starts, whose in suffix_dedup._pieces(["x", text, None, "y" * 500]):
        piece, first, n, back, anchor = suffix_dedup.anchored(np.frombuffer(raw, np.uint8), starts)
        assert (back >= 0).all() and (back + suffix_dedup.ANCHOR <= suffix_dedup.LENGTH).all()
        for p, a, k in zip(piece, first, n):
            row, offset = whose[p]
            if row == 1:
                covered[a - starts[p] + offset : a - starts[p] + offset + k] += 1
    assert (covered[: len(covered) - 399] == 1).all() and not covered[len(covered) - 399 :].any()


def test_rounds_sort_suffixes_and_keep_common_prefixes():
    rng = np.random.default_rng(2)
    matrix = rng.integers(0, 3, (40, 12)).astype(np.uint8)
    group = np.sort(rng.integers(0, 5, 40))
    with tempfile.TemporaryFile() as columns:
        np.ascontiguousarray(matrix.T[::-1]).tofile(columns)
        columns.seek(0)
        for column, (order, common) in zip(range(11, -1, -1), suffix_dedup.suffix_rounds(columns, 40, 12, group)):
            suffixes = [(group[i], matrix[i, column:].tobytes()) for i in order]
            assert suffixes == sorted(suffixes)
            for i in range(1, 40):
                (g, a), (h, b) = suffixes[i - 1], suffixes[i]
                same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), None)
                if g != h:
                    assert common[i] == 0
                elif same is not None:
                    assert common[i] == same
                else:
                    assert common[i] >= len(a)
