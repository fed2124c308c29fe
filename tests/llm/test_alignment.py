import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import alignment, queries


@pytest.fixture(scope="module")
def one():
    return alignment.pair(*alignment.default_paths())


def plain_tokens(one, text):
    """Straight from the contract, by the two libraries."""
    if not text:
        return [], [], []
    raw = (" " + text).encode()
    a = one.slow.encode(" " + text, add_special_tokens=False).ids
    b = one.b.encode(text)
    if b"".join(one.bytes_a[i] for i in a) != raw or b"".join(one.bytes_b[i] for i in b) != raw:
        return [], [], []
    groups, at = [], [0, 0]
    ends = [0, 0]
    while at[0] < len(a):
        group = ([], [])
        while not group[0] or ends[0] != ends[1]:
            side = 0 if ends[0] <= ends[1] else 1
            token = (a, b)[side][at[side]]
            group[side].append(token)
            ends[side] += len((one.bytes_a, one.bytes_b)[side][token])
            at[side] += 1
        groups.append(group)
    return a, b, groups


def brute(one, rows):
    aligned = [(doc, *plain_tokens(one, text)) for doc, text in rows]
    count = Counter()
    for _, _, _, groups in aligned:
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for doc, a, b, groups in aligned:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[k] == most[k[0]] for k in links), sum(count[k] for k in links), digest))
    return sorted(out, key=str), count, most


COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(docs):
    scores, pairs = alignment.align(docs)
    return sorted((tuple(r) for r in scores.select(COLUMNS).collect()), key=str), pairs


def test_query_against_brute_force(spark, sf_dir, one):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_token_alignment"](spark, sf_dir).withColumnRenamed("doc_id", "id").select(COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(one, rows)[0]


def test_odd_documents(odd_docs, no_docs, one):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want, count, most = brute(one, rows)
    got, pairs = found(odd_docs)
    assert got == want
    assert {(r.a, r.b): (r.docs, r.best) for r in pairs.collect()} == {k: (n, n == most[k[0]]) for k, n in count.items()}
    assert found(no_docs)[0] == []


ODD_TEXTS = [
    "a  b\n\tc   ", "x▁y", "<|endoftext|> <0x41> <unk>", "naïve façade Straße", "日本語のテキスト 🙂🙃", "\x00\x01 null", " " * 700, "a" * 900,
    "é" * 300, "  mixed　spaces", "ﬁ ligature ²", "é combining", "1234567890" * 40, "\r\n\r\n", "﻿mark", "𝒳𝒴", "aáb" * 50,
]


def test_odd_texts(spark, one):
    rows = list(enumerate(ODD_TEXTS)) + [(None, "no id"), (3, ODD_TEXTS[3])]
    got, _ = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(one, rows)[0]
    assert any(r[1] for r in got) and any(not r[1] for r in got)


def test_counted_groups_agree_with_listed_ones(one, monkeypatch):
    texts = ["the cat sat", "antidisestablishmentarianism " * 3, *ODD_TEXTS]
    whole = alignment.Aligned([one.tokens(t) for t in texts], one.length_a, one.length_b).counted_pairs()
    monkeypatch.setattr(alignment, "LISTED_LINKS", 1)
    counted = alignment.Aligned([one.tokens(t) for t in texts], one.length_a, one.length_b).counted_pairs()
    assert all(np.array_equal(x, y) for x, y in zip(whole, counted))


def test_quick_ids_are_the_files(one):
    assert one.quick is not None
    plain = "".join(map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]))
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list(plain + " '\n" * 40), 60))
        assert one.quick.encode_ordinary(" " + text) == one.slow.encode(" " + text, add_special_tokens=False).ids


def test_groups_give_back_the_text(spark, one):
    text = "Straße, naïve tokenization\nof text"
    groups = spark.createDataFrame([(text,), (None,)], "text string").select(alignment.groups(F.col("text")).alias("g")).collect()
    assert b"".join(one.bytes_a[i] for g in groups[0].g for i in g.a).decode() == " " + text
    assert b"".join(one.bytes_b[i] for g in groups[0].g for i in g.b).decode() == " " + text
    assert sum(g.bytes for g in groups[0].g) == len((" " + text).encode()) and groups[1].g == []
