import re
from collections import Counter

import duckdb
import pytest

from quern.llm import divergence, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=30, top=50):
    """Straight from the contract, over (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    tokens = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for t, _, _ in rows]
    held, counts = Counter(), {}
    for words, (_, lang, source) in zip(tokens, rows):
        held.update({(lang, w) for w in words})
        counts.setdefault((lang, source), Counter()).update(words)
    out = []
    for lang in {lang for lang, _ in counts}:
        kept = sorted(w for (k, w), n in held.items() if k == lang and n >= min_docs)
        of = {s: c for (k, s), c in counts.items() if k == lang}

        def share(count):
            total = sum(count[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 5) // total for w in kept}

        p, q = {s: share(c) for s, c in of.items()}, share(sum(of.values(), Counter()))
        for s in of:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in of if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if of[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda r: (-r[0], r[1].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def found(docs, **limits):
    return sorted(tuple(r) for r in divergence.audit(docs, **limits).select(COLUMNS).collect())


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(f"select {', '.join(COLUMNS)} from ({queries.SQL['op12_source_divergence']})").fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op12_source_divergence"](spark, sf_dir).select(COLUMNS).collect())
    assert got == want and {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("min_docs", [1, 2, 5])
def test_whole_sample(sample, min_docs):
    rows = [tuple(r) for r in sample.select("text", "lang", "source").collect()]
    assert found(sample, min_docs=min_docs, top=7) == brute(rows, min_docs, 7)


def test_odd_documents(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("text", "lang", "source").collect()]
    for min_docs in (1, 3, 30):
        assert found(odd_docs, min_docs=min_docs) == brute(rows, min_docs)
    assert found(no_docs) == []


def test_blocks_of_sources_and_one_hot_source(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 2)  # read by the driver only
    rows = [(f"Alpha beta{chr(97 + i % 7)} gamma{chr(97 + i % 3)} é{i % 2 * 'É'} x9y", "en", f"s{0 if i % 3 else i % 11}") for i in range(120)]
    rows += [("1 2 3", "en", "empty"), ("", "xx", "a"), ("", "xx", "b")]
    assert found(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=3) == brute(rows, 3)
