import random
import re

import pytest

from quern.llm import near_copies, pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted(zip([d for d, _ in rows], components(rows)), key=str)
    assert sorted(((r.id, r.component) for r in near_copies.near_copies(docs).collect()), key=str) == want


def test_odd_and_real_documents(odd_docs, no_docs, sample):
    check(odd_docs)
    check(sample)
    assert near_copies.near_copies(no_docs).collect() == []


def test_pairs_around_the_similarity_and_chains(spark):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 6, 9, 40, 120]))]
        for copy in range(8):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // 50)):
                words[at] = f"x{rng.randrange(10**6)}"
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_stage_drops_edited_copies(spark, sf_dir):
    """Two words of a hundred changed: Jaccard over 0.8, three-word fingerprints more than three bits apart."""
    from quern.llm import simhash

    rng = random.Random(1)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        edited = words[:30] + ["edited"] + words[31:60] + ["words"] + words[61:]
        rows += [(2 * i, " ".join(words), "en", "a", 9), (2 * i + 1, " ".join(edited), "en", "a", 9)]
    prints = [simhash.fingerprint_text(r[1]) for r in rows]
    assert sum((a ^ b).bit_count() > 3 for a, b in zip(prints[::2], prints[1::2])) > 10
    kept = pipeline.near_deduplication(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 80, 2))


def test_edited_copies_meet_at_their_original(spark, monkeypatch):
    """Copies of a short text with a word changed each are alike to the text, but not to each other."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(0, " ".join(words))] + [(i, " ".join([*words[: 5 + i % 50], f"x{i}", *words[6 + i % 50 :]])) for i in range(1, 120)]
    tried = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or verified(pairs, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component for r in near_copies.near_copies(docs).collect()} == {0}
    assert sum(tried) < 5 * len(rows)


def counted(monkeypatch):
    """The numbers of pairs that are verified from now on."""
    tried = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or verified(pairs, *rest))
    return tried


def test_many_edits_without_their_original(spark, monkeypatch):
    """2,000 copies of a text with one word changed each: alike only where the words changed are neighbours."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    places = [5 + i % 50 for i in range(2000)]
    rows = [(i, " ".join([*words[:p], f"x{i}", *words[p + 1 :]])) for i, p in enumerate(places)]
    tried = counted(monkeypatch)
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component for r in found.collect()} == {0}
    assert sum(tried) < 5 * len(rows)


def test_edits_at_a_few_places_stay_apart(spark, monkeypatch):
    """As before, but words are changed at six places far from each other: six groups."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join([*words[: 6 + 8 * (i % 6)], f"x{i}", *words[7 + 8 * (i % 6) :]])) for i in range(600)]
    tried = counted(monkeypatch)
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.id % 6, r.component) for r in found.collect()} == {(k, k) for k in range(6)}
    assert sum(tried) < 3 * len(rows)


def test_crowds_and_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 30, 60]))]
        for copy in range(25):
            edited = list(words)
            for at in rng.sample(range(len(words)), rng.choice([1, 1, 2])):
                edited[at] = rng.choice(["y", "z", f"x{rng.randrange(10**6)}"])
            rows.append((len(rows), " ".join(edited[: len(edited) - rng.choice([0, 0, 1])])))
    monkeypatch.setattr(near_copies, "CROWD", 2)
    monkeypatch.setattr(near_copies, "BLOCK_SETS", 4)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_classes_of_sets_that_are_not_alike(spark, monkeypatch):
    """Short texts with one word of their own: none is alike to another of its class, but some are to other sets."""
    rng = random.Random(10)
    words = [f"w{rng.randrange(10**6)}" for _ in range(24)]
    rows = [(i, " ".join([*words[: 9 + i % 3], f"x{i}", *words[10 + i % 3 :]])) for i in range(30)]
    rows += [(100 + i, " ".join([*words[: 9 + i], f"x{i}", *words[10 + i :], "tail"])) for i in range(6)] + [(50, " ".join(words)), (51, " ".join(words[:23]))]
    monkeypatch.setattr(near_copies, "CROWD", 2)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("lone", [True, False])
def test_only_shingles_with_something_apart_meet(spark, monkeypatch, lone):
    sets = [(fp, 10, fp) for fp in range(80)]
    # A crowd of different labels, a pair of one label, and two shingles that one label alone has.
    placed = [(1, fp, 0, 10, fp) for fp in range(78)] + [(2, 78, 0, 10, 78), (2, 79, 0, 10, 78)] + [(3, fp, 1, 10, 77) for fp in (77, 79)] + [(4, 0, 1, 10, 0)] * 2
    seen = []
    classes = spark.createDataFrame([(fp, fp if lone else 0, 0, 10) for fp in range(78)], "fp long, rep long, core int, n int")
    monkeypatch.setattr(near_copies, "_classes", lambda *_: classes)
    monkeypatch.setattr(near_copies, "_met", lambda rows: seen.extend(rows.collect()) or spark.createDataFrame([], "a long, b long"))
    near_copies._left_apart(spark.createDataFrame(placed, "s long, fp long, at int, n int, label long"), spark.createDataFrame([], "a long, b long"), spark.createDataFrame(sets, "fp long, n int, text_hash long"), None)
    # A set without a label (78 that differ in their own shingles, none alike) is looked at in all of its shingles.
    assert {r.s for r in seen} == ({1} if lone else {1, 4})
    assert len(seen) == (78 if lone else 3)


def test_words_a_worker_keeps_are_bounded_within_a_batch(monkeypatch):
    """One batch holds more different words than are to be kept; sets do not depend on what is."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(50)]
    want = [near_copies.shingle_set(t, {}) for t in texts]
    kept, plain = [], near_copies.shingle_set
    monkeypatch.setattr(near_copies, "MEMO_WORDS", 200, raising=False)
    monkeypatch.setattr(near_copies, "shingle_set", lambda t, known: (plain(t, known), kept.append(len(known)))[0])
    got = next(near_copies._hashed(iter([texts])))
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    assert max(kept) <= 200 + 60
