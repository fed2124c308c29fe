import numpy as np
import pytest
import xxhash

from quern.llm import simhash


def fingerprint(text, k=3):
    words = []
    for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or ""):
        words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, threshold=3):
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def check(docs, text="text"):
    rows = docs.select("doc_id", text).collect()
    prints = [fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], prints, components(prints, [r[0] for r in rows])), key=str)
    got = sorted(((r.id, r.fingerprint % 2**64, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    return got


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs)
    assert simhash.near_duplicates(no_docs).collect() == []


def test_real_documents(sample):
    check(sample)


def test_anchors_cover_every_pair_within_the_threshold():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for threshold in range(5):
        for flips in range(threshold + 1):
            other = base.copy()
            for row in range(len(base)):
                for bit in rng.choice(46, flips, replace=False):
                    other[row] ^= np.uint64(1) << np.uint64(bit)
            homes = simhash.anchors_within(base, threshold)[0]
            _, anchors, owners = simhash.anchors_within(other, threshold)
            assert all(h in set(anchors[owners == i].tolist()) for i, h in enumerate(homes.tolist()))


def test_one_home_and_no_anchor_twice():
    fps = np.arange(0, 1 << 46, (1 << 46) // 700 + 12345, dtype=np.uint64)
    homes, anchors, owners = simhash.anchors_within(fps, 0)
    assert (anchors == homes).all() and (owners == np.arange(len(fps))).all() and homes.max() < 1 << simhash.ANCHOR_BITS
    _, anchors, owners = simhash.anchors_within(fps[:200], 3)
    assert len(np.unique(owners * (1 << 24) + anchors)) == len(anchors)


def test_threshold_is_checked(sample):
    with pytest.raises(ValueError):
        simhash.near_duplicates(sample, threshold=5)


def test_components_of_one_smallest_id_have_their_own_label(spark):
    docs = spark.createDataFrame([(9, " ".join(f"a{i}" for i in range(50))), (9, " ".join(f"b{i}" for i in range(50)))], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert {r.component for r in rows} == {9} and len({r.label for r in rows}) == 2


def test_chains_link_through_and_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    start = [int(x) for x in rng.integers(0, 2**62, 30)]
    prints = []
    for s in start:
        for step in range(12):
            prints.append(s ^ ((1 << 2 * step) - 1))  # each two bits from the last
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    monkeypatch.setattr(simhash, "BUSY_RESIDENTS", 2)
    monkeypatch.setattr(simhash, "BATCH_PRINTS", 7)
    distinct = spark.createDataFrame(rows, "id long, fp long")
    labels = {r.fp: r.label for r in simhash._labels(simhash._links(distinct.select("fp").distinct(), 3)).collect()}
    want = components(prints, list(range(len(prints))))
    groups, mine = {}, {}
    for (i, fp), w in zip(rows, want):
        groups.setdefault(w, set()).add(fp)
        mine.setdefault(labels.get(fp, fp), set()).add(fp)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_long_chains_of_links_end(spark):
    """Many rounds of labels: the optimizer's estimates must not grow with them."""
    chain = [((i * 7919) % 1009, ((i + 1) * 7919) % 1009) for i in range(300)]
    rows = [(max(a, b), min(a, b)) for a, b in chain]
    labels = simhash._labels(spark.createDataFrame(rows, "fp long, root long")).collect()
    assert {r.label for r in labels} == {min(min(r) for r in rows)} and len(labels) == 301
