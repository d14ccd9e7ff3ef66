"""Near copies against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from papyrion.llm import near_copies
from papyrion.llm.near_copies import RADIUS, drop_near_copies, near_components, shingles, signature, similar_forest

DATA = "/root/testdata/sf0.01"


def plain(text, words=5):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def brute(rows, least=0.8):
    """{id: component} by all pairs that share a shingle."""
    sets = [(i, plain(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s or [()]:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for group in by.values() for n, a in enumerate(group) for b in group[n + 1 :]}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        if x == y or (x and y and len(x & y) >= least * len(x | y)):
            i, j = sorted((root(i), root(j)))
            label[j] = i
    return {i: root(i) for i in label}


def edited(rng, words, share):
    return " ".join(rng.choice(["new", "old", "odd"]) + str(rng.randrange(9999)) if rng.random() < share else w for w in words)


def made(seed=3):
    rng = random.Random(seed)
    rows = []
    for base in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 12, 40, 150, 600]))]
        for _ in range(rng.randrange(1, 6)):
            rows.append((len(rows), edited(rng, words, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))))
    hot = [f"h{rng.randrange(4000)}" for _ in range(300)]
    rows += [(1000 + k, edited(rng, hot, 0.004)) for k in range(250)]
    rows += [(2000 + k, " ".join(hot[:100]) + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(120))) for k in range(40)]  # a long shared passage, no copies
    return [*rows, (3000, None), (3001, ""), (3002, " \n"), (3003, "two words"), (3004, "TWO  words"), (3005, "a b c d e"), (None, "a b c d e"), (3006, "q " * 100_000), (0, rows[0][1])]


@pytest.mark.parametrize("block", [16, 64, 512])
def test_components_equal_all_pairs(spark, block):
    rows = made()
    got = {}
    for r in near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block).collect():
        got.setdefault(r.id, set()).add(r.component)
    want = brute(rows)
    assert {i: c for i, c in got.items() if i is not None} == {i: {c} for i, c in want.items()} and got[None] == {None}
    assert len(set(want.values())) < len(want) - 240


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert {r.id: r.component for r in near_components(docs).collect()} == want
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_forest_is_spanning():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 200).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(200) < rng.choice([0.02, 0.08, 0.3]), rng.integers(0, 1 << 40, 200).astype(np.uint64), base)) for _ in range(60)] + [np.zeros(0, np.uint64)]
    links = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}

    def classes(pairs):
        label = list(range(61))
        for _ in range(61):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    forest = similar_forest(sets, 0.8)
    assert classes(forest) == classes(links) and len(forest) == 61 - len(set(classes(links)))


def test_radius_is_wide_enough():
    rng = np.random.default_rng(0)
    for size in (5, 9, 45, 400):
        far = 0
        for _ in range(300):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            gone = size // 9  # as many come as go: 8/9 in common at most, 0.8 of the union
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64) * np.uint64(2) + np.uint64(1)])) if gone else a[1:]
            far += (signature(a)[0] ^ signature(b)[0]).bit_count() > RADIUS
        assert far <= 1
    assert len(shingles("a b c d e f")) == 2 and len(shingles("A b")) == 1 and len(shingles(None)) == 0


def test_sketches_tell_copies_from_shared_passages():
    rng = random.Random(8)
    common = [f"c{k}" for k in range(30)]
    for _ in range(100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        one, two = shingles(" ".join(words)), shingles(" ".join(words[:150] + ["new"] * 3 + words[150:-20]))
        other = shingles(" ".join(common + [f"z{rng.randrange(10**6)}" for _ in range(200)]))
        passage = shingles(" ".join(common + words))

        def agree(a, b):
            return sum(x == y for x, y in zip(near_copies.sketch(a), near_copies.sketch(b), strict=True))

        assert agree(one, two) >= near_copies.AGREE > agree(other, passage)
