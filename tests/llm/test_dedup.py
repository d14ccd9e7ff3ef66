"""Exact and near duplicates against brute force, with the awkward rows."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from papyrion.llm import rows as kept_rows
from papyrion.llm.bitslice import near, union
from papyrion.llm.exact_dedup import drop_copies, exact_dedup
from papyrion.llm.simhash import drop_near_copies, fingerprint, simhash_dedup

SCHEMA = "doc_id long, text string, __k1 string, digest int"


def rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400]))) for _ in range(40)]
    out = [(k, t, "x", 1) for k, t in enumerate(base)]
    for k in range(60):
        t = rng.choice(base).split()
        t[rng.randrange(len(t))] = rng.choice(words)
        out.append((100 + k, (" " if k % 2 else "\n \t").join(t), None, None))
    out += [(200 + k, base[3], "y", 2) for k in range(50)]
    out += [(300, None, None, None), (301, "", None, None), (302, " \t", None, None), (None, base[5], None, None), (None, None, None, None)]
    out += [(400, base[4], "a", 1), (400, base[4], "a", 1), (401, "ÀÉ Straße 😀 x", None, None), (402, "long " * 60000, None, None)]
    return out


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def slow_fingerprint(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_exact_dedup(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(normal(t), []).append(i)
    for heavy in (1, 1000):
        got = exact_dedup(df, heavy=heavy).collect()
        assert len(got) == len(data)
        by = {}
        for r in got:
            by.setdefault(r.text_sha256, []).append(r)
        for t, ids in groups.items():
            mine = by[hashlib.sha256(t.encode()).hexdigest()]
            keep = min((x for x in ids if x is not None), default=None)
            assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids))
            assert {(r.keep_id, r.group_size) for r in mine} == {(keep, len(ids))}
            assert [r.doc_id for r in mine if r.kept] == [keep]
    left = drop_copies(df)
    assert left.columns == df.columns
    assert sorted(normal(r.text) for r in left.collect()) == sorted(groups)
    assert exact_dedup(df.limit(0)).count() == 0 == drop_copies(df.limit(0)).count()


def test_fingerprint():
    for _, t, *_ in rows():
        assert fingerprint(t) == slow_fingerprint(t)


def test_bit_sliced_pairs_match_popcount():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = centres[rng.integers(0, 6, 500)].copy()
    for _ in range(3):
        flip = rng.random(500) < 0.7
        codes[flip] ^= np.uint64(1) << rng.integers(0, 64, flip.sum()).astype(np.uint64)
    for radius in (0, 1, 3, 6):
        low = np.arange(500) + 1
        high = np.where(np.arange(500) < 200, 200, 500)
        found = {(int(a), int(b)) for i, j in near(codes, low, high, radius, tile=100) for a, b in zip(i, j, strict=True)}
        assert found == {(a, b) for a in range(500) for b in range(a + 1, int(high[a])) if int(codes[a] ^ codes[b]).bit_count() <= radius}
    labels = np.arange(6)
    union(labels, np.array([0, 4, 3]), np.array([1, 3, 1]))
    assert labels.tolist() == [0, 0, 2, 0, 0, 5]


def brute_components(data, radius=3):
    marks = [(i, slow_fingerprint(t)) for i, t, *_ in data if i is not None]
    label = {i: i for i, _ in marks}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, f in marks:
        for b, g in marks:
            if a < b and (f ^ g).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in label}


def test_simhash_components(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = brute_components(data)
    got = simhash_dedup(df).collect()
    assert len(got) == len(data)
    assert all(r.component_id == (None if r.doc_id is None else want[r.doc_id]) for r in got)
    assert {r.fingerprint for r in got} == {f"{slow_fingerprint(t):016x}" for _, t, *_ in data}
    stays = [r.doc_id for r in drop_near_copies(df).where("doc_id is not null").collect()]
    assert sorted(stays) == sorted(set(want.values()))
    assert simhash_dedup(df.limit(0)).count() == 0


def test_large_bucket_is_cut_into_blocks(spark):
    from papyrion.llm.simhash import links

    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 1 << 14, 700).astype(np.int64))
    classes = spark.createDataFrame([(int(k), int(c)) for k, c in enumerate(codes)], "rep long, fp long")
    from papyrion.operators.components import connected_components

    want = brute = None
    for block in (40, 100000):
        got = {r.vertex: r.component for r in connected_components(links(classes, block=block)).collect()}
        brute, want = got, want or got
        assert got == want
    label = list(range(len(codes)))
    for _ in range(60):
        for a in range(len(codes)):
            for b in range(a):
                if bin(int(codes[a] ^ codes[b])).count("1") <= 3:
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[x]] == label[x] for x in range(len(codes))):
            break
    assert {k: v for k, v in brute.items()} == {k: label[k] for k in brute}
    assert F is not None


def test_stages_keep_the_values_of_columns_of_any_name(spark):
    schema = "doc_id long, text string, __k1 string, __k2 int, row string, `k1.n` int, n long"
    long = "very long " * 100_000
    data = [(1, "a b c d", "p", 1, "r1", 5, 9), (2, "a  b c d", "q", 2, "r2", 6, 8), (3, "other words are here now", "s", 3, "r3", 7, 7), (4, "other words are here now", "t", 4, "r4", 8, 6), (None, None, "u", 5, "r5", 9, 5), (7, long, "v", 6, "r6", 1, 1), (7, long, "v", 6, "r6", 1, 1)]
    df = spark.createDataFrame(data, schema)
    for drop in (drop_copies, drop_near_copies):
        left = drop(df)
        assert left.columns == df.columns
        got = {tuple(r) for r in left.collect()}
        assert got == {data[0], data[2], data[4], data[5]} and left.count() == 4
        assert drop(df.limit(0)).count() == 0
    some = spark.createDataFrame([(9, "left text", 1), (9, "right text of another kind", 2)], "doc_id long, text string, n int")
    assert drop_copies(some).count() == 2 and drop_near_copies(some).count() == 1


def test_carry_save_adders_count():
    from papyrion.llm.bitslice import add_planes

    rng = np.random.default_rng(3)
    for n, digits in ((1, 2), (8, 2), (8, 5), (13, 3), (64, 7)):
        bits = rng.integers(0, 2, (n, 64)).astype(np.uint64)
        planes = [np.array([sum(int(b) << k for k, b in enumerate(row))], np.uint64) for row in bits]
        count = [np.zeros(1, np.uint64) for _ in range(digits)]
        over = np.zeros(1, np.uint64)
        for at in range(0, n, 8):
            over |= add_planes(count, planes[at : at + 8])
        for lane in range(64):
            real = int(bits[:, lane].sum())
            assert (int(over[0]) >> lane & 1) == (real >= 1 << digits)
            if real < 1 << digits:
                assert sum((int(c[0]) >> lane & 1) << k for k, c in enumerate(count)) == real


def test_rows_that_stay_are_told_apart_before_the_join(spark, monkeypatch):
    data = [(k, f"text {k}", k * k) for k in range(3000)] + [(5, "text 5", 1), (9, "text 9", 2), (9, "text 9", 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, bits long")
    keys = docs.groupBy(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2")).agg(F.count("*").alias("n"))
    for most in (1 << 18, 1):  # and with a filter that is nearly full
        monkeypatch.setattr(kept_rows, "MOST_WORDS", most)
        gone = keys.where("k1 % 50 = 3")
        some, stay = kept_rows.sieved(docs.withColumns({"k1": F.col("doc_id"), "k2": F.xxhash64("text")}), gone, ["k1", "k2"])
        some, stay = [r.doc_id for r in some.collect()], [r.doc_id for r in stay.collect()]
        assert sorted(some + stay) == sorted(k for k, *_ in data) and all(k % 50 != 3 for k in stay)
        assert most == 1 or len(some) < 150
        got = kept_rows.keep_rows(docs, keys, keys.where("k1 % 50 <> 3"), "doc_id", "text")
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [k for k in range(3000) if k % 50 != 3]
    assert kept_rows.keep_rows(docs.limit(0), keys.limit(0), keys.limit(0), "doc_id", "text").count() == 0
