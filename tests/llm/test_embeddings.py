"""Embedding near duplicates against brute force."""

import numpy as np

from papyrion.llm.embedding_dedup import embedding_dedup, learn_rotation, unit_rows


def brute(rows, threshold):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, label = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = set()
    for a in range(len(ok)):
        for b in range(a):
            x, y = np.float32(ok[a][1]).astype(float), np.float32(ok[b][1]).astype(float)
            if ok[a][2] == ok[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[ok[a][0]] += 1
                links[ok[b][0]] += 1
                pairs.add((ok[b][0], ok[a][0]))
                p, q = sorted((root(ok[a][0]), root(ok[b][0])))
                label[q] = p
    return links, {i: root(i) for i in label}, pairs


def make(rng, n, dims, noise):
    centres = rng.normal(size=(n // 5, dims))
    rows = []
    for k in range(n):
        c = rng.integers(0, len(centres))
        rows.append((k, [float(np.float32(x)) for x in centres[c] + noise * rng.normal(size=dims)], int(c % 3), "x"))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def test_links_and_components(spark):
    rng = np.random.default_rng(4)
    rows = make(rng, 300, 64, 0.05)
    rows += [(1000 + k, rows[0][1], rows[0][2], "c") for k in range(30)] + [(2000, rows[0][1], None, "c"), (2001, rows[0][1], rows[0][2] + 1, "c")]
    rows += [(3000, None, 1, None), (3001, [], 1, None), (3002, [0.0] * 64, 1, None), (3003, [float("nan")] * 64, 1, None), (3004, [None, 1.0], 1, None), (3005, [1e30] * 64, 1, None), (3006, [1.0, 2.0], 1, None), (3007, [2.0, 4.0], 1, None), (3008, [float("inf")] + [1.0] * 63, 1, None)]
    links, component, _ = brute(rows, 0.93)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for block in (20, 1024):
        got = embedding_dedup(df, block=block).collect()
        assert {r.vec_id: r.n_links for r in got} == links
        assert {r.vec_id: r.component_id for r in got} == component
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup(df.limit(0)).count() == 0
    assert embedding_dedup(df.where("vec_id >= 3000")).count() == 9


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = make(rng, 600, 64, 0.19)  # cosines of a pair of copies spread around the threshold
    links, _, pairs = brute(rows, 0.93)
    got = {r.vec_id: r.n_links for r in embedding_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(pairs) > 150 and all(got[i] <= n for i, n in links.items())
    assert sum(got.values()) >= 0.9 * sum(links.values())


def test_rotation_balances_bits():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32)) * np.linspace(3, 0.5, 32) + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, directions = learn_rotation(x)
    assert directions.shape == (32, 64)
    share = ((x - mean) @ directions >= 0).mean(axis=0)
    assert (abs(share - 0.5) < 0.2).all()
    import pyarrow as pa

    assert np.allclose(unit_rows(pa.array([[3.0, 4.0], [0.0, 2.0]])), [[0.6, 0.8], [0, 1]])


def test_the_exact_setting_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = make(rng, 150, 64, 0.19)
    links, component, pairs = brute(rows, 0.9)
    got = embedding_dedup(spark.createDataFrame(rows, SCHEMA), threshold=0.9, tables=64, radius=64).collect()
    assert len(pairs) > 20 and {r.vec_id: r.n_links for r in got} == links and {r.vec_id: r.component_id for r in got} == component


def test_recall_with_a_common_direction(spark):
    rng = np.random.default_rng(8)
    common = rng.normal(size=64) * 2.6
    centres = rng.normal(size=(300, 64)) + common
    rows = [(2 * k + h, [float(np.float32(x)) for x in centres[k] + 0.62 * rng.normal(size=64)], 1, "x") for k in range(300) for h in (0, 1)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.median((x @ x.T)[np.triu_indices(len(x), 1)]) > 0.75
    links, _, pairs = brute(rows, 0.93)
    got = {r.vec_id: r.n_links for r in embedding_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(pairs) > 100 and all(got[i] <= n for i, n in links.items())
    assert sum(got.values()) >= 0.9 * sum(links.values())


def test_planted_copies_are_linked_once(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 32))
    rows = [(100 * k + h, [float(np.float32(x)) for x in base[k] * (1 + h) + 0.02 * h * rng.normal(size=32)], k % 2, "x") for k in range(40) for h in range(6)]
    links, component, _ = brute(rows, 0.93)
    for block in (16, 1024):
        got = embedding_dedup(spark.createDataFrame(rows, SCHEMA).repartition(7), block=block).collect()
        assert {r.vec_id: r.n_links for r in got} == links and {r.vec_id: r.component_id for r in got} == component and sum(r.kept for r in got) == 40
