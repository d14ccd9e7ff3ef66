"""Line chains against enumeration, features against plain Python, and held-out accuracy."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from papyrion.llm.quality import FEATURES, LONGEST, OWN, Chain, Model, document_quality, features, fit_quality, score_quality, weighted

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, id int"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lines = rng.normal(size=(9, 4))
    chain = Chain(rng.normal(size=4), rng.normal(size=(2, 2)))
    counts = np.array([1, 0, 5, 3])
    good, expected = chain.marginals(lines, counts, pairs=True)
    pairs = np.zeros((2, 2))
    for begin, n in ((0, 1), (1, 5), (6, 3)):
        weight, mass, moved = {}, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            energy = sum(y[k] * float(lines[begin + k] @ chain.weights) for k in range(n)) + sum(chain.moves[y[k], y[k + 1]] for k in range(n - 1))
            weight[y] = np.exp(energy)
        total = sum(weight.values())
        for y, w in weight.items():
            mass += np.array(y) * w / total
            for a, b in itertools.pairwise(y):
                moved[a, b] += w / total
        pairs += moved
        assert np.allclose(good[begin : begin + n], mass)
    assert np.allclose(expected, pairs)


def test_features_are_the_plain_ones():
    texts = ["Ab ab AB!\n\n  x$$ x$$ y%  \nAb ab AB!", "", "é 12 ... one.", " \n ", "one two"]
    got, size, counts = features(pa.array(texts))
    assert counts.tolist() == [3, 0, 1, 0, 1] and got.shape == (5, FEATURES)
    a, b, c = got[0], got[1], got[2]
    assert size.tolist() == [9, 14, 9, 14, 7]
    assert np.isclose(a[1], 3 / 7) and np.isclose(a[4], 1 / 7) and np.isclose(a[7], 1) and a[13] == 1 and a[14] == 0 and np.isclose(a[11], 1 / 3)
    assert np.isclose(b[7], 2 / 3) and np.isclose(b[8], 1 / 3) and np.isclose(b[9], 1) and np.isclose(b[12], np.log1p(3) - np.log1p(2))
    assert c[14] == 1 and np.allclose(b[OWN : 2 * OWN], a[:OWN]) and np.allclose(b[2 * OWN : 3 * OWN], c[:OWN]) and b[-3:].tolist() == [1, 1, 1] and a[-3:].tolist() == [0, 1, 1]
    assert np.isclose(got[3][10], 1 / 4) and np.isclose(got[3][2], 2 / 11)
    sliced = pa.array(["zz"] + texts).slice(1)
    assert np.array_equal(features(sliced)[0], got)


def test_long_lines_are_cut_at_white_space():
    words = [f"w{k}" for k in range(30_000)]
    got, size, counts = features(pa.array([" ".join(words), "q" * (3 * LONGEST)]))
    assert size.max() <= LONGEST and counts[1] == 3 and size[: counts[0]].sum() == len(" ".join(words))
    assert np.all(got[: counts[0], 7] == 1)


def test_weights_are_lengths():
    assert weighted(np.array([1.0, 0.0, 0.5]), np.array([30.0, 10.0, 4.0]), np.array([2, 0, 1]), 0.9).tolist() == [0.75, 0.9, 0.5]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = document_quality(docs, labels, 2000)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    marks = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    right = {q: [r.predicted == y for r, y in marks if y == q] for q in (0, 1)}
    assert np.mean(right[0]) > 0.97 and np.mean(right[1]) > 0.99
    brier = np.mean([(r.score - y) ** 2 for r, y in marks])
    assert brier < 0.02  # the scores are probabilities, not only an order


def test_labels_held_out_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet").where("doc_id < 1500") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = fit_quality(docs, labels), fit_quality(docs.selectExpr("doc_id", "text", "'x' AS lang", "doc_id AS source"), turned)
    assert np.array_equal(a.chain.weights, b.chain.weights) and np.array_equal(a.curve, b.curve)


def test_awkward_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet").where("doc_id < 2000") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "Some words. And more."), (4, "Same text here."), (4, "Same text here."), (5, "word. " * 400_000), (6, "$$$ %%% " * 9000)]
    got = [(r.doc_id, r.score, r.held_out) for r in score_quality(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s, _ in got)
    assert {s for i, s, _ in got if i in (1, 2, 3)} == {model.share} and len({s for i, s, _ in got if i == 4}) == 1
    assert not next(h for i, _, h in got if i is None) and next(s for i, s, _ in got if i == 6) < 0.5
    assert document_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in document_quality(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    ones = labels.selectExpr("doc_id", "1 AS quality")
    assert {r.score for r in document_quality(docs, ones.unionByName(ones)).collect()} == {1.0}
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert {r.predicted for r in document_quality(docs, nulls).collect()} == {0}


def test_one_task_handles_any_batch():
    rng = np.random.default_rng(0)
    texts = pa.array([" ".join(rng.choice(["the", "of", "a$$", "END!!"], size=n)) for n in rng.integers(1, 200, 60)])
    model = Model.fit(texts, np.arange(60) % 3 > 0)
    whole = model.score(texts)
    parts = np.concatenate([model.score(texts.slice(k, 7)) for k in range(0, 60, 7)])
    assert whole == pytest.approx(parts)
