"""Titles and tokens that many rows share are compared once."""

import random

from papyrion.operators import matching, retrieval


def test_best_similar_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, rng.choice("AB"), rng.randrange(2), rng.choice(["red ring", "red rings", "rod ring", "blue bolt", "bolt blue x", "", "zq"])) for k in range(40)]
    rows += [(1, "A", 0, "red ring q"), (50, None, 0, "red ring"), (51, "C", 1, "green nut"), (52, "C", 1, "green nuts"), (52, "C", 1, "greens nuts")]
    p = spark.createDataFrame(rows, "k long, g string, s int, form string")
    best = {}
    for k, g, s, f in rows:
        for c, h, t, o in rows:
            if k != c and g == h and g is not None and s == t and f and o:
                score = matching.SequenceMatcher(a=f, b=o).ratio()
                if score >= 0.6:
                    best[k] = max(best.get(k, (0,)), (score, s, -c))
    found = {r.k: (r.title_score, r.candidate) for r in matching.best_similar(p, "k", ["g", "s"], "form", "s", 0.6).collect()}
    assert found == {k: (x[0], -x[2]) for k, x in best.items()}


def test_equal_titles_are_not_compared(spark):
    p = spark.range(40_000).selectExpr("id AS k", "'A' AS g", "1 AS s", "'red ring' AS form")
    assert [tuple(r) for r in matching.best_similar(p, "k", ["g", "s"], "form", "s", 0.6).where("k < 2 or candidate > 1").orderBy("k").collect()] == [(0, 1, 1.0, 0.0), (1, 0, 1.0, 0.0)]


def test_weighted_overlap_is_made_by_classes(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    fields = [(k, f, t) for k in range(12) for f, t in (("terms", f"t{k % 3}"), ("expressions", f"e{k % 2}"), ("domain", "d"))] + [(None, "terms", "t1"), (3, "terms", None), (3, "terms", "t0")]
    f = spark.createDataFrame(fields, "id long, field string, token string")
    wanted = f.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    out = retrieval.weighted_overlap(wanted, f)
    found = {(r.query_id, r.id): r.overlap for r in out.collect()}
    import math

    good = {x for x in fields if x[2] is not None}
    idf = {t: math.log(13 / (len({i for i, _, u in good if u == t and i is not None}) + 1)) + 1 for _, _, t in good}
    brute = {}
    for q, qf, qt in good:
        for i, g, t in good:
            if q is not None and q % 5 == 0 and (qf, qt) == (g, t):
                brute[q, i] = brute.get((q, i), 0) + idf[t] * {"terms": 1, "expressions": 2, "domain": 1}[g]
    assert found.keys() == brute.keys() and out.count() == len(brute)
    assert all(abs(found[k] - brute[k]) < 1e-9 for k in brute)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate" not in plan[: plan.index("Generate")]  # before, all pairs were aggregated


def test_overlaps_are_rounded_by_classes(spark):
    """Neither is a pair rounded, nor do the pairs of a block of queries with a block of documents meet in one loop."""
    from papyrion.plans import stores

    plan = stores.weighted_overlaps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    inner, outer = plan.index("Generate explode(ids"), plan.index("Generate explode(queries")
    assert "round(" in plan and "round(" not in plan[:outer] and "Repartition" in plan[inner:outer]
