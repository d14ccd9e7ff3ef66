"""Language identification: held-out accuracy, the fusion by hand, and awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrion.llm.language_id import TextModel, accepted_documents, declared_logs, fit_text_model, identify_pages, language_id, normalised, Scorer

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1").where("n_chars > 200")
    model = fit_text_model(train, "text", "lang", 300)
    scorer = Scorer(model, 0.1)
    rows = test.select("lang", "text").collect()
    right = sum(model.names[int(normalised(scorer.score(r.text)[0]).argmax())] == r.lang for r in rows)
    assert right / len(rows) > 0.97


def test_fusion_by_hand():
    model = TextModel({("aa", " x "): 5, ("bb", " y "): 5})
    names = model.names
    assert names == ["aa", "bb", "und"]
    assert declared_logs(names, "aa-XX", 0.8).tolist() == pytest.approx([math.log(0.8), math.log(0.1), math.log(0.1)])
    assert declared_logs(names, "zz", 0.8).tolist() == [0, 0, 0]
    logs, n = Scorer(model, 0.5).score("x x y")
    assert n == 3
    px, py = math.log(5.5 / 6.5), math.log(0.5 / 6.5)
    assert logs[0] == pytest.approx(0.5 * (2 * px + py)) and logs[2] == pytest.approx(0.5 * 3 * -math.log(3))


def test_awkward_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(200).withColumn("__text", F.lit(1)).withColumn("lang2", F.lit("x"))
    more = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", None, "src0", 0), (9003, "12 345 !!", "en", "src0", 3), (None, "the of and to in that it was for", "xx", None, 1), (9004, "汉字汉字 ЖЩЮ фыва олдж " * 50, None, "src1", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    df = docs.drop("__text", "lang2").unionByName(more)
    got = {r.doc_id: r for r in language_id(df, sample=150).collect()}
    assert len(got) == 205
    assert not any(got[k].accepted for k in (9001, 9002, 9003, 9004)) and got[None].lang == "en"
    kept = accepted_documents(df, sample=150)
    assert kept.columns == df.columns and kept.count() == 201
    assert language_id(df.limit(0)).count() == 0


def test_pages_use_markup_suffix_and_host(spark):
    rows = [(k, f"https://a.b.fr/{k}", '<html lang="fr"><script>the of</script><p>le la les des</p>') for k in range(20)]
    rows += [(100, "https://a.b.fr/x", "<html><p>a</p>"), (101, "https://z.com/", "<html><p>a</p>"), (102, None, None)]
    got = {r.page_id: r for r in identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=["page_id"]).collect()}
    assert got[3].__getitem__("__lang") == "fr" and got[100].__getitem__("__lang") == "fr"
    assert got[100].__getitem__("__probability") > got[101].__getitem__("__probability") or got[101].__getitem__("__lang") != "fr"
    assert np.isclose(got[102].__getitem__("__probability"), 0)


def test_every_declared_language_is_modelled(spark):
    common = spark.range(6000).selectExpr("id doc_id", "concat('the of and to in that it was for ', id) text", "'en' lang")
    rare = spark.createDataFrame([(9001, "zażółć gęślą jaźń", "pl"), (9002, "ação não coração", "pt-BR")], common.schema)
    same = spark.range(5000).selectExpr("1L doc_id", "'yksi kaksi kolme' text", "'fi' lang")
    names = fit_text_model(common.unionByName(rare).unionByName(same), "text", "lang", 50, per_language=5).names
    assert {"en", "fi", "pl", "pt"} <= set(names)


def by_hand(rows, models, spots, temper=0.1, trust=0.9, suffix_trust=0.7, strength=10.0, least=0.5):
    """The whole fusion row by row; rows (text, said, suffix, host, parent)."""
    from papyrion.llm.language_id import SUFFIXES

    names = models[0].names
    size = len(names)
    scored = [Scorer(models[s % 2], temper).score(r[0] or "") for r, s in zip(rows, spots, strict=True)]
    own = [normalised(x) if n else None for x, n in scored]
    hosts, parents, top = {}, {}, np.zeros(size)
    for r, p in zip(rows, own, strict=True):
        if p is not None:
            hosts[r[3], r[4]] = hosts.get((r[3], r[4]), 0) + p
            parents[r[4]] = parents.get(r[4], 0) + p
            top = top + p
    root = (top + strength / size) / (top.sum() + strength)
    for r, p, (logs, n) in zip(rows, own, scored, strict=True):
        if not n:
            yield "und", 0.0, "und", False
            continue
        base = (parents[r[4]] + strength * root) / (parents[r[4]].sum() + strength)
        rest = np.maximum(hosts[r[3], r[4]] - p, 0)
        total = logs + np.log((rest + strength * base) / (rest.sum() + strength)) + declared_logs(names, r[1], trust) + declared_logs(names, SUFFIXES.get(r[2] or ""), suffix_trust)
        q = normalised(total)
        best = int(q.argmax())
        yield names[best], q[best], names[int(p.argmax())], names[best] != "und" and q[best] >= least


def test_the_whole_fusion_by_hand(spark):
    from papyrion.llm.language_id import fit_text_models, identify, spot

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 150").select("doc_id", "text", "lang", "source")
    more = [(9000 + k, "ab cd", None, "src0") for k in range(30)] + [(9100, "le la les des " * 30_000, "fr", "big"), (9101, None, "en", "src1"), (9102, "", None, None), (9103, "der die und", "EN-us", None), (9104, "汉字 12", "xx", "big")]
    more += [(9200, "the of and to", "en", "src2")] * 40
    df = docs.unionByName(spark.createDataFrame(more, docs.schema)).selectExpr("*", "if(doc_id % 3 = 0, 'at', if(doc_id % 5 = 0, 'zz', null)) suffix", "concat('p', doc_id % 2) parent", "1 AS __text", "2 AS __host", "3 AS row")
    found = identify(df, F.col("text"), F.col("lang"), F.col("source"), F.col("parent"), F.col("suffix"), keep=["doc_id", "__text", "row"], sample=100)
    got = sorted((r.doc_id, r["__lang"], r["__probability"], r["__text_lang"], r["__accepted"], r["__text"], r.row) for r in found.collect())
    named = df.select(F.col("text"), F.lit(0).alias("x"), F.col("lang").alias("said"), F.col("suffix"), F.col("source").alias("host"), "parent", spot(df).alias("spot"), "doc_id")
    models = fit_text_models(named, "text", "said", 100, folds=2, spot_col="spot")
    rows = named.collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, by_hand([(r.text, r.said, r.suffix, r.host, r.parent) for r in rows], models, [r.spot for r in rows]), strict=True)]
    want.sort(key=lambda w: (w[0], w[1], w[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g[0], g[1], g[3], g[4]) == (w[0], w[1], w[3], bool(w[4])) and math.isclose(g[2], w[2], abs_tol=1e-9) and g[5:] == (1, 3)


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    from papyrion.llm.language_id import fit_text_models

    rows = [(k, f"qx{chr(97 + k)}zj", "pl" if k % 2 else "fi") for k in range(10)]
    df = spark.createDataFrame(rows, "spot long, text string, lang string")
    models = fit_text_models(df, "text", "lang", sample=10**6, folds=2, spot_col="spot")
    assert models[0].names == models[1].names
    for k, text, _ in rows:
        assert text[1:4] not in models[k % 2].grams and text[1:4] in models[1 - k % 2].grams


def test_accepted_documents_keep_columns_of_any_name(spark):
    rows = [(1, "the of and to in that it was for", "en", "s", "A", 7, "h"), (2, None, None, "s", "B", 8, "i"), (3, "der die das und ist nicht", "de", None, "C", 9, "j"), (3, "der die das und ist nicht", "de", None, "C", 9, "j"), (4, "x " * 400_000 + "the of and", "en", "s", "D", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __text string, __host int, `a.b` string")
    got = sorted(tuple(r) for r in accepted_documents(df).collect())
    assert got[:3] == [rows[0], rows[2], rows[3]] and accepted_documents(df).columns == df.columns
