"""Each pipeline stage on awkward tables: very long, repeated, null and empty texts, columns of any name, no rows."""

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __k1 string, __pass int, __text string, row string, `a.b` int, id long"
ENGLISH = "the of and to in is that it was for on are as with his they be at one have this"


def table(spark):
    rows = [
        (1, ENGLISH, "en", "s", 1, "k", 1, "t", "r", 1, 7),
        (1, ENGLISH, "en", "s", 1, "k", 1, "t", "r", 1, 7),
        (2, "by not but what all were we when your can said with his they be at one " * 20_000, "en", "s", 2, "k2", 2, "t2", "r2", 2, 8),
        (3, None, "en", "s", 3, "k3", 3, "t3", "r3", 3, 9),
        (4, "", None, None, 4, "k4", 4, "t4", "r4", 4, 10),
        (None, "der die das und ist nicht ein eine mit von zu den", "de", None, 5, "k5", 5, "t5", "r5", 5, 11),
        (6, "le la les des un une que est pour qui dans par plus", "fr", "s6", 6, None, None, None, None, None, None),
    ]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows, df = table(spark)
    out = stage(spark, df, "")
    got = [tuple(r) for r in out.collect()]
    if name == "bpe":
        assert len(got) == len(rows) and {r[1] for r in got if r[0] in (3, 4)} == {0}
    else:
        assert out.columns == df.columns and set(got) <= set(rows)
        kept = {r[0] for r in got}
        assert kept == {"language_id": {1, 2, None, 6}, "exact_dedup": {1, 2, 3, None, 6}, "simhash_dedup": {1, 2, 3, None, 6}, "source_mixing": {1, 2, 3, 4, None, 6}}[name]
        if name != "source_mixing":
            assert sum(r[0] == 1 for r in got) == (2 if name == "language_id" else 1)
    assert stage(spark, df.limit(0), "").count() == 0
