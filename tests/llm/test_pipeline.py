"""The pipeline's stages on a small corpus against brute force, stage by stage."""

import hashlib
import re

from test_near_copies import brute

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(90001, None, "en", "src0", None), (90002, "1234 --- 99", "en", None, 5), (90003, "the of and to in is that it was for on are", None, "src1", 9), (90003, "the of and to in is that it was for on are", None, "src1", 9)], docs.schema)
    docs = docs.unionByName(more)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "source_mixing", "bpe"]
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], DATA).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    for t in tables[1:5]:
        assert t.columns == docs.columns
    first, spoken, exact, near, mixed, last = [t.collect() for t in tables]
    assert {r.doc_id for r in first} - {r.doc_id for r in spoken} == {90001, 90002}
    best = {}
    for r in spoken:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        best[key] = min(best.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(best.values())
    want = brute([(r.doc_id, r.text) for r in exact])  # five words, similarity 0.8
    assert sorted(r.doc_id for r in near) == sorted(set(want.values()))
    assert {r.doc_id for r in mixed} == {r.doc_id for r in near} and len(mixed) >= len(near)
    text = {r.doc_id: r.text for r in near}
    assert len(last) == len(mixed)
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in last)
    assert corpus_pipeline.run(spark, DATA).count() > 0
