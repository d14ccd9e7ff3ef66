"""What the subpackage registers."""

import duckdb

from papyrion.llm.queries import ORACLES, QUERIES


def test_oracles_are_sql_text():
    tables = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        tables.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    for name, sql in ORACLES.items():
        assert name in QUERIES and isinstance(sql, str)
        tables.execute(f"EXPLAIN {sql}")
    assert [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))


def test_limits_and_quantiles_of_the_whole_table(spark):
    from tokenizers import Tokenizer

    from papyrion.llm.queries import BYTE_BPE, CONTEXT_LIMITS, SHARES, token_limits

    folder = "/root/testdata/sf0.001"
    whole = Tokenizer.from_file(BYTE_BPE)
    n = sorted(len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect())
    got = {(r.kind, r.at): (r.value, r.tokens) for r in token_limits(spark, folder).collect()}
    assert len(got) == len(CONTEXT_LIMITS) + len(SHARES)
    for c in CONTEXT_LIMITS:
        assert got["limit", c] == (sum(x > c for x in n), sum(min(x, c) for x in n))
    for q in SHARES:
        assert got["quantile", q][0] == min(x for x in n if sum(y <= x for y in n) >= q * len(n))
