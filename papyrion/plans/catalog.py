"""The library's operators on the driver's tables, each with its DuckDB form where SQL has one.

The tables stand in for the operators' own: orders for queued papers and their statements,
lineitem for edges, part for terms and definitions, events for state logs and streams,
documents and benchmark for a corpus and its queries, pages for web sources.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import ids, text
from papyrion.operators import definitions, dependencies, graph, indexing, latex, matching, mentions, provider, queue, retrieval
from papyrion.sources import sinks
from papyrion.sources.tables import table
from papyrion.streaming import events as streams
from papyrion.workspace import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENS = r"""list_transform(regexp_extract_all(coalesce(text, ''), '(\\[A-Za-z]+)|(\\[^A-Za-z\s])|([A-Za-z0-9]+)|([^\s])'), lambda x: CASE WHEN starts_with(x, '\') THEN x ELSE lower(x) END)"""
CANON = r"""trim(regexp_replace(regexp_replace(replace({}, '$', ''), '([\[\](){{}},=+\-*/<>:])', ' \1 ', 'g'), '\s+', ' ', 'g'))"""


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Queue and state


@query("""
    WITH best AS (SELECT o_custkey AS base, max(o_orderkey) AS version FROM orders GROUP BY 1)
    SELECT base || 'v' || version AS arxiv_id, base, CAST(floor(c_acctbal) AS BIGINT) AS citation_count
    FROM best JOIN customer ON base = c_custkey WHERE c_mktsegment <> 'BUILDING'""")
def vip_selection(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("base"), F.col("o_orderkey").alias("version"), F.concat_ws("v", "o_custkey", "o_orderkey").alias("arxiv_id"))
    c = table(spark, folder, "customer")
    cited = c.select(F.col("c_custkey").alias("base"), F.floor("c_acctbal").alias("citation_count"))
    return queue.vip_selection(o, cited, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("base"))).select("arxiv_id", "base", "citation_count")


@query("""
    WITH q AS (SELECT DISTINCT user_id || '.' || 'v' || (event_id % 23) AS arxiv_id, user_id || '.' AS base, event_id % 23 AS version FROM events),
         m AS (SELECT *, max(version) OVER (PARTITION BY base) AS top FROM q)
    SELECT arxiv_id, base, CAST(version AS INTEGER) AS version, version = top AS kept FROM m""")
def dedup_latest_version(spark, folder):
    ids_ = table(spark, folder, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(".v"), (F.col("event_id") % 23).cast("string")).alias("arxiv_id")).distinct()
    return queue.latest_versions(ids_)


@query("""
    WITH u AS (SELECT o_custkey AS id, 0 AS ord FROM orders UNION ALL SELECT c_custkey, 1 FROM customer UNION ALL SELECT s_suppkey, 2 FROM supplier)
    SELECT id, min(ord) AS ord FROM u GROUP BY id""")
def stable_union_ids(spark, folder):
    return queue.stable_union(table(spark, folder, "orders").select("o_custkey"), table(spark, folder, "customer").select("c_custkey"), table(spark, folder, "supplier").select("s_suppkey"))


@query("""
    WITH l AS (SELECT DISTINCT c_custkey AS id FROM customer), r AS (SELECT DISTINCT o_custkey AS id FROM orders)
    SELECT count(*) AS n_union, count(*) FILTER (r.id IS NULL) AS only_left, count(*) FILTER (l.id IS NULL) AS only_right,
           count(*) FILTER (l.id IS NOT NULL AND r.id IS NOT NULL) AS n_both FROM l FULL JOIN r ON l.id = r.id""")
def set_consistency(spark, folder):
    return queue.consistency(table(spark, folder, "customer").select("c_custkey"), table(spark, folder, "orders").select("o_custkey"))


@query("""
    SELECT DISTINCT user_id AS id, user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) AS retry
    FROM events WHERE event_type = 'view'""")
def retry_partition(spark, folder):
    e = table(spark, folder, "events").withColumnRenamed("user_id", "id")
    return queue.retries_first(e.where("event_type = 'view'").select("id").distinct(), e.where("event_type = 'purchase' and value > 90"))


@query("""
    WITH n AS (SELECT o_custkey, o_totalprice, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)
    SELECT coalesce(c_custkey, o_custkey) AS id, CASE WHEN r IS NULL THEN c_acctbal ELSE o_totalprice END AS amount,
           CASE WHEN r IS NULL THEN c_mktsegment ELSE o_orderpriority END AS label
    FROM customer FULL JOIN (SELECT * FROM n WHERE r = 1) ON c_custkey = o_custkey""")
def upsert_fold(spark, folder):
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("label"))
    new = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("label"), "o_orderkey")
    return queue.upsert(old.withColumn("o_orderkey", F.lit(None).cast("long")), new, ["id"], F.col("o_orderkey")).drop("o_orderkey")


@query("""
    SELECT user_id AS paper, arg_max(stage, (ts, event_id)) AS stage, count(*) FILTER (stage = 'processing') AS attempt_count, max(ts) AS updated_at
    FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'click' THEN 'failed' ELSE 'processing' END AS stage FROM events) GROUP BY user_id""")
def ingestion_state(spark, folder):
    stage = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "failed").otherwise("processing")
    e = table(spark, folder, "events").select(F.col("user_id").alias("paper"), "ts", "event_id", stage.alias("stage"))
    return queue.ingestion_state(e, "paper", "stage", F.struct("ts", "event_id"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-15 00:00:00') AS stale FROM events GROUP BY 1")
def freshness_filter(spark, folder):
    stale = queue.should_refresh(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(stale).alias("stale"))


@query("""
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_brand = 'Brand#11' THEN 'skipped' WHEN regexp_matches(lower(p_type), 'lecture|course|notes on|introduction to') THEN 'title'
      WHEN p_size + 10 > 50 THEN 'pages' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'processed' END AS reason FROM part) GROUP BY reason""")
def batch_filter(spark, folder):
    p = table(spark, folder, "part").withColumn("key", F.col("p_partkey"))
    done = table(spark, folder, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("key"))
    marked = queue.batch_filter(p, F.col("p_type"), F.concat((F.col("p_size") + 10).cast("string"), F.lit(" Pages")), p.where("p_brand = 'Brand#11'"), done, "key")
    return marked.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_type AS key, least(min(ts), TIMESTAMP '2024-01-10 00:00:00') AS ts FROM events GROUP BY 1")
def date_cursor(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("key"), "ts")
    start = e.select("key").distinct().withColumn("ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return streams.advance_cursor(start, e, "key", "ts")


# Text and retrieval


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n_tokens FROM documents")
def token_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query(f"""
    WITH t AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents)
    SELECT token, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM t, n GROUP BY token""")
def doc_freq_idf(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    n = d.agg(F.count("*").alias("n"))
    return retrieval.document_frequencies(d).join(F.broadcast(n)).select("token", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


def _bm25_sql(settings: str) -> str:
    return f"""
    p AS (SELECT * FROM (VALUES {settings}) v(k1, b)),
    d AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents), a AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
    q AS (SELECT item_id AS query_id, unnest({TOKENS}) AS token FROM benchmark), qt AS (SELECT query_id, token, count(*) AS qtf FROM q GROUP BY ALL),
    e AS (SELECT id, len(t) AS dl, unnest(t) AS token FROM d), tf AS (SELECT id, dl, token, count(*) AS tf FROM e WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    s AS (SELECT k1, b, query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * dl / avgdl))) AS score
          FROM tf JOIN df USING (token) JOIN qt USING (token), a, p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10)"""


def _bm25(spark, folder, settings=((1.5, 0.75),), k=10):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(d, table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text"), settings, k)


@query(f"WITH {_bm25_sql('(1.5, 0.75)')} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM r")
def bm25_topk(spark, folder):
    return _bm25(spark, folder).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


SWEEP = ((0.6, 0.2), (0.9, 0.5), (1.2, 0.75), (1.5, 0.9), (1.8, 0.75))


@query(f"WITH {_bm25_sql(', '.join(map(str, SWEEP)))} SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b, query_id, id, CAST(rank AS INTEGER) AS rank FROM r")
def bm25_sweep(spark, folder):
    return _bm25(spark, folder, SWEEP).select("k1", "b", "query_id", "id", "rank")


@query(f"""
    WITH {_bm25_sql('(0.9, 0.5), (1.8, 0.75)')},
    f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM r GROUP BY ALL)
    SELECT query_id, id, round(score, 8) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def rrf_fuse(spark, folder):
    runs = _bm25(spark, folder, ((0.9, 0.5), (1.8, 0.75)))
    return retrieval.rrf(runs).select("query_id", "id", F.round("score", 8).alias("score"), "rank")


@query(f"""
    WITH {_bm25_sql('(1.5, 0.75)')},
    h AS (SELECT query_id, id, rank, (query_id % 2 = 0 AND id % 3 = 0) AS matches FROM r)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, matches, CAST(row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, rank) AS INTEGER) AS new_rank FROM h""")
def type_hint_rerank(spark, folder):
    types = table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 == 0, "Lemma").otherwise("other").alias("type"))
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "By the Lemma").otherwise("nothing").alias("text"))
    found = _bm25(spark, folder).select("query_id", F.col("id").cast("string").alias("id"), "rank")
    return retrieval.rerank_by_hint(found, queries, types).withColumn("id", F.col("id").cast("long"))


@query("""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(v.e, q.e) / ((sqrt(list_dot_product(v.e, v.e)) + 1e-9) * (sqrt(list_dot_product(q.e, q.e)) + 1e-9)) AS score FROM v, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r""")
def dense_topk(spark, folder):
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return retrieval.dense_topk(v, q).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


METRICS = f"""{_bm25_sql('(1.5, 0.75)')},
    rel AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM benchmark, labels WHERE quality = 1 AND doc_id % 8 = item_id % 9),
    nr AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
    h AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, count(*) AS found, min(rank) AS first_rank FROM r JOIN rel USING (query_id, id) GROUP BY 1),
    m AS (SELECT item_id AS query_id, coalesce(n_relevant, 0) AS n_relevant,
          CASE WHEN n_relevant > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg,
          CASE WHEN n_relevant > 0 THEN coalesce(found, 0) / n_relevant END AS recall, CASE WHEN n_relevant > 0 THEN CAST(coalesce(found, 0) > 0 AS INT)::DOUBLE END AS hit,
          CASE WHEN n_relevant > 0 THEN CAST(first_rank AS DOUBLE) END AS first_rank, text
          FROM benchmark LEFT JOIN nr ON item_id = nr.query_id LEFT JOIN h ON item_id = h.query_id)"""


def _metrics(spark, folder):
    b = table(spark, folder, "benchmark")
    good = table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 8).alias("m"))
    qrels = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 9).alias("m")).join(good, "m")
    return retrieval.query_metrics(_bm25(spark, folder), qrels, b.select(F.col("item_id").alias("query_id")))


@query(f"WITH {METRICS} SELECT query_id, n_relevant, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, hit, first_rank FROM m")
def ranking_metrics(spark, folder):
    return _metrics(spark, folder).withColumns({c: F.round(c, 6) for c in ("ndcg", "recall")}).withColumn("first_rank", F.col("first_rank").cast("double"))


@query(f"WITH {METRICS} SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, count(*) AS n_queries FROM m WHERE n_relevant > 0")
def mean_metrics(spark, folder):
    return retrieval.mean_metrics(_metrics(spark, folder)).withColumns({c: F.round(c, 6) for c in ("ndcg", "recall", "hit")})


@query(f"""
    WITH {METRICS}, j AS (SELECT hit, 's' || (query_id % 2) AS style, len(string_split(text, ' ')) AS w, query_id % 4 AS refs FROM m WHERE n_relevant > 0),
    k AS (SELECT hit, style, CASE WHEN w <= 6 THEN '0-6' WHEN w <= 12 THEN '7-12' WHEN w <= 20 THEN '13-20' ELSE '21+' END AS length, CASE WHEN refs = 0 THEN '0' WHEN refs = 1 THEN '1' ELSE '2+' END AS refs FROM j)
    SELECT 'style' AS stratum, style AS bucket, round(avg(hit), 6) AS hit, count(*) AS n FROM k GROUP BY style
    UNION ALL SELECT 'length', length, round(avg(hit), 6), count(*) FROM k GROUP BY length UNION ALL SELECT 'refs', refs, round(avg(hit), 6), count(*) FROM k GROUP BY refs""")
def strata_metrics(spark, folder):
    q = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("s"), (F.col("item_id") % 2).cast("string")).alias("style"), F.size(F.split("text", " ")).alias("n_words"), (F.col("item_id") % 4).alias("n_refs"))
    return retrieval.strata(_metrics(spark, folder), q).withColumn("hit", F.round("hit", 6))


STRUCTURED = """
    p AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 3) AS t FROM part),
    e AS (SELECT DISTINCT id, unnest(t) AS token FROM p), n AS (SELECT count(*) AS n FROM p),
    i AS (SELECT token, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM e, n GROUP BY token)"""


def _structured(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_brand", text.structured_tokens(F.split("p_name", " ")).alias("tokens"))


@query(f"WITH {STRUCTURED} SELECT token, round(idf, 6) AS idf FROM i")
def structured_idf(spark, folder):
    return retrieval.structured_idf(_structured(spark, folder)).withColumn("idf", F.round("idf", 6))


@query(f"""
    WITH {STRUCTURED}, q AS (SELECT p_brand AS query_id, unnest(list_filter(string_split(lower(min(p_name)), ' '), lambda x: length(x) >= 3)) AS token FROM part GROUP BY 1)
    SELECT query_id, id, round(sum(idf), 5) AS overlap FROM (SELECT DISTINCT * FROM q) JOIN e USING (token) JOIN i USING (token) GROUP BY ALL""")
def structured_overlap(spark, folder):
    fields = _structured(spark, folder)
    asked = table(spark, folder, "part").groupBy(F.col("p_brand").alias("query_id")).agg(F.min("p_name").alias("q")).select("query_id", F.explode(text.structured_tokens(F.split("q", " "))).alias("token"))
    return retrieval.structured_overlap(fields, asked).withColumn("overlap", F.round("overlap", 5))


@query(r"""
    WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.?!]) ', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence, CASE WHEN i > 1 THEN s[i - 1] END AS previous, CASE WHEN i < len(s) THEN s[i + 1] END AS following
    FROM s, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)""")
def sentence_context(spark, folder):
    return mentions.sentence_context(table(spark, folder, "documents"), "doc_id", "text")


@query(f"SELECT p_partkey, {CANON.format("p_name || ' = (' || p_type || ')/' || p_brand")} AS canonical FROM part")
def canonical_strings(spark, folder):
    joined = F.concat("p_name", F.lit(" = ("), "p_type", F.lit(")/"), "p_brand")
    return table(spark, folder, "part").select("p_partkey", text.canonical(joined).alias("canonical"))


# Graphs


EDGES = "e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"
REACH = """u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    w AS (SELECT a AS v, a AS c FROM u UNION SELECT u.b, w.c FROM w JOIN u ON u.a = w.v), comp AS (SELECT v, min(c) AS component FROM w GROUP BY v)"""


def _nation_edges(spark, folder):
    c = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return c.union(table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))


@query(f"""
    WITH RECURSIVE {EDGES}, {REACH}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1),
    l AS (SELECT component, count(*) AS n_edges FROM e JOIN comp ON v = src GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY size DESC, component) AS INTEGER) AS rank, component, size, n_edges FROM s JOIN l USING (component) QUALIFY rank <= 10""")
def components_topk(spark, folder):
    return graph.top_components(_nation_edges(spark, folder), 10, 2)


@query(f"""
    WITH RECURSIVE {EDGES}, {REACH}, d AS (SELECT src AS vertex, count(*) AS out_degree FROM e GROUP BY 1)
    SELECT component, vertex, out_degree, CAST(row_number() OVER (PARTITION BY component ORDER BY out_degree DESC, vertex) AS INTEGER) AS place FROM d JOIN comp ON v = vertex QUALIFY place <= 20""")
def component_degrees(spark, folder):
    return graph.top_degrees(_nation_edges(spark, folder), 20)


@query()
def components_orders_parts(spark, folder):
    li = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    return graph.top_components(li, 5)


@query("""
    SELECT DISTINCT id FROM (SELECT l_orderkey AS id FROM lineitem UNION SELECT l_partkey FROM lineitem) WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def placeholder_nodes(spark, folder):
    nodes = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return graph.placeholders(nodes, table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")))


@query("""
    SELECT l_suppkey AS source, l_partkey AS target, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS kind FROM lineitem GROUP BY 1, 2""")
def edge_dedup(spark, folder):
    e = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("kind"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return graph.dedup_edges(e, "ord").select("source", "target", "kind")


@query("""
    SELECT o_orderstatus AS status, count(DISTINCT o_orderkey) AS n_nodes, count(l_orderkey) AS n_edges, count(*) FILTER (l_returnflag = 'N') AS n_reference,
           count(*) FILTER (l_returnflag <> 'N') AS n_dependency FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def graph_stats(spark, folder):
    li = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("e"), F.count_if(F.col("l_returnflag") == "N").alias("r"))
    o = table(spark, folder, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_orderstatus").alias("status"))
    zero = F.lit(0)
    return o.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("e"), zero).alias("n_edges"), F.coalesce(F.sum("r"), zero).alias("n_reference"), F.coalesce(F.sum(F.col("e") - F.col("r")), zero).alias("n_dependency"))


@query("""
    WITH l AS (SELECT p_name AS label, max(p_partkey) AS node_id FROM part GROUP BY 1),
    n AS (SELECT trim(regexp_replace(lower(trim(label)), '[:\\-\\s_]+', ':', 'g'), ':') AS n, min(node_id) AS by_form, count(*) AS many FROM l GROUP BY 1),
    r AS (SELECT p_partkey + 1 AS source, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(replace(p_name, ' ', '_-')) END AS label FROM part),
    j AS (SELECT source, r.label, coalesce(l.node_id, CASE WHEN many = 1 AND n.n <> '' THEN by_form END) AS target FROM r LEFT JOIN l ON r.label = l.label
          LEFT JOIN n ON n.n = trim(regexp_replace(lower(trim(r.label)), '[:\\-\\s_]+', ':', 'g'), ':'))
    SELECT source, label, target FROM j WHERE target IS NOT NULL AND target <> source""".replace("\\\\", "\\"))
def label_resolution(spark, folder):
    p = table(spark, folder, "part")
    labels = p.groupBy(F.col("p_name").alias("label")).agg(F.max("p_partkey").alias("node_id"))
    label = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit("_-"))))
    return graph.resolve_labels(p.select((F.col("p_partkey") + 1).alias("source"), label.alias("label")), labels)


@query("""
    WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5),
    m AS (SELECT query_id, l_partkey + 1000000000 AS id, min((rank, l_linenumber)) AS spot FROM r JOIN lineitem ON id = l_orderkey JOIN part ON p_partkey = l_partkey WHERE split_part(p_type, ' ', 1) IN ('ECONOMY', 'LARGE', 'SMALL') GROUP BY 1, 2),
    s AS (SELECT query_id, max(rank) AS last FROM r GROUP BY 1)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, false AS expanded FROM r
    UNION ALL SELECT query_id, CAST(last + row_number() OVER (PARTITION BY query_id ORDER BY spot, id) AS INTEGER), id, true FROM m JOIN s USING (query_id)""")
def prereq_expand(spark, folder):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    results = table(spark, folder, "orders").withColumn("rank", place).where("rank <= 5").select(F.col("o_custkey").alias("query_id"), "rank", F.col("o_orderkey").cast("string").alias("id"))
    shift = (F.col("l_partkey") + 1_000_000_000).cast("string")
    edges = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), shift.alias("target"), F.col("l_linenumber").alias("ord"))
    types = table(spark, folder, "part").select((F.col("p_partkey") + 1_000_000_000).cast("string").alias("id"), F.split("p_type", " ")[0].alias("type"))
    out = graph.expand_results(results, edges, types, ["ECONOMY", "LARGE", "SMALL"])
    return out.withColumn("id", F.col("id").cast("long"))


@query("""
    WITH n AS (SELECT l_orderkey AS paper, count(*) AS n_nodes FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey AS paper, count(*) AS n_edges FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
    SELECT paper, CAST(n_nodes AS INTEGER) AS n_nodes, CAST(coalesce(n_edges, 0) AS INTEGER) AS n_edges FROM n LEFT JOIN e USING (paper)""")
def graph_documents(spark, folder):
    li = table(spark, folder, "lineitem")
    nodes = li.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("kind"))
    edges = li.where("l_linenumber > 1").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("source"), (F.col("l_linenumber") - 1).alias("target"), F.lit("used_in").alias("dependency_type"))
    return sinks.graph_json(nodes, edges).select("paper", "n_nodes", "n_edges")


# Dependencies and definitions


@query("""
    WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT v.event_id, v.user_id, v.ts, p.ts AS next_start FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts < p.ts""")
def asof_next_event(spark, folder):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, folder, "events").withColumns({"s": us, "e": us})
    out = dependencies.next_after(e, "user_id", "s", "e", "event_type", "view", "purchase", width=86_400_000_000)
    return out.select("event_id", "user_id", "ts", F.timestamp_micros("next_start").cast("timestamp_ntz").alias("next_start"))


def _terms(spark, folder):
    return table(spark, folder, "part").select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("artifact"), F.explode(F.split("p_name", " ")).alias("term"))


@query("""
    WITH t AS (SELECT DISTINCT p_brand AS paper, p_partkey AS artifact, unnest(string_split(p_name, ' ')) AS term FROM part)
    SELECT DISTINCT x.paper, x.artifact AS a, y.artifact AS b FROM t x JOIN t y ON x.paper = y.paper AND x.term = y.term AND x.artifact < y.artifact""")
def candidate_pairs_overlap(spark, folder):
    return dependencies.overlap_pairs(_terms(spark, folder))


@query("""
    WITH t AS (SELECT DISTINCT p_brand AS paper, p_partkey AS artifact, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_type END AS term FROM part),
    w AS (SELECT DISTINCT term, list_distinct(regexp_extract_all(term, '[a-zA-Z0-9_]+|\\?[a-zA-Z@]+')) AS words FROM t),
    s AS (SELECT x.term AS narrow, y.term AS wide FROM w x JOIN w y ON x.term <> y.term AND len(x.words) > 0 AND list_has_all(y.words, x.words))
    SELECT DISTINCT a.paper, least(a.artifact, b.artifact) AS a, greatest(a.artifact, b.artifact) AS b
    FROM t a JOIN s ON a.term = narrow JOIN t b ON b.term = wide AND b.paper = a.paper AND a.artifact <> b.artifact""".replace("\\\\", "\\"))
def candidate_pairs_subword(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("artifact"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("term"))
    return dependencies.subword_pairs(p)


@query("""
    SELECT x.n_regionkey AS paper, CASE WHEN x.n_nationkey % 5 > y.n_nationkey % 5 OR (x.n_nationkey % 5 = y.n_nationkey % 5 AND x.n_nationkey > y.n_nationkey) THEN y.n_nationkey ELSE x.n_nationkey END AS source,
           CASE WHEN x.n_nationkey % 5 > y.n_nationkey % 5 OR (x.n_nationkey % 5 = y.n_nationkey % 5 AND x.n_nationkey > y.n_nationkey) THEN x.n_nationkey ELSE y.n_nationkey END AS target
    FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey""")
def all_pairs(spark, folder):
    return dependencies.all_pairs(table(spark, folder, "nation").select(F.col("n_regionkey").alias("paper"), F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5).alias("line")))


@query("""
    WITH t AS (SELECT DISTINCT p_brand || p_type AS paper, p_partkey AS artifact, unnest(string_split(p_name, ' ')) AS term FROM part),
    p AS (SELECT DISTINCT x.paper, x.artifact AS a, y.artifact AS b FROM t x JOIN t y ON x.paper = y.paper AND x.term = y.term AND x.artifact < y.artifact),
    c AS (SELECT *, count(*) OVER (PARTITION BY paper) AS n FROM p)
    SELECT c.paper, CASE WHEN pa.p_size >= pb.p_size THEN a ELSE b END AS source, CASE WHEN pa.p_size >= pb.p_size THEN b ELSE a END AS target
    FROM c JOIN part pa ON pa.p_partkey = a JOIN part pb ON pb.p_partkey = b WHERE n <= 100""")
def pair_cap(spark, folder):
    p = table(spark, folder, "part").select(F.concat("p_brand", "p_type").alias("paper"), F.col("p_partkey").alias("id"), F.col("p_size").alias("line"), "p_name")
    pairs = dependencies.capped_overlap_pairs(p.select("paper", F.col("id").alias("artifact"), F.explode(F.split("p_name", " ")).alias("term")), 100)
    return dependencies.directed(pairs, p)


@query("""
    SELECT DISTINCT l_orderkey AS paper, l_suppkey AS source, l_partkey AS target FROM lineitem
    WHERE l_suppkey <> l_partkey AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_returnflag = 'N'""")
def accepted_edges(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "l_returnflag")
    o = table(spark, folder, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("paper"))
    known = li.join(o, "paper", "left_semi")
    nodes = known.select("paper", F.col("source").alias("id")).union(known.select("paper", "target")).distinct()
    old = known.where("l_returnflag <> 'N'")
    fresh = dependencies.accepted_edges(li.where("l_returnflag = 'N'"), nodes, old.where("false"))
    return fresh


@query("""
    SELECT conv_id AS paper, count(*) AS n_nodes, CAST(ceil(sum(length(coalesce(text, '')) + least(length(coalesce(role, '')), 1200)) / 4) AS BIGINT) AS tokens,
           CASE WHEN count(*) <= 30 AND ceil(sum(length(coalesce(text, '')) + least(length(coalesce(role, '')), 1200)) / 4) <= 12000 THEN CASE WHEN count(*) <= 15 THEN 'global' ELSE 'hybrid' END ELSE 'pairwise' END AS mode
    FROM conversations GROUP BY 1""")
def token_budget_mode(spark, folder):
    return dependencies.choose_mode(table(spark, folder, "conversations").withColumnRenamed("conv_id", "paper"), "paper", "text", "role")


@query("""
    WITH d AS (SELECT p_brand AS paper, p_partkey AS artifact, unnest(string_split(p_name, ' ')) AS term FROM part), x AS (SELECT * FROM d UNION SELECT paper, artifact, term || '-base' FROM d WHERE length(term) > 4)
    SELECT DISTINCT * FROM x""")
def footprints(spark, folder):
    t = _terms(spark, folder)
    defs = t.select("paper", "term").distinct().where("length(term) > 4").withColumn("dependencies", F.array(F.concat("term", F.lit("-base"))))
    return dependencies.footprints(t, defs)


@query("""
    WITH d AS (SELECT DISTINCT p_brand AS paper, p_partkey AS artifact, p_size, unnest(string_split(p_name, ' ')) AS term FROM part)
    SELECT paper, term, arg_min(artifact, (p_size, artifact)) AS artifact FROM d GROUP BY 1, 2""")
def first_artifact(spark, folder):
    nodes = table(spark, folder, "part").select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("id"), F.col("p_size").alias("line"))
    return dependencies.first_artifact(_terms(spark, folder).distinct(), nodes)


@query("""
    WITH g AS (SELECT text, arg_min(term, (length(term), doc_id)) AS p, list(DISTINCT term) AS t, count(*) AS n
               FROM (SELECT doc_id, text, source || '-' || doc_id AS term FROM documents WHERE text <> '') GROUP BY text)
    SELECT sha256(text) AS text_key, p AS "primary", array_to_string(list_sort(list_filter(t, lambda x: x <> p)), '|') AS aliases, n FROM g""")
def merge_redundant(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text", F.concat_ws("-", "source", "doc_id").alias("term"))
    merged = definitions.merge_redundant(d, "text", "term", "doc_id")
    return merged.select(F.sha2("text", 256).alias("text_key"), "primary", F.array_join("aliases", "|").alias("aliases"), "n")


@query(f"""
    SELECT doc_id AS text_id, item_id AS term_id FROM (SELECT doc_id, ' ' || {CANON.format('text')} || ' ' AS c FROM documents) d, (SELECT item_id, {CANON.format('text')} AS t FROM benchmark) b
    WHERE t <> '' AND contains(c, ' ' || t || ' ')""")
def term_containment(spark, folder):
    return definitions.contained_terms(table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text"), table(spark, folder, "benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term")))


@query("""
    WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS key FROM part), kk AS (SELECT CASE WHEN length(key) < 5 THEN key ELSE lower(key) END AS key FROM k),
    t AS (SELECT DISTINCT term, string_split(lower(term), ' ') AS w FROM (SELECT p_name AS term FROM part UNION SELECT 'Old ' || p_type || ' ' || p_name FROM part)),
    s AS (SELECT term, i, array_to_string(w[i:], ' ') AS key FROM t, LATERAL (SELECT unnest(range(2, len(w) + 1)) AS i))
    SELECT term, arg_min(key, i) AS base FROM s JOIN kk USING (key) GROUP BY term""")
def definition_base(spark, folder):
    p = table(spark, folder, "part")
    keys = p.select(text.normal_term(F.get(F.split("p_name", " "), 1)).alias("key"))
    return definitions.base_by_suffix(p.select(F.col("p_name").alias("term")).union(p.select(F.concat_ws(" ", F.lit("Old"), "p_type", "p_name"))), keys)


@query("""
    WITH k AS (SELECT lower(p_name) AS key, min(p_partkey) AS ord FROM part GROUP BY 1), t AS (SELECT DISTINCT 'the odd ' || split_part(p_name, ' ', 2) AS term FROM part)
    SELECT term, arg_max(key, (length(key), -ord)) AS base FROM t JOIN k ON split_part(key, ' ', 2) = split_part(term, ' ', 3) GROUP BY term""")
def definition_base_parameter(spark, folder):
    p = table(spark, folder, "part")
    known = p.groupBy(text.normal_term(F.col("p_name")).alias("key")).agg(F.min("p_partkey").alias("ord"))
    return definitions.base_by_parameter(p.select(F.concat_ws(" ", F.lit("the odd"), F.get(F.split("p_name", " "), 1)).alias("term")), known)


@query("""
    SELECT l_orderkey AS paper, l_linenumber AS artifact, CAST(count(DISTINCT p_name) AS INTEGER) AS n, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS terms
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def requirement_join(spark, folder):
    req = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("artifact"), F.col("l_partkey").alias("t"))
    named = table(spark, folder, "part").select(F.col("p_partkey").alias("t"), F.col("p_name").alias("term"), F.col("p_type").alias("text"))
    joined = req.join(named, "t")
    defined = joined.groupBy("paper", "term").agg(F.min("text").alias("text"))
    out = definitions.prerequisites(joined.select("paper", "artifact", "term").distinct(), defined)
    return out.select("paper", "artifact", F.size("prerequisites").alias("n"), F.array_join(F.array_sort(F.map_keys("prerequisites")), "|").alias("terms"))


# Identifiers, pages, matching


@query(r"""
    WITH i AS (SELECT page_id, format('{:04d}.{:05d}', page_id % 10000, page_id * 7 % 100000) || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'v' || (page_id % 12) END AS raw, url FROM pages)
    SELECT page_id, raw, regexp_replace(raw, 'v\d+$', '') AS base, CASE WHEN page_id % 3 = 0 THEN 0 ELSE CAST(page_id % 12 AS INTEGER) END AS version,
           regexp_replace(raw, 'v\d+$', '') AS parsed, 'data/arxiv_' || raw || '.json' AS file, regexp_extract(url, '([^/]*)$') AS last_segment FROM i""")
def id_parse(spark, folder):
    raw = F.concat(F.format_string("%04d.%05d", F.col("page_id") % 10000, F.col("page_id") * 7 % 100000), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("v"), (F.col("page_id") % 12).cast("string"))))
    p = table(spark, folder, "pages").select("page_id", "url", raw.alias("raw"))
    r = F.col("raw")
    return p.select("page_id", "raw", ids.base_id(r).alias("base"), ids.version_of(r).alias("version"), ids.parse_id(F.concat(F.lit("see arXiv:"), r)).alias("parsed"), ids.file_of(r).alias("file"), ids.id_from_entry(F.col("url")).alias("last_segment"))


@query("""
    WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS h FROM pages)
    SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS href FROM l, LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i)""".replace("\\\\", "\\"))
def html_links(spark, folder):
    return mentions.links(table(spark, folder, "pages"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query()
def page_texts(spark, folder):
    return mentions.page_texts(table(spark, folder, "pages")).select("page_id", F.length("text").alias("n_chars"), F.size("links").alias("n_links"))


@query()
def title_similarity_best(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", matching.normalize_title("p_name").alias("form"))
    return matching.best_similar(p, "p_partkey", ["p_brand", "p_size"], "form", "p_size", 0.6)


@query()
def reference_candidates(spark, folder):
    ref = F.concat(F.lit("Doe, J., "), F.initcap("p_name"), F.lit(" of "), F.initcap("p_type"), F.lit(". \\textit{Some Journal} 12, "), (F.col("p_size") + 1950).cast("string"), F.lit("."))
    return matching.title_candidates(table(spark, folder, "part").select("p_partkey", ref.alias("ref")), "p_partkey", "ref").drop("form")


# TeX


def _rendered(spark, folder):
    """A TeX document per order: a labelled statement per line with a reference to the line before, and proofs."""
    kind = F.when(F.col("l_returnflag") == "A", "theorem").when(F.col("l_returnflag") == "R", "lem").otherwise("Def")
    back = F.when(F.col("l_linenumber") > 1, F.concat(F.lit(" see \\ref{L-"), (F.col("l_linenumber") - 1).cast("string"), F.lit("}"))).otherwise("")
    proof = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("\\begin{proof}by part "), F.col("l_partkey").cast("string"), F.lit("\\end{proof}\n"))).otherwise("")
    block = F.concat(F.lit("\\begin{"), kind, F.lit("}[part]\\label{L_"), F.col("l_linenumber").cast("string"), F.lit("} % note\nholds"), back, F.lit("\n\\end{"), kind, F.lit("}\n"), proof)
    part = F.struct("l_linenumber", block.alias("t"))
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("text"))


@query("""
    SELECT l_orderkey AS paper, CASE l_returnflag WHEN 'A' THEN 'theorem' WHEN 'R' THEN 'lemma' ELSE 'definition' END || ':L_' || l_linenumber AS id,
           CASE WHEN l_linestatus = 'F' THEN 'by part ' || l_partkey END AS proof FROM lineitem""")
def render_parse_roundtrip(spark, folder):
    return latex.link_proofs(latex.environments(_rendered(spark, folder))).select("paper", "id", "proof")


@query("""
    WITH n AS (SELECT l_orderkey AS paper, l_linenumber AS k, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END AS o,
               CASE l_returnflag WHEN 'A' THEN 'theorem' WHEN 'R' THEN 'lemma' ELSE 'definition' END || ':L_' || l_linenumber AS id FROM lineitem),
    l AS (SELECT paper, k, arg_max(id, o) AS id FROM n GROUP BY 1, 2)
    SELECT DISTINCT CAST(a.paper AS VARCHAR) AS paper, a.id AS source, b.id AS target FROM n a JOIN l b ON a.paper = b.paper AND b.k = a.k - 1""")
def render_reference_edges(spark, folder):
    return latex.statement_graph(_rendered(spark, folder))[1]


# Model calls, usage, streams


@query("""
    WITH p AS (SELECT conv_id, turn, md5('sys' || coalesce(text, '') || role) AS prompt_key, turn FROM conversations), c AS (SELECT DISTINCT prompt_key FROM p WHERE turn = 0)
    SELECT conv_id, turn, prompt_key, CASE WHEN c.prompt_key IS NULL THEN 'unresolved' ELSE 'cached' END AS status FROM p LEFT JOIN c USING (prompt_key)""".replace("turn, md5", "turn, md5").replace(" AS prompt_key, turn FROM", " AS prompt_key FROM"))
def prompt_cache_join(spark, folder):
    p = table(spark, folder, "conversations").select("conv_id", "turn", F.lit("sys").alias("system"), F.coalesce("text", F.lit("")).alias("user"), F.col("role").alias("model"))
    cache = p.where("turn = 0").select(provider.prompt_key(F.col("system"), F.col("user"), F.col("model")).alias("prompt_key"), F.lit("{}").alias("reply"))
    return provider.with_replies(p, cache).select("conv_id", "turn", "prompt_key", "status")


@query("""
    SELECT event_type, CAST(user_id % 5 AS VARCHAR) AS model, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, CAST(grouping(event_type) * 2 + grouping(user_id % 5) AS BIGINT) AS level
    FROM events GROUP BY CUBE (event_type, user_id % 5)""")
def usage_cube(spark, folder):
    e = table(spark, folder, "events").select("event_type", (F.col("user_id") % 5).cast("string").alias("model"), F.floor("value").alias("t"))
    return provider.usage_cube(e, ["event_type", "model"], "t")


@query("""
    SELECT date_trunc('hour', ts) AS start, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1""")
def usage_windows(spark, folder):
    e = table(spark, folder, "events").select("ts", F.floor("value").alias("t"))
    return streams.usage_windows(e, "ts", "t").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "calls", "tokens")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_event_upsert(spark, folder):
    schema = table(spark, folder, "events").schema
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = streams.file_stream(spark, folder, schema, "events.parquet").select("user_id", "event_id", "event_type", "value")
    streams.upsert_parts(source, "user_id", "event_id", f"{at}/state", f"{at}/checkpoint")
    return streams.state(spark, f"{at}/state", source.schema)


# Index, rebuild and repair


@query("""
    WITH r AS (SELECT p_partkey AS k, lower(split_part(p_type, ' ', 1)) AS kind, p_name AS content, CASE WHEN p_size % 2 = 0 THEN p_brand END AS proof FROM part),
    a AS (SELECT CAST(k AS VARCHAR) AS artifact_id, k, kind AS type, content AS text FROM r UNION ALL SELECT k || '#proof', k, 'proof', proof FROM r WHERE proof IS NOT NULL)
    SELECT artifact_id, type, CASE type WHEN 'proof' THEN '[PROOF]' ELSE '[' || upper(type) || ']' END || ' tag small: thing ' || text AS index_text FROM a""")
def index_documents(spark, folder):
    nodes = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.lower(F.split("p_type", " ")[0]).alias("type"), F.col("p_name").alias("content"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("proof"), F.lit("tag").alias("semantic_tag"), F.create_map(F.lit("small"), F.lit("thing")).alias("prerequisites"),
    )
    return indexing.index_documents(nodes, "content+all").select("artifact_id", "type", "index_text")


@query("""
    WITH e AS (SELECT l_orderkey AS paper, l_linenumber AS s, l_linenumber - 1 AS t FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS paper, l_linenumber AS id FROM lineitem),
    x AS (SELECT DISTINCT paper, id FROM (SELECT paper, s AS id FROM e UNION ALL SELECT paper, t FROM e) ANTI JOIN a USING (paper, id))
    SELECT paper, CAST(id AS INTEGER) AS id, false AS is_external FROM a UNION ALL SELECT paper, CAST(id AS INTEGER), true FROM x""")
def graph_rebuild(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("id"))
    artifacts = li.distinct().withColumns({"kind": F.lit("theorem"), "content": F.lit("x")})
    edges = li.select("paper", F.lit("reference").alias("edge_kind"), F.col("id").alias("source"), (F.col("id") - 1).alias("target"), F.lit("internal").alias("kind"))
    none = artifacts.select("paper", F.col("id").alias("artifact"), F.create_map(F.lit("t"), F.lit("d")).alias("prerequisites")).where("false")
    return indexing.rebuild_graph(artifacts, edges, none)[0].select("paper", "id", "is_external")


@query("""
    SELECT o_orderkey AS id, o_orderdate AS ts, c_custkey IS NOT NULL AS known, o_orderkey NOT IN (SELECT l_partkey FROM lineitem) AS requeued
    FROM orders LEFT JOIN customer ON c_custkey = o_orderkey WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'""")
def rollback_selection(spark, folder):
    done = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"))
    papers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    waiting = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"))
    out = indexing.rollback(done, papers, waiting, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("id", "ts", F.col("metadata").contains("title").alias("known"), "requeued")


@query("""
    WITH n AS (SELECT o_custkey AS paper, o_orderkey AS o FROM orders), u AS (SELECT paper, 0 AS ph, 0 AS o, 'status' AS type FROM n GROUP BY 1 UNION ALL SELECT paper, 1, o, 'node' FROM n
      UNION ALL SELECT paper, 2, o, 'link' FROM n WHERE o % 2 = 0 UNION ALL SELECT paper, 3, o, 'node' FROM n WHERE o % 3 = 0 UNION ALL SELECT paper, 4, o, 'link' FROM n WHERE o % 5 = 0 UNION ALL SELECT paper, 5, 0, 'done' FROM n GROUP BY 1)
    SELECT paper, CAST(row_number() OVER (PARTITION BY paper ORDER BY ph, o) AS INTEGER) AS seq, type, CASE WHEN type IN ('node', 'link') THEN CAST(o AS VARCHAR) END AS data FROM u""")
def graph_event_rows(spark, folder):
    n = table(spark, folder, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("data"))
    return indexing.event_rows(n, n.where("ord % 2 = 0"), n.where("ord % 3 = 0"), n.where("ord % 5 = 0"))


@query("""
    SELECT s_name AS path, CAST(floor((row_number() OVER (ORDER BY s_name) - 1) / 20) AS BIGINT) AS batch FROM supplier WHERE s_name NOT IN (SELECT s_name FROM supplier WHERE s_nationkey = 3)""")
def upload_batches(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_name").alias("path"), "s_nationkey")
    return indexing.upload_batches(s.select("path"), s.where("s_nationkey = 3").select("path"), size=20)


@query("SELECT user_id AS paper, arg_max(event_type, (ts, event_id)) AS mode FROM events WHERE value > 20 GROUP BY 1")
def newest_modes(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("paper"), F.col("event_type").alias("mode"), F.when(F.col("value") > 20, "complete").otherwise("failed").alias("stage"), F.struct("ts", "event_id").alias("ts"))
    return indexing.newest_modes(e)
