"""Queries of the store, queue, definition bank, model-reply and retrieval operators on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.operators import bank, classify, commands, definitions, dependencies, graph, indexing, queue, replies, reply_table, retrieval, snapshots, store, vectors
from papyrion.operators.components import connected_components
from papyrion.plans.catalog import EDGES, REACH, _bm25, _bm25_sql, _nation_edges, query
from papyrion.sources import files, sinks
from papyrion.sources.tables import table
from papyrion.streaming import events as streams
from papyrion.streaming import keyed
from papyrion.workspace import materialize, shared_folder


def _lines(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


# Persistence


@query("""
    WITH old AS (SELECT l_orderkey AS paper, l_linenumber AS id, max(l_partkey) AS content FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
    new AS (SELECT l_orderkey AS paper, l_linenumber AS id, arg_max(l_suppkey, (l_partkey, l_suppkey)) AS content FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
    SELECT paper, id, CAST(new.content AS BIGINT) AS content FROM new UNION ALL SELECT paper, id, CAST(content AS BIGINT) FROM old WHERE paper NOT IN (SELECT paper FROM new)""")
def stored_artifacts(spark, folder):
    li = _lines(spark, folder)
    old = li.where("flag <> 'N'").groupBy("paper", F.col("line").alias("id")).agg(F.max("part").cast("long").alias("content"))
    new = li.where("status = 'F'").select("paper", F.col("line").alias("id"), F.col("supp").cast("long").alias("content"), F.struct("part", "supp").alias("ord"))
    return store.put_artifacts(old, new, "ord", remove_stale=True)


@query("""
    WITH e AS (SELECT l_orderkey AS paper, l_returnflag AS edge_kind, l_suppkey AS source, l_partkey AS target, l_linenumber AS n, l_linestatus AS s FROM lineitem)
    SELECT paper, edge_kind, source, target, CAST(coalesce(max(n) FILTER (s = 'F'), max(n) FILTER (s = 'O')) AS INTEGER) AS note FROM e GROUP BY 1, 2, 3, 4""")
def stored_edges(spark, folder):
    e = _lines(spark, folder).select("paper", F.col("flag").alias("edge_kind"), F.col("supp").alias("source"), F.col("part").alias("target"), F.col("line").cast("int").alias("note"), "status")
    old = e.where("status = 'O'").groupBy("paper", "edge_kind", "source", "target").agg(F.max("note").alias("note"))
    return store.put_edges(old, e.where("status = 'F'").drop("status").withColumn("ord", F.col("note").cast("long")), "ord")


@query("""
    WITH w AS (SELECT DISTINCT o_orderkey AS paper FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT l_orderkey AS paper, l_linenumber AS artifact, l_partkey AS term FROM lineitem),
    k AS (SELECT DISTINCT paper, term FROM l WHERE term % 2 = 0 AND paper IN (FROM w))
    SELECT DISTINCT 'requirements' AS name, l.paper, l.artifact, l.term FROM l JOIN k ON l.paper = k.paper AND l.term = k.term
    UNION ALL SELECT 'requirements', paper, artifact, term FROM (SELECT DISTINCT * FROM l) WHERE paper NOT IN (FROM w) AND artifact = 1
    UNION ALL SELECT DISTINCT 'dependencies', l.paper, l.term, l.term + 1 FROM l JOIN k ON l.paper = k.paper AND k.term = l.term + 1 WHERE l.paper IN (FROM w)""")
def replaced_definitions(spark, folder):
    li = _lines(spark, folder)
    papers = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("paper"))
    mine = li.join(papers, "paper", "left_semi")
    need = mine.select("paper", F.col("line").alias("artifact"), F.col("part").alias("term"))
    blank = {"definitions": need.select("paper", "term").limit(0), "aliases": need.select("paper", "term", F.lit("").alias("alias")).limit(0), "terms": need.limit(0)}
    new = blank | {"definitions": need.where("term % 2 = 0").select("paper", "term").distinct(), "dependencies": need.select("paper", "term", (F.col("term") + 1).alias("depends_on")), "requirements": need}
    old = blank | {"dependencies": new["dependencies"].limit(0), "requirements": li.where("line = 1").select("paper", F.col("line").alias("artifact"), F.col("part").alias("term")).distinct()}
    out = store.put_definitions(old, new, papers)
    return out["requirements"].select(F.lit("requirements").alias("name"), "paper", "artifact", "term").union(out["dependencies"].select(F.lit("dependencies"), "paper", F.col("term"), "depends_on"))


@query("""
    SELECT o_orderkey AS paper, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'failed' WHEN o_custkey % 3 = 0 THEN 'failed' ELSE 'complete' END AS stage,
           CASE WHEN o_orderstatus = 'P' THEN 'broken' WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'empty graph' WHEN o_custkey % 3 = 0 THEN 'no definition bank' END AS reason FROM orders""")
def extraction_results(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("paper"), F.when(F.col("o_orderstatus") == "P", "broken").alias("error"), F.when(F.col("o_custkey") % 3 != 0, 1).alias("n_definitions"))
    n = _lines(spark, folder).groupBy("paper").agg(F.count("*").alias("n_nodes"))
    return store.commit(o.join(n, "paper", "left"), "defs")


@query("""
    WITH a AS (SELECT l_orderkey AS paper, l_linenumber AS id, min(l_returnflag) AS content FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey % 3 <> 0 GROUP BY 1, 2),
    b AS (SELECT l_orderkey AS paper, l_linenumber AS id, l_partkey AS term, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 10 AND l_orderkey % 2 = 0),
    g AS (SELECT * FROM b WHERE o_custkey % 3 <> 0 AND o_custkey % 5 <> 0),
    x AS (SELECT DISTINCT paper, id, 'new' AS content FROM g UNION ALL SELECT * FROM a WHERE (paper, id) NOT IN (SELECT (paper, id) FROM g)),
    s AS (SELECT o_orderkey AS paper, o_orderkey % 3 <> 0 AS first, o_orderkey % 2 = 0 AS second, o_orderkey IN (SELECT paper FROM a) AS fine, o_orderkey IN (SELECT paper FROM b) AS lines, o_custkey FROM orders)
    SELECT 'artifacts' AS name, CAST(paper AS VARCHAR) AS paper, CAST(id AS VARCHAR) AS id, content AS value FROM x
    UNION ALL SELECT DISTINCT 'definitions', CAST(paper AS VARCHAR), CAST(term AS VARCHAR), 'text' FROM g
    UNION ALL SELECT 'states', CAST(paper AS VARCHAR), CASE WHEN second THEN 'full' ELSE 'graph' END || '/' || (CAST(first AS INT) + CAST(second AS INT)),
      CASE WHEN second THEN CASE WHEN NOT lines THEN 'empty graph' WHEN o_custkey % 3 = 0 THEN 'no definition bank' WHEN o_custkey % 5 = 0 THEN 'no term map' ELSE 'complete' END WHEN fine THEN 'complete' ELSE 'empty graph' END FROM s WHERE first OR second""")
def committed_papers(spark, folder):
    """Two batches of papers, of which some fail, and a third that is staged and never committed; then what readers see."""
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").cast("string").alias("id"), "l_returnflag", "l_linestatus", "l_quantity", F.col("l_partkey").cast("string").alias("term"))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("paper"), "o_custkey")
    kept = snapshots.Snapshots(spark, f"{shared_folder(spark)}/papers-{uuid.uuid4().hex}")

    def rows(lines: DataFrame, content) -> dict[str, DataFrame]:
        artifacts = lines.select("paper", "id", F.lit("theorem").alias("kind"), content.alias("content"), F.struct(F.ascii(content) * -1).alias("ord"))
        return {"artifacts": artifacts, "edges": lines.select("paper", F.lit("reference").alias("edge_kind"), F.col("id").alias("source"), F.col("id").alias("target"), F.struct("id").alias("ord"))}

    first = o.where("paper % 3 <> 0").select("paper", F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("n_definitions"), F.lit(None).cast("int").alias("n_terms"))
    snapshots.persist_results(kept, first, rows(li.where("l_linestatus = 'F'"), F.col("l_returnflag")), "graph")
    second = o.where("paper % 2 = 0").select("paper", F.lit(None).cast("string").alias("error"), F.when(F.col("o_custkey") % 3 != 0, 1).alias("n_definitions"), F.when(F.col("o_custkey") % 5 != 0, 1).alias("n_terms"))
    lines = li.where("l_quantity > 10")
    bank = {"definitions": lines.select("paper", "term", F.lit("text").alias("text")), "terms": lines.select("paper", F.col("id").alias("artifact"), "term")}
    snapshots.persist_results(kept, second, rows(lines, F.lit("new")) | bank, "full")
    kept.stage(o, {"artifacts": rows(li, F.lit("lost"))["artifacts"]})
    artifacts = kept.read("artifacts").select(F.lit("artifacts").alias("name"), "paper", "id", F.col("content").alias("value"))
    definitions = kept.read("definitions").select(F.lit("definitions"), "paper", "term", "text")
    states = kept.read("states").select(F.lit("states"), "paper", F.concat_ws("/", "mode", "attempts"), F.coalesce("error", "stage"))
    return artifacts.union(definitions).union(states)


@query("""
    SELECT CAST(user_id AS VARCHAR) AS paper, arg_max(stage, (ts, event_id)) AS stage, count(*) FILTER (stage = 'processing') AS attempts, epoch_us(max(ts)) AS updated_at, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events
    FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'click' THEN 'failed' ELSE 'processing' END AS stage FROM events) GROUP BY user_id""")
def streamed_states(spark, folder):
    """The event log as files that come one by one, in two runs of a stream with keyed state; the second goes on from the checkpoint."""
    stage = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "failed").otherwise("processing")
    rows = table(spark, folder, "events").select(F.col("user_id").alias("paper"), stage.alias("stage"), "ts", "event_id")
    at = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    for turn in range(2):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == turn).repartition(2).write.mode("append").parquet(f"{at}/log")
        keyed.run_to_end(keyed.stages(streams.file_stream(spark, f"{at}/log", rows.schema)), f"{at}/out", f"{at}/checkpoint")
    return keyed.present(spark, f"{at}/out", keyed.STAGES, "paper", "n_events").drop("reason")


@query("""
    WITH r AS (SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS key, CAST(event_id AS VARCHAR) AS reply, ts FROM events),
    n AS (SELECT key, arg_max(reply, (ts, reply)) AS reply FROM r WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY key),
    w AS (SELECT DISTINCT c_custkey, CAST(c_custkey AS VARCHAR) || '/' || t AS key FROM customer, (VALUES ('view'), ('click'), ('none')) v(t))
    SELECT c_custkey, w.key, reply, CASE WHEN n.key IS NULL THEN 'missing' ELSE 'cached' END AS status FROM w LEFT JOIN n ON w.key = n.key""")
def stored_replies(spark, folder):
    """Replies of three runs, looked up by key with an expiry, before which they were compacted once."""
    e = table(spark, folder, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").cast("string").alias("reply"), "ts", F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("run"))
    kept = reply_table.ReplyTable(spark)
    for run in range(3):
        kept.append(e.where(F.col("run") == run))
        if run == 1:
            kept.compact()
    kinds = F.explode(F.array(*map(F.lit, ("view", "click", "none"))))
    wanted = table(spark, folder, "customer").select("c_custkey", kinds.alias("kind")).distinct().select("c_custkey", F.concat_ws("/", F.col("c_custkey").cast("string"), "kind").alias("key"))
    return kept.lookup(wanted, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def missing_parents(spark, folder):
    parents = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("paper"))
    return store.orphans(_lines(spark, folder).select(F.col("part").alias("paper")), parents, "paper").agg(F.count("*").alias("n"))


@query("""
    WITH u AS (SELECT CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS paper, CAST(floor(value) AS BIGINT) AS p FROM events)
    SELECT count(*) AS papers, (SELECT CAST(sum(p + 5) AS BIGINT) FROM u) AS tokens FROM (SELECT c_custkey AS paper FROM customer WHERE c_custkey % 2 = 0 UNION SELECT paper FROM u WHERE paper IS NOT NULL)""")
def logged_usage(spark, folder):
    papers = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("paper"), F.col("c_name").alias("title"))
    usage = table(spark, folder, "events").select(F.when(F.col("event_type") != "view", F.col("user_id")).alias("paper"), F.floor("value").alias("prompt_tokens"), F.lit(5).alias("completion_tokens"))
    after, rows = store.add_usage(papers, usage)
    return after.agg(F.count("*").alias("papers")).join(F.broadcast(rows.agg(F.sum("total_tokens").alias("tokens"))))


@query("SELECT l_orderkey AS paper, l_linenumber AS id, CAST(arg_min(l_partkey, (l_partkey, l_suppkey)) AS BIGINT) AS part FROM lineitem GROUP BY 1, 2")
def first_nodes(spark, folder):
    n = _lines(spark, folder).select("paper", F.col("line").alias("id"), F.col("part").cast("long").alias("part"), F.struct("part", "supp").alias("ord"))
    return store.first_nodes(n, "ord").select("paper", "id", "part")


@query("""
    WITH e AS (SELECT l_orderkey AS paper, l_suppkey AS source, l_partkey AS target FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS id FROM lineitem WHERE l_linenumber = 1)
    SELECT 'out' AS side, e.paper, source, target, count(*) AS n FROM e JOIN a ON e.paper = a.paper AND e.source = a.id GROUP BY ALL
    UNION ALL SELECT 'in', e.paper, source, target, count(*) FROM e JOIN a ON e.paper = a.paper AND e.target = a.id GROUP BY ALL""")
def edges_at_nodes(spark, folder):
    li = _lines(spark, folder)
    e = li.select("paper", F.col("supp").alias("source"), F.col("part").alias("target"))
    asked = li.where("line = 1").select("paper", F.col("supp").alias("id"))
    both = store.edges_at(e, asked, "source").withColumn("side", F.lit("out")).union(store.edges_at(e, asked, "target").withColumn("side", F.lit("in")))
    return both.groupBy("side", "paper", "source", "target").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS paper, l_returnflag AS label, CAST(arg_min(l_linenumber, (l_partkey, l_linenumber)) AS BIGINT) AS id FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2")
def nodes_by_label(spark, folder):
    n = _lines(spark, folder).select("paper", F.col("flag").alias("label"), F.col("line").cast("long").alias("id"), F.struct("part", "line").alias("ord"))
    return store.nodes_by_label(n, n.where("label <> 'A'"), "ord")


@query("""
    SELECT l_orderkey AS paper, count(*) AS n_nodes, count(*) FILTER (l_linenumber > 1) AS n_edges, count(*) FILTER (l_linenumber > 1 AND l_returnflag = 'N') AS n_reference,
           count(*) FILTER (l_linenumber > 1 AND l_returnflag <> 'N') AS n_dependency FROM lineitem GROUP BY 1""")
def paper_graph_counts(spark, folder):
    li = _lines(spark, folder)
    return store.edge_counts(li, li.where("line > 1").select("paper", F.when(F.col("flag") == "N", "reference").otherwise("dependency").alias("edge_kind")))


@query(f"""
    WITH RECURSIVE {EDGES}, {REACH} SELECT a.c AS component, count(*) AS n, count(DISTINCT src) AS sources FROM e JOIN (SELECT v, component AS c FROM comp) a ON a.v = src JOIN (SELECT v, component AS c FROM comp) b ON b.v = dst AND a.c = b.c GROUP BY 1""")
def component_edges(spark, folder):
    e = _nation_edges(spark, folder)
    inside = store.induced_edges(e.toDF("source", "target"), connected_components(e))
    return inside.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("""
    SELECT 'p' || o_custkey AS source, 'p' || (o_orderkey % 97) AS target, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus <> 'P' GROUP BY 1, 2""")
def citation_edges(spark, folder):
    o = table(spark, folder, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("v2")).alias("paper"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" p"), (F.col("o_orderkey") % 97).cast("string"), F.lit("v1 "))).alias("matched"))
    done = table(spark, folder, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit("v2")).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "success_full").otherwise("failure").alias("status"))
    return store.citation_edges(o, done).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("""
    WITH e AS (SELECT l_orderkey AS paper, l_suppkey AS source, l_partkey AS target, l_returnflag AS f FROM lineitem), n AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS id FROM lineitem UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 3 > 0)
    SELECT DISTINCT e.paper, source, target FROM e JOIN n ON n.paper = e.paper AND n.id = target WHERE source <> target AND f <> 'A' AND (e.paper, source, target) NOT IN (SELECT (paper, source, target) FROM e WHERE f = 'A')""")
def accepted_new_edges(spark, folder):
    """Proposals against a node table that lacks some ends and against edges that are there already."""
    e = _lines(spark, folder).select("paper", F.col("supp").alias("source"), F.col("part").alias("target"), "flag")
    nodes = e.select("paper", F.col("source").alias("id")).union(e.where("target % 3 > 0").select("paper", "target")).distinct()
    return dependencies.accepted_edges(e.where("flag <> 'A'"), nodes, e.where("flag = 'A'"))


@query("""
    SELECT l_orderkey AS paper, l_linenumber AS source, l_linenumber - 1 AS target, CASE WHEN l_returnflag = 'N' THEN 'internal' END AS reference_type, CASE WHEN l_returnflag <> 'N' THEN 'internal' END AS dependency_type FROM lineitem""")
def rebuilt_edges(spark, folder):
    li = _lines(spark, folder)
    e = li.select("paper", F.when(F.col("flag") == "N", "reference").otherwise("dependency").alias("edge_kind"), F.col("line").alias("source"), (F.col("line") - 1).alias("target"), F.lit("internal").alias("kind"))
    artifacts = li.select("paper", F.col("line").alias("id")).distinct().withColumns({"kind": F.lit("theorem"), "content": F.lit("x")})
    return indexing.rebuild_graph(artifacts, e, artifacts.select("paper", F.col("id").alias("artifact"), F.create_map(F.lit("t"), F.lit("d")).alias("prerequisites")))[1]


@query("""
    SELECT l_orderkey AS paper, l_linenumber AS id, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS needs FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def rebuilt_prerequisites(spark, folder):
    li = _lines(spark, folder)
    named = li.join(table(spark, folder, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("term"), F.col("p_type").alias("text")), "part")
    needs = definitions.prerequisites(named.select("paper", F.col("line").alias("artifact"), "term").distinct(), named.groupBy("paper", "term").agg(F.min("text").alias("text")))
    artifacts = li.select("paper", F.col("line").alias("id")).distinct().withColumns({"kind": F.lit("theorem"), "content": F.lit("x")})
    edges = li.select("paper", F.lit("reference").alias("edge_kind"), F.col("line").alias("source"), F.col("line").alias("target"), F.lit("internal").alias("kind"))
    nodes = indexing.rebuild_graph(artifacts, edges, needs)[0]
    return nodes.select("paper", "id", F.array_join(F.array_sort(F.map_keys("prerequisites")), "|").alias("needs"))


@query("""
    SELECT l_orderkey AS paper, 'data/arxiv_' || l_orderkey || '_x.json' AS path, CAST(count(*) AS INTEGER) AS n_nodes, 'full' AS mode, CAST(count(DISTINCT l_partkey) AS INTEGER) AS n_terms FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1""")
def export_documents(spark, folder):
    li = _lines(spark, folder).where("line <= 2").withColumn("paper", F.concat(F.col("paper").cast("string"), F.lit("/x")))
    docs = sinks.graph_json(li.select("paper", F.monotonically_increasing_id().alias("id"), "flag"), li.select("paper", F.col("line").alias("source"), F.col("line").alias("target"), F.lit("x").alias("dependency_type")))
    terms = li.select("paper", F.lit("a").alias("artifact"), F.col("part").cast("string").alias("term"))
    papers = li.select("paper").distinct()
    banks, macros = papers.withColumn("bank", F.create_map(F.lit("k"), F.lit("d"))), papers.withColumn("macros", F.create_map(F.lit("m"), F.lit("b")))
    rows = store.export_rows(docs, banks, terms, macros, papers.withColumn("mode", F.lit("full")))
    return rows.select(F.split("paper", "/")[0].cast("long").alias("paper"), "path", F.size(F.from_json(F.get_json_object("json", "$.graph.nodes"), "array<struct<id: bigint>>")).alias("n_nodes"), F.get_json_object("json", "$.extractor_mode").alias("mode"), F.size(F.from_json(F.get_json_object("json", "$.artifact_to_terms.a"), "array<string>")).alias("n_terms"))


# Queue and citations


@query("""
    WITH r AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase' AND value > 60), s AS (SELECT user_id AS id, min(event_id) AS ord FROM events WHERE event_type = 'view' GROUP BY 1),
    a AS (SELECT id, min((part, ord)) AS spot FROM (SELECT id, 0 AS part, id AS ord FROM r UNION ALL SELECT id, 1, ord FROM s) GROUP BY 1)
    SELECT id, row_number() OVER (ORDER BY spot, id) AS place FROM a WHERE id % 10 <> 3""")
def ordered_work(spark, folder):
    e = table(spark, folder, "events")
    retries = e.where("event_type = 'purchase' and value > 60").select(F.col("user_id").alias("id"), F.col("user_id").alias("ord"))
    return queue.ordered_work(retries, e.where("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord")), e.where("user_id % 10 = 3").select(F.col("user_id").alias("id")))


@query("""
    WITH r AS (SELECT user_id AS id, min(event_id) AS ord FROM events WHERE event_type = 'view' GROUP BY 1) SELECT id, row_number() OVER (ORDER BY ord, id) AS place FROM r WHERE id % 10 <> 3 QUALIFY place <= 7""")
def limited_work(spark, folder):
    e = table(spark, folder, "events")
    none = e.where("false").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"))
    return queue.ordered_work(none, e.where("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord")), e.where("user_id % 10 = 3").select(F.col("user_id").alias("id")), 7)


@query("""
    SELECT event_id, event_type LIKE 's%' AS good, event_type = 'error' AND user_id % 2 = 0 AS retry FROM events""")
def status_predicates(spark, folder):
    e = table(spark, folder, "events")
    status = F.when(F.col("event_type") == "error", "failure").when(F.startswith("event_type", F.lit("s")), "success_full").otherwise("other")
    details = F.to_json(F.struct(F.when(F.col("user_id") % 2 == 0, "llm_timeout").otherwise("x").alias("reason_code")))
    return e.select("event_id", queue.succeeded(status).alias("good"), queue.retry_candidate(status, details, ["llm_timeout", "llm_rate_limited"]).alias("retry"))


@query("""
    SELECT count(*) AS total, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS added FROM
      (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION SELECT o_custkey FROM orders)""")
def added_rows(spark, folder):
    old = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("ord"), F.lit("old").alias("source"))
    new = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.lit("new").alias("source"))
    rows, added = queue.add_missing(old, new, "id", "ord")
    return rows.agg(F.count("*").alias("total")).join(F.broadcast(added))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'from details' ELSE event_type END AS event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events".replace("\\\\", "\\"))
def merged_details(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}$", ', "event_type": "from details"}')).otherwise(F.col("props")).alias("props"))
    return queue.merged_details(e, "props", "event_type string, k int").select("event_id", "event_type", "k")


@query("""
    SELECT DISTINCT o_custkey AS id FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0 WHERE c_custkey IS NULL OR c_custkey % 3 = 2""")
def stale_citations(spark, folder):
    fetched = table(spark, folder, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 2, "2020-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z").alias("ts"))
    return queue.stale_or_missing(table(spark, folder, "orders").select(F.col("o_custkey").alias("id")), fetched, "id", F.lit("2022-01-01").cast("timestamp"))


@query("""
    SELECT count(*) AS attempted, count(*) FILTER (c_custkey % 5 > 0) AS success, count(*) FILTER (c_custkey % 5 = 0) AS missing, count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 5 > 1) AS upgraded FROM customer""")
def citation_upgrades(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    new = c.withColumn("n", F.when(F.col("id") % 5 > 0, F.col("id") % 5 - 1))
    return queue.upgrade_counts(c.where("id % 2 = 0").withColumn("n", F.lit(0)), new, "id", "n")


@query("""
    WITH t AS (SELECT c_custkey % 40 AS base, c_custkey, c_name FROM customer), p AS (SELECT base, arg_min(c_name, 'p' || base || 'v' || c_custkey) AS title FROM t WHERE c_custkey % 3 = 0 GROUP BY 1),
    d AS (SELECT base, arg_min(upper(c_name), 'p' || base || 'v' || c_custkey) AS title FROM t WHERE c_custkey % 3 = 1 GROUP BY 1)
    SELECT 'p' || i AS id, coalesce(p.title, d.title) AS title FROM (SELECT unnest(range(0, 60)) AS i) LEFT JOIN p ON p.base = i LEFT JOIN d ON d.base = i""")
def paper_titles(spark, folder):
    c = table(spark, folder, "customer").select(F.concat(F.lit("p"), (F.col("c_custkey") % 40).cast("string"), F.lit("v"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"), (F.col("c_custkey") % 3).alias("m"))
    wanted = spark.range(60).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"))
    return queue.paper_titles(wanted, c.where("m = 0"), c.where("m = 1").withColumn("title", F.upper("title")))


@query("SELECT 'p' || user_id AS base, arg_min(event_type, event_id) AS metadata FROM events WHERE event_type <> 'view' GROUP BY 1")
def first_metadata(spark, folder):
    e = table(spark, folder, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit("v"), (F.col("event_id") % 9).cast("string")).alias("id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("m"), "event_id")
    return queue.first_metadata(e, "id", "m", "event_id")


@query("""
    SELECT o_custkey AS id, array_to_string(list(DISTINCT o_orderkey ORDER BY o_orderkey), '|') AS targets, 't' || min(o_orderkey) AS title FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1
    UNION ALL SELECT NULL, CAST(o_orderkey AS VARCHAR), 't' || o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def citing_works(spark, folder):
    o = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("id"), F.col("o_orderkey").alias("target"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("title"))
    return classify.merge_citing(o).select("id", F.array_join(F.transform("targets", lambda x: x.cast("string")), "|").alias("targets"), "title")


@query("SELECT count(*) AS considered, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click FROM events")
def backfill_counts(spark, folder):
    return classify.counters(table(spark, folder, "events"), "event_type", ["view", "click"])


@query("""
    SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '2101.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') WHEN 1 THEN '2202.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS paper_id, p_size % 4 < 3 AS on_arxiv, p_size % 4 = 2 AS missing_id FROM part""")
def work_availability(spark, folder):
    n, number = F.col("p_size") % 4, F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    found = F.create_map(F.lit("arxiv"), F.when(n == 0, F.concat(F.lit("https://arxiv.org/abs/2101."), number, F.lit("v3"))))
    urls = F.array(F.struct(F.when(n == 1, F.concat(F.lit("http://arxiv.org/pdf/2202."), number)).otherwise("https://x.org/a").alias("url")))
    works = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), found.alias("ids"), F.when(n == 2, F.array(F.lit("arxiv"))).otherwise(F.array(F.lit("x"))).alias("indexed_in"), urls.alias("locations"))
    return classify.work_records(works).select("id", "paper_id", "on_arxiv", "missing_id")


@query("""
    SELECT p_partkey AS run_id, e.experiment, CASE WHEN e.experiment = 'e1' THEN 0.5 ELSE 0.25 END::DOUBLE AS ndcg, CASE WHEN e.experiment = 'e1' THEN CAST(p_size AS DOUBLE) END AS runtime_sec, CASE WHEN p_size % 2 = 0 THEN 'content' END AS index_mode FROM part, (VALUES ('e1'), ('e2')) e(experiment)""")
def benchmark_report(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("run_id"), "p_size")
    metric = F.create_map(F.lit("e1"), F.create_map(F.lit("nDCG@10"), F.lit(0.5)), F.lit("e2"), F.create_map(F.lit("nDCG@10"), F.lit(0.25)))
    summaries = p.select("run_id", metric.alias("metrics"), F.create_map(F.lit("e1"), F.col("p_size").cast("double")).alias("runtimes"))
    meta = p.where("p_size % 2 = 0").select("run_id", F.lit("content").alias("index_mode"))
    return classify.report_rows(summaries, meta).select("run_id", "experiment", "ndcg", "runtime_sec", "index_mode")


# Definition bank


@query("SELECT p_partkey AS k, CASE WHEN p_name < 'f' THEN p_name || '|f' ELSE 'f|' || p_name END AS terms FROM part WHERE p_name <> 'f'")
def clean_term_lists(spark, folder):
    raw = F.array(F.concat(F.lit(" "), "p_name", F.lit(".")), F.lit("f\x07"), F.lit(" f,"), F.lit(" "), F.col("p_name"), F.lit(None))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.array_join(bank.clean_terms(raw), "|").alias("terms"))


@query("""
    WITH d AS (SELECT DISTINCT p_brand AS paper, p_name AS term, 'a ' || p_name || ' and also ' || reverse(p_name) AS definition_text FROM part UNION SELECT DISTINCT p_brand, split_part(p_name, ' ', 2), 'some ' || split_part(p_name, ' ', 1) FROM part)
    SELECT DISTINCT x.paper, x.term, y.term AS depends_on FROM d x JOIN d y ON x.paper = y.paper AND x.term <> y.term AND contains(' ' || x.definition_text || ' ', ' ' || y.term || ' ')""")
def definition_dependencies(spark, folder):
    p = table(spark, folder, "part")
    whole = p.select(F.col("p_brand").alias("paper"), F.col("p_name").alias("term"), F.concat(F.lit("a "), "p_name", F.lit(" and also "), F.reverse("p_name")).alias("definition_text"))
    word = p.select("p_brand", F.get(F.split("p_name", " "), 1), F.concat(F.lit("some "), F.get(F.split("p_name", " "), 0)))
    return bank.definition_dependencies(whole.union(word).distinct())


@query("SELECT p_partkey AS k FROM part WHERE p_size % 3 = 0")
def valid_definitions(spark, folder):
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("a ("), "p_name", F.lit(") is"))).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("x"))).otherwise("  ")
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), said.alias("d"), F.concat(F.lit("here a ("), "p_name", F.lit(") is $big$")).alias("c"))
    return bank.valid_definitions(rows, "d", "c").select("k")


@query("""
    WITH t AS (SELECT p_brand AS paper, p_partkey AS artifact, p_size AS line, 'odd ' || p_name AS term FROM part), n AS (SELECT * FROM t WHERE term NOT IN (SELECT 'odd ' || p_name FROM part x WHERE x.p_brand = t.paper AND x.p_size % 5 = 0)),
    f AS (SELECT paper, term, arg_min(artifact, (line, artifact)) AS first_artifact FROM n GROUP BY 1, 2)
    SELECT paper, term, first_artifact, split_part(term, ' ', 3) AS base FROM f""")
def missing_terms(spark, folder):
    p = table(spark, folder, "part")
    terms = p.select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("artifact"), F.col("p_size").alias("line"), F.concat(F.lit("odd "), "p_name").alias("term"))
    words = p.select(F.col("p_brand").alias("paper"), F.lower(F.get(F.split("p_name", " "), 1)).alias("key")).distinct().withColumn("ord", F.lit(0))
    known = p.where("p_size % 5 = 0").select(F.col("p_brand").alias("paper"), F.concat(F.lit("odd "), "p_name").alias("alias")).distinct()
    return bank.missing_terms(terms, words, known).select("paper", "term", "first_artifact", "base")


@query("""
    WITH n AS (SELECT l_orderkey AS paper, l_linenumber AS id, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2), d AS (SELECT paper, 't' || part AS term, max(id) AS line FROM n GROUP BY 1, 2)
    SELECT paper, string_agg(term, '|' ORDER BY line, term) AS needs FROM d GROUP BY 1""")
def ordered_prerequisites(spark, folder):
    n = _lines(spark, folder).groupBy("paper", F.col("line").alias("id")).agg(F.max("part").alias("part"))
    defs = n.groupBy("paper", F.concat(F.lit("t"), F.col("part").cast("string")).alias("term")).agg(F.lit("x").alias("text"), F.max("id").alias("source"))
    needs = n.select("paper", F.lit("all").alias("artifact"), F.concat(F.lit("t"), F.col("part").cast("string")).alias("term"))
    out = bank.ordered_prerequisites(needs, defs, n.select("paper", "id", F.col("id").alias("line")))
    return out.select("paper", F.array_join(F.transform("prerequisites", lambda x: x["term"]), "|").alias("needs"))


@query("""
    WITH t AS (SELECT DISTINCT p_brand AS paper, p_name AS term FROM part), k AS (SELECT DISTINCT p_brand AS paper, lower(p_name) AS key FROM part WHERE p_size % 2 = 0),
    q AS (SELECT DISTINCT p_brand AS paper, p_partkey AS artifact, lower(p_name) AS key FROM part), v AS (SELECT DISTINCT paper, lower(term) AS key FROM t WHERE (paper, lower(term)) NOT IN (SELECT (paper, key) FROM k) AND length(term) % 2 = 0),
    b AS (SELECT * FROM k UNION SELECT * FROM v)
    SELECT q.paper, q.artifact, b.key FROM q JOIN b ON q.paper = b.paper AND q.key = b.key""")
def enhanced_papers(spark, folder):
    p = table(spark, folder, "part")
    terms = p.select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("artifact"), F.col("p_size").alias("line"), F.col("p_name").alias("term"))
    known = p.where("p_size % 2 = 0").select(F.col("p_brand").alias("paper"), F.lower("p_name").alias("key")).distinct().withColumns({"ord": F.lit(0), "text": F.lit("known"), "source": F.lit(None).cast("long")})
    text = F.concat(F.lit("what "), "p_name", F.lit(" is"))
    proposed = p.select(F.col("p_brand").alias("paper"), F.col("p_name").alias("term"), text.alias("text"), F.when(F.length("p_name") % 2 == 0, F.concat(F.lit("so "), text)).otherwise("nothing").alias("context")).distinct()
    none = known.select("paper", F.col("key").alias("alias"), "key").limit(0)
    _, needs = bank.enhance(terms, known, none, proposed, terms.select("paper", F.col("artifact").alias("id"), "line"))
    return needs.select("paper", "artifact", F.inline("prerequisites")).select("paper", "artifact", F.col("term").alias("key"))


@query("""
    SELECT p_brand AS paper, CAST(count(DISTINCT p_name) AS INTEGER) AS n, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS keys, CAST(count(DISTINCT p_type) AS INTEGER) AS n_aliases FROM part GROUP BY 1""")
def bank_documents(spark, folder):
    p = table(spark, folder, "part").withColumn("paper", F.col("p_brand"))
    defs = p.select("paper", F.col("p_name").alias("key"), F.col("p_name").alias("term")).distinct().withColumns({"definition_text": F.lit("d"), "source": F.lit("s")})
    aliases = p.crossJoin(F.broadcast(spark.range(1))).select("paper", F.col("p_type").alias("alias")).distinct()
    keys = defs.groupBy("paper").agg(F.min("key").alias("key"))
    out = bank.bank_documents(defs, aliases.join(keys, "paper"), defs.select("paper", "key", F.col("key").alias("depends_on")).limit(0))
    return out.select("paper", F.size("bank").alias("n"), F.array_join(F.array_sort(F.map_keys("bank")), "|").alias("keys"), F.aggregate(F.map_values("bank"), F.lit(0), lambda a, x: a + F.size(x["aliases"])).alias("n_aliases"))


@query("""
    WITH g AS (SELECT text, arg_min(source || '-' || doc_id, (length(source || '-' || doc_id), doc_id)) AS p, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1)
    SELECT d.source || '-' || d.doc_id AS term, g.p AS "primary", g.n, d.source || '-' || d.doc_id = g.p AS is_primary FROM documents d JOIN g USING (text)""")
def redundant_members(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text", F.concat_ws("-", "source", "doc_id").alias("term"))
    return definitions.redundant_members(d, "text", "term", "doc_id")


@query("""
    WITH k AS (SELECT DISTINCT lower(p_name) AS key FROM part WHERE p_size % 2 = 0), t AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT 'alias ' || p_type FROM part)
    SELECT term, CASE WHEN term LIKE 'alias %' THEN 'from ' || substr(term, 7) ELSE key END AS found FROM t LEFT JOIN k ON k.key = lower(term)""")
def found_definitions(spark, folder):
    p = table(spark, folder, "part")
    terms = p.select(F.col("p_name").alias("term")).union(p.select(F.concat(F.lit("alias "), "p_type"))).distinct()
    aliases = p.select(F.lower(F.concat(F.lit("alias "), "p_type")).alias("alias"), F.concat(F.lit("from "), "p_type").alias("key")).distinct()
    return definitions.find_definitions(terms, p.where("p_size % 2 = 0").select(F.lower("p_name").alias("key")).distinct(), aliases).select("term", F.col("key").alias("found"))


@query("SELECT p_partkey AS k, 'the ' || p_name || ' holds' || chr(10) || chr(10) || 'Artifact ' || p_brand AS context FROM part")
def synthesis_contexts(spark, folder):
    body = F.concat(F.lit("p_name in the preamble\n\\begin{document}intro\n\nthe "), "p_name", F.lit(" holds\n\nend"))
    tex = F.concat(body, F.lit("Artifact "), "p_brand")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("k"), bank.synthesis_context(tex, F.length(body), F.col("p_name"), F.concat(F.lit("Artifact "), "p_brand")).alias("context"))


# Model replies


def _reply(kind: str, value) -> F.Column:
    return F.concat(F.lit(f"<think>about {kind}</think> Here: ```json\n"), F.to_json(value), F.lit("\n```"))


@query("""
    SELECT DISTINCT p_partkey AS k, x.term FROM part, LATERAL (SELECT unnest([p_name, p_type]) AS term) x WHERE p_size % 4 > 0""")
def extracted_terms(spark, folder):
    value = F.struct(F.array(F.col("p_name"), F.concat(F.lit(" "), "p_type", F.lit("."))).alias("terms"))
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 4 > 0, _reply("terms", value)).otherwise("no json").alias("reply"))
    return replies.extracted_terms(rows, ["k"])


@query("""
    SELECT l_orderkey AS paper, l_linenumber AS source, l_partkey AS target, CASE WHEN l_returnflag = 'N' THEN 'uses' ELSE 'generic' END AS dependency_type FROM lineitem WHERE l_linestatus = 'F'""")
def confirmed_pairs(spark, folder):
    value = F.struct((F.col("status") == "F").alias("has_dependency"), F.when(F.col("flag") == "N", "uses").alias("dependency_type"), F.lit("as said").alias("justification"))
    rows = _lines(spark, folder).select("paper", F.col("line").alias("source"), F.col("part").alias("target"), _reply("pair", value).alias("reply"))
    return replies.pair_edges(rows).select("paper", "source", "target", "dependency_type")


@query("""
    WITH n AS (SELECT DISTINCT l_orderkey AS paper, 'n' || l_linenumber AS id, l_linenumber AS k FROM lineitem)
    SELECT a.paper, a.id AS source, b.id AS target FROM n a JOIN n b ON a.paper = b.paper AND b.k = a.k + 1 WHERE a.paper % 3 > 0 AND NOT (a.k = 1 AND a.paper % 2 = 0)""")
def whole_paper_edges(spark, folder):
    """Replies name an edge from each statement to the next number, to itself and to an unknown one; some edges exist."""
    n = _lines(spark, folder).select("paper", "line").distinct()
    own = F.concat(F.lit("n"), F.col("line").cast("string"))
    edge = F.array(*[F.struct(own.alias("source_id"), t.alias("target_id"), F.lit("x").alias("dependency_type"), F.lit("y").alias("justification")) for t in (F.concat(F.lit("n"), (F.col("line") + 1).cast("string")), own, F.lit("zz"))])
    said = n.groupBy("paper").agg(F.flatten(F.collect_list(edge)).alias("edges"))
    rows = said.select("paper", F.when(F.col("paper") % 3 > 0, F.concat(F.lit("text "), F.lit("```json\n"), F.to_json(F.struct("edges")), F.lit("\n```"))).otherwise("sorry").alias("reply"))
    old = n.where("line = 1 and paper % 2 = 0").select("paper", F.lit("n1").alias("source"), F.lit("n2").alias("target"))
    return replies.global_edges(rows, n.select("paper", own.alias("id")), old)


@query("""
    SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'leaky' WHEN 2 THEN 'too_long' ELSE 'leaky' END AS verdict FROM part""")
def generated_queries(spark, folder):
    n = F.col("p_size") % 4
    said = F.when(n == 0, F.concat(F.lit("Where is every "), "p_name", F.lit(" bounded?"))).when(n == 1, "What does Lemma 3.2 say?").when(n == 2, F.repeat(F.lit("why "), 31)).otherwise("")
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), _reply("query", F.struct(said.alias("query_text"))).alias("reply"))
    return replies.accepted_queries(rows, "Big Paper", ["k"]).select("k", "verdict")


@query("""
    SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS semantic_tag, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 2 = 0 END AS is_trivial,
           CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name || '|x' END AS terms, CASE WHEN p_partkey % 12 < 6 THEN 'openai' WHEN p_partkey % 12 < 10 THEN 'together' END AS provider, p_size % 3 = 0 AS was_repaired FROM part""")
def judged_statements(spark, folder):
    good = F.col("p_size") % 3 != 0
    p = table(spark, folder, "part").withColumn("k", F.col("p_partkey"))

    def said(value):
        return F.when(good, _reply("x", value)).otherwise("not json")

    tag = replies.tags(p.select("k", said(F.struct(F.concat(F.lit(" "), "p_type").alias("semantic_tag"))).alias("reply")), ["k"])
    lemma = replies.judged_lemmas(p.select("k", said(F.struct((F.col("p_size") % 2 == 0).alias("is_trivial"))).alias("reply")), ["k"]).select("k", "is_trivial")
    lists = replies.structured_lists(p.select("k", said(F.struct(F.array(F.col("p_name"), F.lit("x"), F.lit(" x "), F.lit("")).alias("terms"))).alias("reply")), ["k"])
    keyed = p.select(F.col("k").cast("string").alias("prompt_key"), said(F.struct(F.lit("t").alias("semantic_tag"))).alias("reply"))
    fixed = replies.repaired(keyed, "tag", p.select(F.col("k").cast("string").alias("prompt_key"), F.lit('{"semantic_tag": "u"}').alias("repaired")))
    out = tag.join(lemma, "k").join(lists.select("k", F.array_join("terms", "|").alias("terms")), "k").join(fixed.select(F.col("prompt_key").cast("long").alias("k"), "was_repaired"), "k")
    model = F.element_at(F.array(*map(F.lit, [*replies.PROVIDERS, "GPT-4o-2024-08-06", "gpt-5"])), (F.col("k") % 12 + 1).cast("int"))
    return out.select("k", "semantic_tag", "is_trivial", "terms", replies.provider_of(model, strict=False).alias("provider"), "was_repaired")


@query("""
    SELECT o_custkey AS paper, string_agg('[' || o_orderkey || ']' || chr(10) || o_orderpriority || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'short' ELSE repeat('y', 20) || chr(10) || '[proof cut]' END, chr(10) || chr(10) ORDER BY o_orderkey) AS message FROM orders GROUP BY 1""")
def paper_messages(spark, folder):
    nodes = table(spark, folder, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("content"), F.when(F.col("o_orderkey") % 2 == 0, "short").otherwise(F.repeat(F.lit("y"), 25)).alias("proof"))
    return replies.paper_message(nodes, 20)


# Retrieval


@query("""
    SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN labels ON doc_id % 8 = item_id % 9 AND quality % 2 = item_id % 2""")
def built_qrels(spark, folder):
    nodes = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") % 2 == 0, "Theorem").otherwise("lemma").alias("kind"), (F.col("doc_id") % 8).cast("string").alias("number"))
    ref = F.array(F.struct(F.when(F.col("item_id") % 2 == 0, "theorem").otherwise("Lemma").alias("kind"), (F.col("item_id") % 9).cast("string").alias("number")))
    return indexing.build_qrels(nodes, table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), ref.alias("refs")))


@query(r"""
    SELECT coalesce(CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS VARCHAR) END, sha256(text)) AS query_id, CASE WHEN item_id % 3 = 0 THEN 'vague' ELSE 'unknown' END AS style,
           CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM benchmark WHERE item_id % 4 < 3 AND text <> ''""")
def prepared_queries(spark, folder):
    precision = F.when(F.col("item_id") % 4 == 0, "Explicit").when(F.col("item_id") % 4 == 3, "implicit")
    q = table(spark, folder, "benchmark").select(F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query_text"), F.when(F.col("item_id") % 3 == 0, "vague").alias("query_style"), precision.alias("reference_precision"), F.array(F.lit("r")).alias("explicit_refs"))
    return indexing.prepared_queries(q, explicit_only=True, single_ref=True).select("query_id", "style", "n_words")


@query(f"""
    WITH {_bm25_sql('(1.5, 0.75)')}, o AS (SELECT query_id, id, rank, round(score, 6) + CASE WHEN id % 3 = 0 THEN 0.5 * 2 ELSE 0 END AS s, id % 3 = 0 AND query_id % 4 < 3 AS keep FROM r),
    w AS (SELECT *, max(CAST(keep AS INT)) OVER (PARTITION BY query_id) AS anyone FROM o)
    SELECT query_id, id, round(CASE WHEN anyone = 1 THEN s ELSE s - CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END END, 4) AS score FROM w WHERE keep OR anyone = 0""")
def boosted_results(spark, folder):
    found = materialize(_bm25(spark, folder).select("query_id", "id", "rank", F.round("score", 6).alias("score")), "found")  # read twice
    over = found.where("id % 3 = 0").select("query_id", "id", F.when(F.col("query_id") % 4 < 3, 2.0).otherwise(0.25).alias("overlap"))
    return retrieval.filter_boost(found, over, 1.0, 0.5).select("query_id", "id", F.round("score", 4).alias("score"))


@query(f"""
    WITH {_bm25_sql('(1.5, 0.75)')}, t AS (SELECT query_id, id, rank FROM r WHERE rank <= 3), m AS (SELECT query_id, min((rank, o)) AS spot, x FROM (SELECT query_id, rank, o, (id + o) % 500 + 1 AS x FROM t, (VALUES (1), (7)) v(o)) WHERE x % 2 = 0 GROUP BY query_id, x),
    n AS (SELECT * FROM m WHERE (query_id, x) NOT IN (SELECT (query_id, id) FROM t)), z AS (SELECT query_id, max(rank) AS last FROM t GROUP BY 1)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, false AS expanded FROM t
    UNION ALL SELECT query_id, CAST(last + row_number() OVER (PARTITION BY query_id ORDER BY spot, CAST(x AS VARCHAR)) AS INTEGER), x, true FROM n JOIN z USING (query_id)""")
def expanded_search(spark, folder):
    found = _bm25(spark, folder).select("query_id", "rank", F.col("id").cast("string").alias("id"))
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("i"))
    steps = F.inline(F.array(*[F.struct(((F.col("i") + o) % 500 + 1).cast("string").alias("target"), F.lit(o).alias("ord")) for o in (1, 7)]))
    types = spark.range(1, 502).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "lemma").otherwise("remark").alias("type"))
    out = retrieval.expanded_search(found, d.select(F.col("i").cast("string").alias("source"), steps), types, ["lemma"], 3)
    return out.select("query_id", "rank", F.col("id").cast("long").alias("id"), "expanded")


LATE = """v AS (SELECT vec_id AS id, CAST(embedding[1:8] AS DOUBLE[]) AS a, CAST(embedding[9:16] AS DOUBLE[]) AS b FROM embeddings), q AS (SELECT * FROM v WHERE id % 100 = 0),
    c AS (SELECT q.id AS query_id, v.id, list_dot_product(x, y) / ((sqrt(list_dot_product(x, x)) + 1e-9) * (sqrt(list_dot_product(y, y)) + 1e-9)) AS s, t FROM v, q, LATERAL (SELECT unnest([q.a, q.b]) AS x, unnest([1, 2]) AS t) e, LATERAL (SELECT unnest([v.a, v.b]) AS y) f),
    m AS (SELECT query_id, id, sum(s) AS score FROM (SELECT query_id, id, t, max(s) AS s FROM c GROUP BY ALL) GROUP BY ALL)"""
LATE_TOP = "SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM m QUALIFY rank <= 10"


def _late_parts(spark, folder):
    parts = F.array(F.slice("embedding", 1, 8), F.slice("embedding", 9, 8))
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), parts.alias("vs"))
    return v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vs").alias("qs"))


@query(f"WITH {LATE} {LATE_TOP}")
def late_interaction(spark, folder):
    return retrieval.late_interaction(*_late_parts(spark, folder)).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {LATE} {LATE_TOP}")
def late_index_topk(spark, folder):
    """The pruned index with all cells probed, so its bounds must leave the exact result."""
    docs, asked = _late_parts(spark, folder)
    return vectors.LateIndex(docs).search(asked).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""
    WITH {LATE}, r AS ({LATE_TOP}), t AS (SELECT query_id, id, rank FROM r WHERE rank <= 4),
    e AS (SELECT query_id, min((rank, o)) AS spot, x FROM (SELECT query_id, rank, o, (id * 7 + o * o) % 400 AS x FROM t, (VALUES (1), (2), (9)) v(o)) WHERE x % 4 IN (0, 1) GROUP BY query_id, x),
    n AS (SELECT * FROM e WHERE (query_id, x) NOT IN (SELECT (query_id, id) FROM t)), z AS (SELECT query_id, max(rank) AS last FROM t GROUP BY 1)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, false AS expanded FROM t
    UNION ALL SELECT query_id, CAST(last + row_number() OVER (PARTITION BY query_id ORDER BY spot, CAST(x AS VARCHAR)) AS INTEGER), x, true FROM n JOIN z USING (query_id)""")
def expanded_late_search(spark, folder):
    """The first four results of late interaction from the index, then their direct successors of two types."""
    docs, asked = _late_parts(spark, folder)
    found = vectors.LateIndex(docs).search(asked, 4).select("query_id", "rank", F.col("id").cast("string").alias("id"))
    steps = F.inline(F.array(*[F.struct(((F.col("id") * 7 + o * o) % 400).cast("string").alias("target"), F.lit(o).alias("ord")) for o in (1, 2, 9)]))
    edges = docs.select(F.col("id").cast("string").alias("source"), steps)
    kinds = F.element_at(F.array(*map(F.lit, ("lemma", "theorem", "remark", "example"))), (F.col("id") % 4 + 1).cast("int"))
    types = edges.select(F.col("target").cast("long").alias("id")).distinct().select(F.col("id").cast("string").alias("id"), kinds.alias("type"))
    out = retrieval.expanded_search(found, edges, types, ["lemma", "theorem"], 4)
    return out.select("query_id", "rank", F.col("id").cast("long").alias("id"), "expanded")


@query("""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(v.e, q.e) / ((sqrt(list_dot_product(v.e, v.e)) + 1e-9) * (sqrt(list_dot_product(q.e, q.e)) + 1e-9)) AS score FROM v, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r""")
def dense_index_topk(spark, folder):
    """The inverted file with all cells probed."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = vectors.CellIndex(v).search(v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")))
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("""
    WITH f AS (SELECT p_partkey AS id, 'terms' AS field, unnest(string_split(p_name, ' ')) AS token FROM part UNION SELECT p_partkey, 'expressions', p_type FROM part UNION SELECT p_partkey, 'domain', p_brand FROM part),
    n AS (SELECT count(*) AS n FROM part), i AS (SELECT token, ln((any_value(n) + 1) / (count(DISTINCT id) + 1)) + 1 AS idf FROM f, n GROUP BY 1),
    q AS (SELECT DISTINCT * EXCLUDE id, id AS query_id FROM f WHERE id % 50 = 0)
    SELECT query_id, f.id, round(sum(idf * CASE WHEN field = 'expressions' THEN 2 ELSE 1 END), 5) AS overlap FROM q JOIN f USING (field, token) JOIN i USING (token) GROUP BY ALL""")
def weighted_overlaps(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("t"), "p_type", "p_brand")
    f = p.select("id", F.inline(F.concat(F.transform("t", lambda x: F.struct(F.lit("terms").alias("field"), x.alias("token"))), F.array(F.struct(F.lit("expressions").alias("field"), F.col("p_type").alias("token")), F.struct(F.lit("domain").alias("field"), F.col("p_brand").alias("token"))))))
    return retrieval.weighted_overlap(f.where("id % 50 = 0").withColumnRenamed("id", "query_id"), f, digits=5)


@query(f"""
    WITH {_bm25_sql('(1.5, 0.75)')}, b AS (SELECT query_id, id // 2 AS id, min(rank) AS rank FROM r GROUP BY ALL), rel AS (SELECT DISTINCT item_id AS query_id, doc_id // 2 AS id FROM benchmark, labels WHERE doc_id % 8 = item_id % 9),
    n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1), h AS (SELECT query_id, count(*) AS found, min(rank) AS first_rank FROM b JOIN rel USING (query_id, id) GROUP BY 1)
    SELECT item_id AS query_id, coalesce(n_relevant, 0) AS n_relevant, CASE WHEN n_relevant > 0 THEN CAST(coalesce(found, 0) > 0 AS INT)::DOUBLE END AS hit, CASE WHEN n_relevant > 0 THEN CAST(first_rank AS DOUBLE) END AS first_rank
    FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN h ON h.query_id = item_id""")
def viewer_hits(spark, folder):
    def pair(i):
        return F.concat(F.floor(i / 2).cast("string"), F.when(i % 2 == 1, "#proof").otherwise(""))

    b = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"))
    good = table(spark, folder, "labels").select(pair(F.col("doc_id")).alias("id"), (F.col("doc_id") % 8).alias("m"))
    qrels = b.withColumn("m", F.col("query_id") % 9).join(good, "m")
    found = _bm25(spark, folder).select("query_id", pair(F.col("id")).alias("id"), "rank")
    return retrieval.viewer_metrics(found, qrels, b).select("query_id", "n_relevant", "hit", F.col("first_rank").cast("double").alias("first_rank"))


@query("""
    WITH r AS (SELECT p_partkey AS k, p_name AS content, 'T ' || p_size AS tag, p_type AS need FROM part), m AS (SELECT unnest(['content', 'content+prereqs', 'content+semantic', 'content+all']) AS mode)
    SELECT k, mode, '[LEM]' || CASE WHEN mode IN ('content+semantic', 'content+all') THEN ' ' || tag ELSE '' END || CASE WHEN mode IN ('content+prereqs', 'content+all') THEN ' needed: ' || need ELSE '' END || ' ' || content AS index_text FROM r, m""")
def index_modes(spark, folder):
    nodes = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("lemma").alias("type"), F.col("p_name").alias("content"), F.lit(None).cast("string").alias("proof"), F.concat(F.lit("T "), F.col("p_size").cast("string")).alias("semantic_tag"), F.create_map(F.lit("needed"), F.col("p_type")).alias("prerequisites"))
    out = None
    for mode in ("content", "content+prereqs", "content+semantic", "content+all"):
        part = indexing.index_documents(nodes, mode).select(F.col("node_id").cast("long").alias("k"), F.lit(mode).alias("mode"), "index_text")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
    SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'yyyyy' || chr(10) || '[proof cut]' ELSE 'yy' END AS cut FROM part""")
def cut_proofs(spark, folder):
    proof = F.when(F.col("p_size") % 2 == 0, F.repeat(F.lit("y"), 9)).otherwise("yy")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("k"), dependencies.cut_proof(proof, F.lit(5)).alias("cut"))


@query("""
    WITH t AS (SELECT DISTINCT p_brand AS paper, p_partkey AS artifact, unnest(string_split(p_name, ' ')) AS term FROM part), p AS (SELECT DISTINCT x.paper, x.artifact AS a, y.artifact AS b FROM t x JOIN t y ON x.paper = y.paper AND x.term = y.term AND x.artifact < y.artifact),
    e AS (SELECT p_partkey AS s, p_partkey + 1 AS t FROM part)
    SELECT paper, a AS source, b AS target FROM p WHERE (a, b) NOT IN (SELECT (s, t) FROM e)""")
def pairs_without_edges(spark, folder):
    p = table(spark, folder, "part")
    terms = p.select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("artifact"), F.explode(F.split("p_name", " ")).alias("term"))
    edges = p.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 1).alias("target"))
    return dependencies.new_overlap_pairs(terms, edges).select("paper", F.col("a").alias("source"), F.col("b").alias("target"))


@query("""
    WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey + p_size % 3 + 1 AS dst FROM part WHERE p_size % 5 > 0), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    w AS (SELECT a AS v, a AS c FROM u UNION SELECT u.b, least(w.c, u.b) FROM w JOIN u ON u.a = w.v WHERE least(w.c, u.b) <= w.c), comp AS (SELECT v, min(c) AS component FROM w GROUP BY v)
    SELECT component, count(*) AS size FROM comp GROUP BY 1""")
def chained_components(spark, folder):
    """Long chains: each part is linked with one of the next three."""
    p = table(spark, folder, "part").where("p_size % 5 > 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size") % 3 + 1).alias("dst"))
    return connected_components(p).groupBy("component").agg(F.count("*").alias("size"))


@query("""
    SELECT o_custkey AS source, CAST(arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS BIGINT) AS target FROM orders GROUP BY 1""")
def first_edges(spark, folder):
    e = table(spark, folder, "orders").select(F.col("o_custkey").alias("source"), F.lit(0).alias("target"), F.col("o_orderkey").alias("kind"), F.struct("o_totalprice", "o_orderkey").alias("ord"))
    return graph.dedup_edges(e, "ord").select("source", F.col("kind").cast("long").alias("target"))


# Commands and stored replies of services


@query("""
    WITH w AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
    SELECT 'processed' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM w)
    UNION ALL SELECT 'states', count(*) FROM (SELECT DISTINCT user_id, event_type FROM events) WHERE NOT (user_id IN (FROM w) AND event_type = 'view')
    UNION ALL SELECT 'queue', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM w WHERE id NOT IN (SELECT s_suppkey FROM supplier))""")
def reprocessed_papers(spark, folder):
    papers = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.lit("{}").alias("metadata"))
    done = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    states = table(spark, folder, "events").select(F.col("user_id").alias("paper"), F.col("event_type").alias("mode")).distinct()
    waiting = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("{}").alias("metadata"))
    parts = zip(("processed", "states", "queue"), commands.reprocess(papers, done, states, waiting, ["view"]), strict=True)
    rows = [part.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, part in parts]
    return rows[0].union(rows[1]).union(rows[2])


@query("""
    WITH q AS (SELECT DISTINCT user_id AS base, event_id % 23 AS v FROM events) SELECT count(*) AS before, count(*) - count(DISTINCT base) AS removed, count(DISTINCT base) AS after FROM q""")
def queue_report(spark, folder):
    q = table(spark, folder, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit("v"), (F.col("event_id") % 23).cast("string")).alias("arxiv_id")).distinct()
    return commands.deduplicated_queue(q)[1]


@query("""
    SELECT 'zero' AS kind, count(DISTINCT c_custkey // 2) AS n FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'discovered', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey // 2 FROM customer)
    UNION ALL SELECT 'all', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey // 2 FROM customer)""")
def backfill_selections(spark, folder):
    c = table(spark, folder, "customer").select(F.concat((F.floor(F.col("c_custkey") / 2)).cast("string"), F.lit("v"), (F.col("c_custkey") % 2 + 1).cast("string")).alias("id"), (F.col("c_custkey") % 5).alias("count"))
    d = table(spark, folder, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit("v1")).alias("id"))
    out = None
    for kind in ("zero", "discovered", "all"):
        part = commands.backfill_ids(kind, c.select("id"), d, c).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.union(part)
    return out


@query(f"""
    WITH RECURSIVE {EDGES}, {REACH}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1), l AS (SELECT component, count(*) AS n_edges FROM e JOIN comp ON v = src GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY size DESC, component) AS INTEGER) AS rank, component, CAST(size AS INTEGER) AS n_nodes, CAST(n_edges AS INTEGER) AS n_edges FROM s JOIN l USING (component) QUALIFY rank <= 3""")
def component_documents(spark, folder):
    e = _nation_edges(spark, folder).toDF("source", "target")
    none = spark.createDataFrame([], "id string, title string")
    out = commands.component_documents(e, none, none, 3)
    return out.select("rank", "component", F.size(F.from_json(F.get_json_object("json", "$.nodes"), "array<struct<id: string>>")).alias("n_nodes"), F.size(F.from_json(F.get_json_object("json", "$.edges"), "array<struct<source: string>>")).alias("n_edges"))


@query("""
    SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN 'archive' WHEN 1 THEN 'pdf' WHEN 2 THEN 'recaptcha' WHEN 3 THEN 'withdrawn' ELSE 'html' END AS state FROM part""")
def download_states(spark, folder):
    n = F.col("p_size") % 5
    body = F.when(n == 0, F.unhex(F.lit("1F8B0800"))).when(n == 1, F.lit("%PDF-1.5").cast("binary")).when(n == 2, F.lit("<HTML> reCAPTCHA").cast("binary")).when(n == 3, F.lit("<!DOCTYPE html> This paper is Withdrawn").cast("binary")).otherwise(F.concat(F.lit("<html>"), "p_name").cast("binary"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("k"), files.download_state(body).alias("state"))


@query("""
    SELECT p_partkey AS page, 'W' || p_partkey || '_' || i AS id, CAST(p_size AS BIGINT) AS cited_by_count, CASE WHEN p_size % 2 = 0 THEN 'c' || p_partkey END AS next_cursor FROM part, (VALUES (1), (2)) v(i) WHERE p_size % 7 > 0""")
def stored_work_pages(spark, folder):
    p = table(spark, folder, "part")
    works = F.array(*[F.struct(F.concat_ws("_", F.concat(F.lit("W"), F.col("p_partkey").cast("string")), F.lit(str(i))).alias("id"), F.col("p_size").alias("cited_by_count")) for i in (1, 2)])
    meta = F.struct(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).alias("next_cursor"), F.lit(2).alias("count"))
    pages = p.select(F.col("p_partkey").alias("page"), F.when(F.col("p_size") % 7 > 0, F.to_json(F.struct(works.alias("results"), meta.alias("meta")))).otherwise("{broken").alias("json"))
    found, cursors = files.work_pages(pages, "json", "id: string, cited_by_count: bigint")
    return found.join(cursors.select("page", "next_cursor"), "page")


@query("""
    SELECT p_partkey AS k, CAST(i AS INTEGER) AS page, CAST(p_size AS DOUBLE) AS x0, 90.0::DOUBLE AS y0, p_size + 5.5 AS x1, 100.0::DOUBLE AS y1 FROM (SELECT *, CAST(p_size AS DOUBLE) FROM part), (VALUES (1), (2)) v(i)""")
def synctex_boxes(spark, folder):
    def one(i):
        return F.concat(F.lit(f"Output:a.pdf\nPage:{i}\nx:"), F.col("p_size").cast("string"), F.lit("\ny:100.0\nh:1\nv:2\nW:5.5\nH:10\n"))

    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("SyncTeX result begin\n"), one(1), one(2)).alias("said"))
    return files.synctex_hits(rows, "said", ["k"]).select("k", "page", "box.*")


@query("SELECT p_partkey AS k, CASE WHEN p_size % 4 > 0 THEN p_name END AS id, p_size % 4 = 0 AS broken FROM part")
def artifact_arrays(spark, folder):
    body = F.when(F.col("p_size") % 4 > 0, F.to_json(F.array(F.struct(F.col("p_name").alias("id"))))).otherwise("[{")
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), body.alias("json"))
    return files.artifacts_from_json(rows, "json", "id: string").select("k", "id", F.col("_corrupt").isNotNull().alias("broken"))
