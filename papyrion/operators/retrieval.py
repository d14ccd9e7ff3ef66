"""Lexical, dense and fused retrieval, reranking and ranking metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.text import length_bucket, refs_bucket, tokens, type_hint
from papyrion.operators import vectors as vectors_
from papyrion.operators.graph import expand_results
from papyrion.workspace import apart, materialize

RRF_K = 60
#: Members of a class in a row, and tasks that classes are dealt to.
BLOCK, SPREAD = 1_000, 256
#: Characters of the texts that a task counts tokens of.
TEXTS = 16_000_000
#: Products of a query's weight and a document's that a task of the lexical search sums.
SUMS = 4_000_000
#: The same of a task that sums overlaps of structured fields, whose pairs nearly all differ.
OVERLAPS = 1_000_000


def document_frequencies(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(token, df): each document's distinct tokens, combined map-side."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Written table (id, dl, token, tf): the wanted tokens of each document, and one row (token null) for all others.

    Each text is tokenised once.  Texts are dealt by document to tasks of about ``TEXTS`` characters first, so
    counts aren't shuffled and a task's hash table doesn't grow with the corpus.
    """
    length = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"]
    dealt = docs.select("id", "text").repartition(max(1, math.ceil((length or 0) / TEXTS)), "id")
    each = dealt.select("id", F.explode(tokens(F.col("text"))).alias("token"))
    marked = each.join(wanted.withColumnRenamed("token", "w"), F.col("token") == F.col("w"), "left")
    counted = marked.groupBy("id", F.col("w").alias("token")).agg(F.count("*").alias("tf"))
    return materialize(counted.withColumn("dl", F.sum("tf").over(Window.partitionBy("id"))), "postings")


def bm25(docs: DataFrame, queries: DataFrame, parameters: list[tuple[float, float]] = ((1.5, 0.75),), k: int = 10) -> DataFrame:
    """(k1, b, query_id, id, score, rank): the best k documents of each query and setting.

    docs (id, text), queries (query_id, text).  Each occurrence of a query token counts; ties by
    id.  The queries' vocabulary is a written table, so it is broadcast only while it is small.
    All settings are summed in one pass over the postings and ranked apart.  Postings are dealt by
    document to tasks of about ``SUMS`` sums, so sums aren't shuffled and a task's memory doesn't grow with the corpus.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    asked = materialize(asked, "asked")
    posted = postings(docs, materialize(asked.select("token").distinct(), "wanted"))
    size = docs.agg(F.count("*").alias("n")).join(posted.agg(F.sum("tf").alias("all")))
    found = posted.where("token is not null")
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = materialize(asked.join(df, "token").join(F.broadcast(size)).select("query_id", "token", (F.col("qtf") * idf).alias("weight"), (F.col("all") / F.col("n")).alias("avgdl")), "weights")

    def part(k1: float, b: float) -> Column:
        return F.sum(F.col("weight") * F.col("tf") / (F.col("tf") + F.lit(k1) * (1 - F.lit(b) + F.lit(b) * F.col("dl") / F.col("avgdl"))))

    met = found.groupBy("token").count().join(asked.groupBy("token").agg(F.count("*").alias("m")), "token").agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    dealt = found.repartition(max(1, math.ceil((met or 0) / SUMS)), "id")
    scores = dealt.join(weighed, "token").groupBy("query_id", "id").agg(*[part(k1, b).alias(f"s{j}") for j, (k1, b) in enumerate(parameters)])
    settings = F.array(*[F.struct(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"), F.col(f"s{j}").alias("score")) for j, (k1, b) in enumerate(parameters)])
    scored = scores.select("query_id", "id", F.inline(settings)).select("k1", "b", "query_id", "id", "score")
    order = Window.partitionBy("k1", "b", "query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(x: Column, y: Column) -> Column:
    """Cosine with 1e-9 added to both norms."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(x, y) / ((F.sqrt(dot(x, x)) + 1e-9) * (F.sqrt(dot(y, y)) + 1e-9))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = vectors_.ASKED) -> DataFrame:
    """(query_id, id, score, rank): vectors (id, v) against a stated query set (query_id, q), exactly, in blocks of ``block`` queries.

    Both sides meet in blocks, so neither passes the driver; ``vectors.CellIndex`` serves large query sets.
    """
    return vectors_.exact_topk(vectors, queries, k, asked=block)


def rrf(results: DataFrame, k: int = 10, constant: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank) fused from results (run, query_id, id, rank from 1); ties by id."""
    scored = results.groupBy("query_id", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank_by_hint(results: DataFrame, queries: DataFrame, types: DataFrame) -> DataFrame:
    """results (query_id, id, rank) with new_rank: documents of the query's hinted type first, order kept."""
    hinted = queries.select("query_id", type_hint(F.col("text")).alias("hint"))
    base = F.regexp_replace("id", "#proof", "")
    rows = results.withColumn("__base", base).join(types.select(F.col("id").alias("__base"), F.lower("type").alias("type")), "__base", "left").join(hinted, "query_id", "left")
    match = F.coalesce(F.col("type") == F.col("hint"), F.lit(False))
    order = Window.partitionBy("query_id").orderBy(match.desc(), "rank")
    return rows.select("query_id", "id", "rank", match.alias("matches"), F.row_number().over(order).alias("new_rank"))


def structured_idf(fields: DataFrame) -> DataFrame:
    """(token, idf) over artifacts' structured tokens; fields (id, tokens)."""
    n = fields.agg(F.count("*").alias("n"))
    df = fields.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def structured_overlap(fields: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, overlap): idf summed over the structured tokens in common; fields (id, tokens), asked (query_id, token).

    Artifacts are dealt to tasks of about ``OVERLAPS`` sums, so sums aren't shuffled and a task's memory doesn't grow with them.
    """
    each = fields.select("id", F.explode("tokens").alias("token"))
    weights = materialize(asked.join(structured_idf(fields), "token"), "weights")
    met = each.groupBy("token").agg(F.count("*").alias("n")).join(weights.groupBy("token").agg(F.count("*").alias("m")), "token").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    dealt = each.repartition(max(1, math.ceil((met or 0) / OVERLAPS)), "id")
    return dealt.join(weights, "token").groupBy("query_id", "id").agg(F.sum("idf").alias("overlap"))


def filter_boost(results: DataFrame, overlap: DataFrame, minimum: float, boost: float) -> DataFrame:
    """results (query_id, id, score) with boosted scores; rows under the minimum go unless all would.

    overlap (query_id, id, overlap).  The order of the results isn't changed.
    """
    rows = results.join(overlap, ["query_id", "id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    rows = rows.withColumn("keep", F.col("overlap") >= minimum).withColumn("any", F.max("keep").over(Window.partitionBy("query_id")))
    boosted = F.when(F.col("any"), F.col("score") + boost * F.col("overlap")).otherwise(F.col("score"))
    return rows.where(F.col("keep") | ~F.col("any")).withColumn("score", boosted).drop("any", "keep")


def query_metrics(results: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """A row per query: n_relevant, ndcg, recall, hit, first_rank; null metrics without judgements.

    results (query_id, id, rank), qrels (query_id, id), queries (query_id).
    """
    relevant = qrels.select("query_id", "id").distinct()
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = results.join(relevant, ["query_id", "id"], "left_semi")
    inside = F.col("rank") <= k
    sums = hits.groupBy("query_id").agg(
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count_if(inside).alias("found"), F.min("rank").alias("first_rank")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = queries.select("query_id").join(n, "query_id", "left").join(sums, "query_id", "left")
    some = F.col("n_relevant") > 0
    found = F.coalesce("found", F.lit(0))
    return rows.select(
        "query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.when(some, F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.when(some, found / F.col("n_relevant")).alias("recall"), F.when(some, (found > 0).cast("double")).alias("hit"), F.when(some, F.col("first_rank")).alias("first_rank"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over queries with judgements; zeros if there are none."""
    judged = metrics.where("n_relevant > 0")
    return judged.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("ndcg", "recall", "hit")], F.count("*").alias("n_queries"))


def strata(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean hit by style, by length bucket and by number of references, in one pass with grouping sets.

    queries (query_id, style, n_words, n_refs).
    """
    rows = metrics.where("n_relevant > 0").join(queries, "query_id").select("hit", F.col("style"), length_bucket(F.col("n_words")).alias("length"), refs_bucket(F.col("n_refs")).alias("refs"))
    out = rows.groupingSets([[F.col("style")], [F.col("length")], [F.col("refs")]], "style", "length", "refs").agg(F.avg("hit").alias("hit"), F.count("*").alias("n"))
    kind = F.when(F.col("style").isNotNull(), "style").when(F.col("length").isNotNull(), "length").otherwise("refs")
    return out.select(kind.alias("stratum"), F.coalesce("style", "length", "refs").alias("bucket"), "hit", "n")


def late_interaction(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """MaxSim over token vectors: docs (id, vs), queries (query_id, qs), both array<array>, exactly; ``vectors.LateIndex`` prunes."""
    return vectors_.late_topk(docs, queries, k)


def expanded_search(results: DataFrame, edges: DataFrame, types: DataFrame, allowed: list[str], k: int = 10) -> DataFrame:
    """Search by graph expansion: the first k results of a ranking, then their direct successors of an allowed type."""
    return expand_results(results.where(F.col("rank") <= k).select("query_id", "rank", "id"), edges, types, allowed)


def weighted_overlap(wanted: DataFrame, fields: DataFrame, weights: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, id, overlap): inverse document frequencies of the shared tokens, by field, rounded to ``digits`` if given.

    wanted (query_id, field, token), fields (id, field, token); expressions count twice, a token
    that no document has would count 1.  Frequencies are those of the distinct tokens of documents.

    Queries with the same tokens are one class and so are documents; overlaps are summed by pairs of
    classes where the documents' class is and rounded there; pairs of members are made last, without a shuffle,
    those of one query with a block of documents at a time.
    """
    weights = weights or {"terms": 1.0, "expressions": 2.0, "domain": 1.0}
    documents, rows = _classes(fields, "id")
    asked, questions = _classes(wanted, "query_id")
    n = fields.agg(F.count_distinct("id").alias("n"))
    df = fields.select("token", "id").distinct().groupBy("token").agg(F.count("id").alias("df"))
    idf = df.join(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    factor = F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("field"))
    each = documents.select("class", F.explode("tokens").alias("x")).select("class", "x.*").join(idf, "token", "left")
    each = materialize(each.select("class", "field", "token", (factor * F.coalesce("idf", F.lit(1.0))).alias("worth")), "worths")
    asked = materialize(asked.select(F.col("class").alias("asked"), F.explode("tokens").alias("x")).select("asked", "x.*"), "asked")
    summed = each.repartition(SPREAD, "class").join(asked, ["field", "token"]).groupBy("class", "asked").agg(F.sum("worth").alias("overlap"))
    if digits is not None:
        summed = summed.withColumn("overlap", F.round("overlap", digits))
    pairs = summed.join(questions.withColumnRenamed("class", "asked"), "asked").join(rows, "class")  # the longer lists come last
    each = apart(pairs.select("overlap", "ids", F.explode("queries").alias("query_id")))
    return each.select("query_id", F.explode("ids").alias("id"), "overlap")


def _classes(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Written tables of the keys' different sets of (field, token): (class, tokens), and (class, ids or queries) in blocks of about ``BLOCK``."""
    sets = rows.select(key, "field", "token").where(F.col("field").isNotNull() & F.col("token").isNotNull())
    sets = materialize(sets.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("field", "token"))).alias("tokens")), "sets")
    kinds = sets.groupBy("tokens").agg(F.count("*").alias("n"))
    kinds = materialize(kinds.select(F.monotonically_increasing_id().alias("class"), "tokens", F.ceil(F.col("n") / BLOCK).alias("blocks")), "kinds")
    members = sets.join(kinds, "tokens").groupBy("class", F.pmod(F.xxhash64(key), "blocks").alias("block"))
    members = members.agg(F.collect_list(F.struct(key)).alias("m"))  # structs, since a key may be null
    return kinds, materialize(members.select("class", F.col("m")[key].alias("queries" if key == "query_id" else "ids")), "members")


def viewer_metrics(results: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_metrics`` as a viewer shows them: a proof counts as its statement, at its first rank."""
    base = F.regexp_replace(F.col("id").cast("string"), "#proof$", "")
    first = results.groupBy("query_id", base.alias("id")).agg(F.min("rank").alias("rank"))
    return query_metrics(first, qrels.select("query_id", base.alias("id")), queries, k)
