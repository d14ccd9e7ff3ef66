"""Classification of failures, records and works in plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.ids import parse_id

# Fixed values: (pattern of the exception's type, pattern of the message, code, stage), in order.
ERROR_RULES = [
    (r"(?i)withdrawn", r"(?i)withdrawn", "withdrawn", "download"),
    (r"(?i)captcha", r"(?i)recaptcha|captcha", "recaptcha", "download"),
    (r"(?i)rate", r"(?i)\b429\b|rate limit|too many requests", "rate_limited", "llm"),
    (r"(?i)auth", r"(?i)\b401\b|unauthorized|invalid api key", "auth_failed", "llm"),
    (r"(?i)timeout", r"(?i)timed? ?out", "timeout", "network"),
    (r"(?i)connection|clienterror", r"(?i)connection (?:reset|refused|error)|cannot connect", "network_error", "network"),
    (r"(?i)badzip|tarerror|readerror", r"(?i)not a gzip|corrupt|truncated|bad zip", "corrupt_archive", "extract"),
    (r"(?i)filenotfound", r"(?i)no tex|no such file", "no_tex_files", "extract"),
    (r"(?i)unicode", r"(?i)codec can't decode", "decode_error", "extract"),
    (r"(?i)empty", r"(?i)empty graph|no artifacts", "empty_graph", "parse"),
    (r"(?i)jsondecode|validation", r"(?i)json|validation error", "bad_reply", "llm"),
    (r"(?i)operationalerror|integrity", r"(?i)database is locked|constraint failed", "database_error", "persist"),
    (r"(?i)memory", r"(?i)out of memory", "out_of_memory", "runtime"),
    (r"(?i)valueerror", r"(?i)invalid (?:arxiv )?id", "invalid_id", "input"),
]


def error_code(kind: Column, message: Column) -> Column:
    """Struct of code and stage: the first rule whose message or type matches, else unknown."""
    text, name = F.coalesce(message, F.lit("")), F.coalesce(kind, F.lit(""))
    out = F.struct(F.lit("unknown").alias("code"), F.lit("unknown").alias("stage"))
    for types, words, code, stage in reversed(ERROR_RULES):
        out = F.when(text.rlike(words) | name.rlike(types), F.struct(F.lit(code).alias("code"), F.lit(stage).alias("stage"))).otherwise(out)
    return out


# What makes a query leak where its answer stands, and the longest query.
LEAKS = [
    r"\b(?:Theorem|Thm\.?|Lemma|Lem\.?|Proposition|Prop\.?|Corollary|Cor\.?|Definition|Def\.?|Example|Ex\.?|Remark|Rem\.?)\s*\d+(?:\.\d+)*\s*(?:\([ivxIVX]+\))?\b",
    r"\b(?:Section|Sec\.?)\s*\d+(?:\.\d+)*\b",
    r"§\s*\d+(?:\.\d+)*",
    r"\[[A-Za-z]{2,}\d{2,}[^\]]*\]",
    r"\(\s*[ivxIVX]+\s*\)",
    r"\bConjecture\s*\d+(?:\.\d+)*\b",
    r"\bSch(?:olze)?\s*\d{2,4}\b",
]
MAX_QUERY_WORDS = 30
# Fixed values: (exception classes, fragments of the message of which one must occur, code, stage), in order.
EXTRACTOR, PROVIDER = ["ArxivExtractorError"], ["APIConnectionError", "APIError", "RateLimitError", "APITimeoutError"]
TIMEOUTS = ["TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout", "TimeoutError"]
HTTP = ["HTTPError", "HTTPStatusError", "RequestError", "TransportError", "NetworkError", "ConnectError", "ReadError", "WriteError", "CloseError", "ProtocolError", "LocalProtocolError", "RemoteProtocolError", "ProxyError", "UnsupportedProtocol", "DecodingError", "TooManyRedirects"]
FAILURES = [
    (EXTRACTOR, ["pdf-only", "pdf only"], "no_latex_source", "extract"),
    (EXTRACTOR, ["failed to download source"], "source_download_failed", "download"),
    (EXTRACTOR, ["withdrawn"], "paper_withdrawn", "download"),
    (EXTRACTOR, ["recaptcha"], "source_blocked_by_recaptcha", "download"),
    (EXTRACTOR, ["gzip archive is corrupted"], "source_gzip_corrupt", "extract"),
    (EXTRACTOR, ["tar archive is corrupted"], "source_tar_corrupt", "extract"),
    (EXTRACTOR, ["zip archive is corrupted"], "source_zip_corrupt", "extract"),
    (EXTRACTOR, ["unable to extract or identify downloaded file format"], "source_extract_failed", "extract"),
    (EXTRACTOR, [], "extractor_error", "extract"),
    (["ValueError"], ["invalid arxiv id format"], "invalid_arxiv_id", "download"),
    (["ValueError"], ["empty graph", "empty or invalid graph"], "graph_empty", "graph_build"),
    (PROVIDER, ["rate limit"], "llm_rate_limited", "llm"),
    (PROVIDER, ["timeout"], "llm_timeout", "llm"),
    (PROVIDER, [], "llm_api_error", "llm"),
    (TIMEOUTS, [], "llm_timeout", "llm"),
    (HTTP, [], "llm_connection_error", "llm"),
]


def payload_kind(content: Column) -> Column:
    """gzip, zip, pdf, recaptcha, html or unknown of a downloaded payload, by its first 2048 bytes."""
    head = F.hex(F.substring(content, 1, 4))
    text = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    return F.when(head.startswith("1F8B"), "gzip").when(head == "504B0304", "zip").when(head == "25504446", "pdf").when(text.contains("recaptcha"), "recaptcha").when(text.contains("<html"), "html").otherwise("unknown")


def extractor_mode(enrich: Column, infer: Column) -> Column:
    return F.when(enrich & infer, "full").when(enrich, "defs").when(infer, "deps").otherwise("raw")


def is_leaky(query: Column, target: Column) -> Column:
    """Queries that are blank, name their target or match one of ``LEAKS``."""
    text, name = F.coalesce(query, F.lit("")), F.lower(F.coalesce(target, F.lit("")))
    return (text == "") | (F.contains(F.lower(text), name) & (name != "")) | text.rlike("|".join(LEAKS))


def is_too_long(query: Column, most: int = MAX_QUERY_WORDS) -> Column:
    """Blank queries, and those with more than ``most`` words."""
    return (F.coalesce(query, F.lit("")) == "") | (F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) > most)


def _first_hit(rules: list[tuple[Column, str, str]], code: str, stage: str) -> Column:
    out = F.struct(F.lit(code).alias("code"), F.lit(stage).alias("stage"))
    for holds, c, s in reversed(rules):
        out = F.when(holds, F.struct(F.lit(c).alias("code"), F.lit(s).alias("stage"))).otherwise(out)
    return out


def processing_error(kind: Column, message: Column) -> Column:
    """Struct of code and stage by the exception's class and its message, in the order of ``FAILURES``; else unexpected_error."""
    text, name = F.lower(F.coalesce(F.nullif(message, F.lit("")), kind, F.lit(""))), F.coalesce(kind, F.lit(""))
    rules = []
    for classes, fragments, code, stage in FAILURES:
        holds = name.isin(classes)
        if fragments:
            said = F.lit(False)
            for fragment in fragments:
                said = said | text.contains(fragment)
            holds = holds & said
        rules.append((holds, code, stage))
    return _first_hit(rules, "unexpected_error", "unknown")


def failures_by_stage(failures: DataFrame) -> DataFrame:
    """(stage, n): a failure without a stage counts as unknown."""
    return failures.groupBy(F.coalesce(F.nullif(F.col("stage"), F.lit("")), F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))


def report_rows(summaries: DataFrame, metadata: DataFrame) -> DataFrame:
    """A row per experiment of each run: summaries (run_id, metrics map<string, map<string, double>>, runtimes map<string, double>), metadata (run_id, ...)."""
    rows = summaries.select("run_id", "runtimes", F.explode("metrics").alias("experiment", "m"))
    named = [F.try_element_at("m", F.lit(name)).alias(column) for name, column in (("nDCG@10", "ndcg"), ("Recall@10", "recall"), ("Hit@10", "hit"))]
    return rows.select("run_id", "experiment", *named, F.try_element_at("runtimes", F.col("experiment")).alias("runtime_sec")).join(metadata, "run_id", "left")


def work_records(works: DataFrame) -> DataFrame:
    """works (id, display_name, cited_by_count, ids map, indexed_in array, locations array<struct<url>>) with paper id and availability."""
    urls = F.transform("locations", lambda x: x["url"])
    from_urls = F.get(F.filter(F.transform(urls, parse_id), lambda x: x.isNotNull()), F.lit(0))
    paper = F.coalesce(parse_id(F.try_element_at("ids", F.lit("arxiv"))), F.when(F.exists(urls, lambda u: u.contains("arxiv.org")), from_urls))
    listed = F.coalesce(F.array_contains("indexed_in", "arxiv"), F.lit(False)) | F.coalesce(F.exists(urls, lambda u: u.contains("arxiv.org")), F.lit(False))
    return works.withColumns({"paper_id": paper, "on_arxiv": paper.isNotNull() | listed, "missing_id": paper.isNull() & listed})


def merge_citing(works: DataFrame) -> DataFrame:
    """One row per citing work id with the union of its targets; works without an id stay apart. works (id, target, ord, title)."""
    named = works.where("id is not null").groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"])).alias("targets"), F.min_by("title", "ord").alias("title"))
    return named.unionByName(works.where("id is null").select("id", F.array("target").alias("targets"), "title"))


def counters(outcomes: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """One row: how many outcomes there are of each kind, and all."""
    return outcomes.agg(F.count("*").alias("considered"), *[F.count_if(F.col(column) == k).alias(k) for k in kinds])
