"""Readers of source trees, archives, feeds and graph files."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File signatures.
SIGNATURES = {"504B0304": "zip", "1F8B": "gzip", "25504446": "pdf"}


def file_kind(content: Column) -> Column:
    """zip, gzip, pdf, tar, tex or unknown by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(F.substring(content, 258, 5) == F.lit(b"ustar"), "tar")
    for sign, kind in SIGNATURES.items():
        out = out.when(head.startswith(sign), kind)
    text = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return out.when(text.rlike(r"\\(documentclass|documentstyle|begin|input|magnification|section)"), "tex").otherwise("unknown")


# What marks a file without a suffix as TeX.
TEX_MARKS = r"\\(documentclass|documentstyle|begin\{document\}|input|magnification|section)"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; what isn't UTF-8 is left out."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\ufffd", "")


def combined_tex(spark: SparkSession, folder: str) -> DataFrame:
    """(paper, text) of folder/<paper>/**: its .tex files in path order, each after a line with its name.

    A paper without any gives its files without a suffix whose first 4096 bytes have a TeX command.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.tex,[!.]*}").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    below = F.regexp_extract("path", r"([^/]+)/(?:[^/]+/)*[^/]+$", 1)
    paper = F.regexp_extract("path", rf"{folder.rstrip('/').split('/')[-1]}/([^/]+)/", 1)
    bare = ~name.contains(".") & F.decode(F.substring("content", 1, 4096), "ISO-8859-1").rlike(TEX_MARKS)
    kind = F.when(name.endswith(".tex"), 0).when(bare, 1)
    marked = files.select("path", "content", name.alias("name"), kind.alias("kind"), F.coalesce(F.nullif(paper, F.lit("")), below).alias("paper")).where("kind is not null")
    part = F.struct("path", F.concat(F.lit("\n% --- Source File: "), "name", F.lit(" ---\n"), decoded(F.col("content"))).alias("t"))
    of = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, part))) for k in (0, 1)]
    chosen = marked.groupBy("paper").agg(of[0].alias("tex"), of[1].alias("bare"))
    return chosen.select("paper", F.array_join(F.transform(F.when(F.size("tex") > 0, F.col("tex")).otherwise(F.col("bare")), lambda x: x["t"]), "").alias("text"))


def _members(content: bytes) -> list[tuple[str, bytes]]:
    """Files of a tar, gzip or zip archive, or the plain bytes; unsafe member names are left out."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            return [(m.name, tar.extractfile(m).read()) for m in tar.getmembers() if m.isfile()]
    except tarfile.TarError:
        pass
    if content[:2] == b"\x1f\x8b":
        data = gzip.decompress(content)
        if b"\\" not in data or sum(32 <= c < 127 or c in (9, 10, 13) for c in data[:4096]) <= 0.85 * len(data[:4096]):
            raise ValueError("no TeX source in the gzip file")
        return [("source.tex", data)]
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(n, z.read(n)) for n in z.namelist() if not n.endswith("/")]
    return [("source.tex", content)]


def archive_members(archives: DataFrame) -> DataFrame:
    """(archive, path, text, error) of a binaryFile table; a broken archive gives one row with its error."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    for name, data in _members(content):
                        if not name.startswith("/") and ".." not in name.split("/"):
                            rows.append((path, name, data.decode("utf-8", "ignore"), None))
                except Exception as error:  # noqa: BLE001 - a corrupt archive is a row
                    rows.append((path, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["archive", "path", "text", "error"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, text string, error string")


# Name spaces of the feed.
ATOM, ARXIV = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}"


TOTAL = "{http://a9.com/-/spec/opensearch/1.1/}totalResults"


def feed_page(xml: str) -> tuple[int, int, list[tuple]]:
    """(papers, total, papers' rows) of an Atom feed; (0, 0, []) if it is malformed, has no total or holds an error entry."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return 0, 0, []
    total = root.find(TOTAL)
    entries = root.findall(f"{ATOM}entry")
    failed = any((e.findtext(f"{ATOM}title") or "").strip() == "Error" for e in entries)
    if failed or total is None or not (total.text or "").strip().isdigit():
        return 0, 0, []
    rows = [r for e in entries if (r := _paper(e)) is not None]
    return len(rows), int(total.text), rows


def _paper(entry: ElementTree.Element) -> tuple | None:
    def text(tag: str) -> str | None:
        found = entry.find(tag)
        return " ".join(found.text.split()) if found is not None and found.text else None

    if not (text(f"{ATOM}id") and text(f"{ATOM}title") and text(f"{ATOM}summary")):
        return None
    categories = [c.get("term") for c in entry.iter(f"{ATOM}category") if c.get("scheme") == "http://arxiv.org/schemas/atom"]
    primary = entry.find(f"{ARXIV}primary_category")
    main = primary.get("term") if primary is not None else (categories[0] if categories else "unknown")
    authors = [n.text.strip() for n in entry.iter(f"{ATOM}name") if n.text]
    return text(f"{ATOM}id").rpartition("/abs/")[2], text(f"{ATOM}title"), authors, text(f"{ATOM}summary"), text(f"{ARXIV}comment"), main, categories


def feed_entries(xml: str) -> list[tuple]:
    """Papers of an Atom feed whether or not it tells a total; a malformed feed has none."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    return [r for e in root.iter(f"{ATOM}entry") if (r := _paper(e)) is not None]


def feed_totals(feeds: DataFrame, key: str, column: str = "xml") -> DataFrame:
    """(key, n_papers, total) of each feed."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(k, *feed_page(x)[:2]) for k, x in zip(frame["k"], frame["x"], strict=True)], columns=["k", "n_papers", "total"])

    return feeds.select(F.col(key).cast("long").alias("k"), F.col(column).alias("x")).mapInPandas(run, "k long, n_papers long, total long").withColumnRenamed("k", key)


def feed_papers(feeds: DataFrame, column: str = "xml") -> DataFrame:
    schema = "arxiv_id string, title string, authors array<string>, abstract string, comment string, primary_category string, all_categories array<string>"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for x in frame["x"] for r in feed_entries(x)], columns=names)

    return feeds.select(F.col(column).alias("x")).mapInPandas(run, schema)


def graph_files(spark: SparkSession, path: str, node: str, edge: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON graphs, bare or under ``graph``; explicit schemas, never inferred."""
    body = f"nodes array<struct<{node}>>, edges array<struct<{edge}>>"
    rows = spark.read.schema(f"{body}, graph struct<{body.replace('nodes array', 'nodes: array').replace('edges array', 'edges: array')}>").option("multiLine", "true").json(path)
    return tuple(rows.select(F.inline(F.coalesce(f"graph.{part}", part))) for part in ("nodes", "edges"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by its suffix."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.option("header", "true").csv(path)
    raise ValueError(f"unsupported format: {path}")


# Stored replies of services: pages of works, synchronisation hits, downloads


def download_state(content: Column) -> Column:
    """archive, pdf, recaptcha, withdrawn, html or unknown of a downloaded payload, by its first 2048 bytes."""
    kind = file_kind(content)
    text = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    page = text.rlike(r"<!doctype html|<html")
    return F.when(kind.isin("zip", "gzip", "tar"), "archive").when(kind == "pdf", "pdf").when(page & text.contains("recaptcha"), "recaptcha").when(page & text.contains("withdrawn"), "withdrawn").when(page, "html").otherwise(kind)


def work_pages(pages: DataFrame, column: str, work: str) -> tuple[DataFrame, DataFrame]:
    """(works, cursors) of stored result pages: the works by their schema, and each page's next cursor; a page that is no JSON has neither.

    pages (page, <column>).
    """
    read = pages.select("page", F.from_json(column, f"results array<struct<{work}>>, meta struct<next_cursor: string, count: bigint>").alias("x"))
    return read.select("page", F.inline("x.results")), read.select("page", F.col("x.meta.next_cursor").alias("next_cursor"), F.col("x.meta.count").alias("count")).where("next_cursor is not null or count is not null")


def synctex_hits(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(*keep, page, box): hits of a stored SyncTeX answer (Page, x, y, W, H lines); y is the lower edge of a box."""
    hit = r"Page:(\d+)[\s\S]*?\nx:([-\d.]+)\ny:([-\d.]+)[\s\S]*?\nW:([-\d.]+)\nH:([-\d.]+)"
    found = F.arrays_zip(*[F.regexp_extract_all(column, F.lit(hit), F.lit(k)).alias(name) for k, name in enumerate(("page", "x", "y", "w", "h"), 1)])
    each = rows.select(*keep, F.inline(found))
    number = {c: F.col(c).cast("double") for c in ("x", "y", "w", "h")}
    box = F.struct(number["x"].alias("x0"), (number["y"] - number["h"]).alias("y0"), (number["x"] + number["w"]).alias("x1"), number["y"].alias("y1"))
    return each.select(*keep, F.col("page").cast("int").alias("page"), box.alias("box"))


def sqlite_rows(spark: SparkSession, path: str, table: str, schema: str, parts: int = 1) -> DataFrame:
    """A table of an SQLite file that every executor can open, read in ranges of its row number.

    The file is opened read-only in each task, so nothing of it passes through the driver but the largest row number.
    """
    import sqlite3

    from pyspark.sql import types as T

    names = T.StructType.fromDDL(schema).names
    if not all(n.replace("_", "").isalnum() for n in [table, *names]):
        raise ValueError("plain names only")
    uri, columns = f"file:{path}?mode=ro", ", ".join(f'"{n}"' for n in names)
    with sqlite3.connect(uri, uri=True) as connection:
        low, high = connection.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()
    width = max(1, -(-(high - low + 1) // parts))
    ranges = spark.range(0, max(0, -(-(high - low + 1) // width)), numPartitions=parts).select((F.col("id") * width + low).alias("first"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in frame["first"]:
                with sqlite3.connect(uri, uri=True) as connection:
                    rows = connection.execute(f'SELECT {columns} FROM "{table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (int(first), int(first) + width))
                    while some := rows.fetchmany(10_000):
                        yield pd.DataFrame(some, columns=names, dtype=object)

    return ranges.mapInPandas(run, schema)


def artifacts_from_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Artifacts of JSON arrays by their schema, with ``_corrupt`` for what doesn't fit: a row is never lost."""
    read = rows.withColumn("__x", F.from_json(column, f"array<struct<{schema}>>"))
    return read.select(*[c for c in rows.columns if c != column], F.inline_outer("__x"), F.when(F.col("__x").isNull(), F.col(column)).alias("_corrupt"))
