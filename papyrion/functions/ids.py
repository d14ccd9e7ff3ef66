"""Column functions over identifiers, addresses and date cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier forms.
PAPER_ID = r"(?i)(\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z-]+)?/\d{7})(?:v\d+)?"
ID_IN_TEXT = r"(?i)(?:arxiv\s*[:\s]*|arxiv:|\babs/)([\d.]{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+\.[a-z\-]+/\d{7}(?:v\d+)?)"


def _found(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def parse_id(text: Column) -> Column:
    """The first paper id in a text or address, without its version; null if none."""
    return _found(F.regexp_extract(text, PAPER_ID, 1))


def base_id(paper_id: Column) -> Column:
    return F.regexp_replace(paper_id, r"(?i)v\d+$", "")


def version_of(paper_id: Column) -> Column:
    """The version as a number; a missing one is 0."""
    return F.coalesce(F.regexp_extract(paper_id, r"(?i)v(\d+)$", 1).try_cast("int"), F.lit(0))


def id_in_reference(text: Column) -> Column:
    return _found(F.regexp_extract(text, ID_IN_TEXT, 1))


def is_valid_id(paper_id: Column) -> Column:
    return F.lower(F.trim(paper_id)).rlike(r"^(\d{4}\.\d{4,5}(v\d+)?|[a-z-]+(\.[a-z-]+)?/\d{7}(v\d+)?)$")


def id_from_entry(url: Column) -> Column:
    """The id of a feed entry's address: after /abs/, else the last path segment."""
    return F.coalesce(_found(F.regexp_extract(url, r"/abs/(.+)$", 1)), F.element_at(F.split(url, "/"), -1))


def work_id(url: Column) -> Column:
    """Canonical address of a work id such as W123, whatever form it comes in."""
    last = F.upper(F.element_at(F.split(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/"), -1))
    return F.when(last.rlike(r"^W\d+$"), F.concat(F.lit("https://openalex.org/"), last))


def file_of(paper_id: Column) -> Column:
    return F.concat(F.lit("data/arxiv_"), F.translate(paper_id, "/", "_"), F.lit(".json"))


def id_of_file(path: Column) -> Column:
    return _found(F.regexp_extract(path, r"arxiv_(.+)\.json$", 1))


def query_key(query: Column) -> Column:
    return F.url_encode(F.lower(F.trim(query)))


def cursor_clause(before: Column) -> Column:
    """Date clause of papers submitted up to a time."""
    return F.concat(F.lit("submittedDate:[199101010000 TO "), F.date_format(before, "yyyyMMddHHmmss"), F.lit("]"))


def month_clause(month: Column) -> Column:
    first = F.trunc(month, "MM")
    return F.concat(F.lit("submittedDate:["), F.date_format(first, "yyyyMMdd"), F.lit("0000 TO "), F.date_format(F.last_day(first), "yyyyMMdd"), F.lit("2359]"))


def is_url_reference(text: Column) -> Column:
    """A web page or data set rather than a paper: an address that isn't a DOI and no TeX link."""
    return text.rlike(r"(?i)https?://\S+") & ~text.rlike(r"(?i)https?://(?:dx\.)?doi\.org/") & ~text.contains("\\href{")
