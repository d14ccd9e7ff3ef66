"""Discovery and processing queue: versions, selection, upserts, state and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.ids import base_id, version_of
from papyrion.sources.tables import numbered

# Title words that exclude a paper, and the page limit.
TITLE_WORDS = ["lecture", "course", "notes on", "introduction to"]
MAX_PAGES = 50


def latest_versions(queue: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """``queue`` with base, version and kept: the highest version of each paper stays (smallest id on a tie)."""
    rows = queue.withColumns({"base": base_id(F.col(id_col)), "version": version_of(F.col(id_col))})
    best = F.max_by(F.col(id_col), F.struct("version", F.col(id_col))).over(Window.partitionBy("base"))
    return rows.withColumn("kept", F.col(id_col) == best)


def vip_selection(discovered: DataFrame, citations: DataFrame, processed: DataFrame) -> DataFrame:
    """Best version of each discovered, cited and unprocessed paper by citations, then id.

    discovered (base, arxiv_id, version), citations (base, citation_count), processed (base).
    """
    best = discovered.groupBy("base").agg(F.max_by("arxiv_id", F.struct("version", "arxiv_id")).alias("arxiv_id"))
    return best.join(citations, "base").join(processed.select("base").distinct(), "base", "left_anti").orderBy(F.desc("citation_count"), "arxiv_id")


def stable_union(*parts: DataFrame) -> DataFrame:
    """Distinct ids of the one-column tables, each with the first table that has it."""
    union = None
    for k, part in enumerate(parts):
        named = part.toDF("id").withColumn("ord", F.lit(k))
        union = named if union is None else union.unionByName(named)
    return union.groupBy("id").agg(F.min("ord").alias("ord"))


def consistency(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of union, both differences and intersection of two one-column tables, in one pass."""
    both = left.toDF("id").distinct().withColumn("l", F.lit(1)).join(right.toDF("id").distinct().withColumn("r", F.lit(1)), "id", "full")
    return both.agg(
        F.count("*").alias("n_union"), F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"),
    )


def retries_first(pending: DataFrame, failures: DataFrame, id_col: str = "id") -> DataFrame:
    """Pending rows with those that failed first, in id order within each part."""
    flagged = pending.join(failures.select(id_col).distinct().withColumn("__f", F.lit(True)), id_col, "left")
    return flagged.withColumn("retry", F.coalesce("__f", F.lit(False))).drop("__f").orderBy(F.desc("retry"), id_col)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows of both by key: the new one with the highest order wins, else the old one."""
    kind = new.select(order.alias("o")).schema["o"].dataType  # the order keeps its type: times differ below a second
    rows = old.withColumns({"__new": F.lit(0), "__o": F.lit(None).cast(kind)}).unionByName(new.withColumns({"__new": F.lit(1), "__o": order}))
    values = [c for c in old.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("__new", "__o")).alias("v"))
    return picked.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def ingestion_state(events: DataFrame, key: str, stage: str, order: Column) -> DataFrame:
    """Fold of stage events by key: the last stage, attempts (processing events) and the last time."""
    return events.groupBy(key).agg(
        F.max_by(stage, order).alias("stage"), F.count_if(F.col(stage) == "processing").alias("attempt_count"), F.max("ts").alias("updated_at")
    )


def should_refresh(ts: Column, cutoff: Column) -> Column:
    """Missing and unreadable times are stale."""
    return F.coalesce(F.try_to_timestamp(ts.cast("string")) < cutoff, F.lit(True))


def succeeded(status: Column) -> Column:
    return F.coalesce(F.startswith(status, F.lit("success")), F.lit(False))


def retry_candidate(status: Column, details: Column, codes: list[str]) -> Column:
    """A failure whose reason code is one of ``codes``."""
    return F.coalesce((status == "failure") & F.get_json_object(details, "$.reason_code").isin(codes), F.lit(False))


def ordered_work(retries: DataFrame, selected: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """(id, place): retries first, then the selection, each id once at its first place and without those done; the first ``most``.

    retries and selected (id, ord).
    """
    both = retries.select("id", F.lit(0).alias("part"), "ord").unionByName(selected.select("id", F.lit(1).alias("part"), "ord"))
    first = both.groupBy("id").agg(F.min(F.struct("part", "ord")).alias("at")).join(done.select("id"), "id", "left_anti")
    if most is None:
        return numbered(first.select("id", F.struct("at.part", "at.ord", "id").alias("at")), "at").select("id", F.col("n").alias("place"))
    best = first.orderBy("at", "id").limit(most)  # top-k first: the window sees ``most`` rows
    return best.select("id", F.row_number().over(Window.orderBy("at", "id")).cast("long").alias("place"))


def add_missing(table: DataFrame, new: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows whose key it lacks, number of added rows): the first of equal new keys is added."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in rest])
    added = first.join(table.select(key), key, "left_anti")
    return table.unionByName(added.select(*table.columns)), added.agg(F.count("*").alias("added"))


def merged_details(rows: DataFrame, details: str, schema: str) -> DataFrame:
    """``rows`` with the keys of a JSON column as columns; a key that is there overwrites the column of its name."""
    parsed = rows.withColumn("__d", F.from_json(details, schema))
    names = [f.name for f in parsed.schema["__d"].dataType.fields]
    plain = [c for c in rows.columns if c not in names and c != details]
    return parsed.select(*plain, *[(F.coalesce(F.col(f"__d.{n}"), F.col(n).cast(parsed.schema["__d"].dataType[n].dataType)) if n in rows.columns else F.col(f"__d.{n}")).alias(n) for n in names])


def stale_or_missing(papers: DataFrame, fetched: DataFrame, key: str, cutoff: Column, most: int | None = None) -> DataFrame:
    """Keys to fetch again: never fetched, or fetched before the cutoff; in key order, the first ``most``. fetched (key, ts)."""
    rows = papers.select(key).distinct().join(fetched.select(key, "ts"), key, "left").where(should_refresh(F.col("ts"), cutoff)).select(key)
    return rows if most is None else rows.orderBy(key).limit(most)


def upgrade_counts(old: DataFrame, new: DataFrame, key: str, count: str) -> DataFrame:
    """One row: attempted, success (a count came back), missing, upgraded (0 before, more now)."""
    joined = new.join(old.select(key, F.col(count).alias("__before")), key, "left")
    return joined.agg(
        F.count("*").alias("attempted"), F.count(count).alias("success"), F.count_if(F.col(count).isNull()).alias("missing"),
        F.count_if((F.col("__before") == 0) & (F.col(count) > 0)).alias("upgraded"),
    )


def first_metadata(rows: DataFrame, id_col: str, metadata: str, order: str) -> DataFrame:
    """(base, metadata): the metadata that was seen first for each paper, whatever its version."""
    return rows.where(F.col(metadata).isNotNull()).groupBy(base_id(F.col(id_col)).alias("base")).agg(F.min_by(metadata, order).alias("metadata"))


def paper_titles(wanted: DataFrame, papers: DataFrame, discovered: DataFrame) -> DataFrame:
    """(id, title): by base id, from the papers, else from the discovered ones; the smallest full id has the word.

    wanted (id), papers and discovered (id, title), with or without versions.
    """
    def by_base(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(F.coalesce(F.trim("title"), F.lit("")) != "").groupBy(base_id(F.col("id")).alias("base")).agg(F.min_by("title", "id").alias(name))

    rows = wanted.select("id", base_id(F.col("id")).alias("base")).join(by_base(papers, "a"), "base", "left").join(by_base(discovered, "b"), "base", "left")
    return rows.select("id", F.coalesce("a", "b").alias("title"))


def batch_filter(papers: DataFrame, title: Column, comment: Column, skipped: DataFrame, processed: DataFrame, key: str, force: bool = False) -> DataFrame:
    """``papers`` with reason: skipped, title, pages, processed, or null to go on."""
    marked = papers.join(skipped.select(key).distinct().withColumn("__s", F.lit(True)), key, "left").join(processed.select(key).distinct().withColumn("__p", F.lit(True)), key, "left")
    low = F.lower(F.coalesce(title, F.lit("")))
    by_title = F.exists(F.array(*map(F.lit, TITLE_WORDS)), lambda w: F.contains(low, w))
    pages = F.regexp_extract(F.coalesce(comment, F.lit("")), r"(?i)(\d+)\s*pages?", 1).try_cast("int")
    reason = F.when(F.col("__s"), "skipped").when(by_title, "title").when(pages > MAX_PAGES, "pages")
    if not force:
        reason = reason.when(F.col("__p"), "processed")
    return marked.withColumn("reason", reason).drop("__s", "__p")
