"""A paper store with commits: staged files become visible by one atomic record, for all tables at once.

A write stages its papers and their whole rows of each table as Parquet under a name of its own;
nothing reads them.  A commit is one small numbered file that names the stage.  It is written
aside and renamed to its number, which fails if the number is taken (then the next one is tried),
so of two writers both commit, one after the other.  A reader lists the records once and sees,
for each paper and table, the rows of the newest commit that covers them; tasks or drivers that die
between staging and commit leave the old rows.  ``compact`` writes the present rows as one
commit that readers start from, ``vacuum`` removes stages that no record names.

Rows of a null paper aren't written.  The driver holds the commits since the last compaction
(a line each), never papers or rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.operators.store import commit as decided
from papyrion.operators.store import put_artifacts, put_edges
from papyrion.workspace import materialize

#: Tables of a store: what one paper's extraction leaves.
TABLES = {
    "artifacts": "paper string, id string, kind string, content string",
    "edges": "paper string, edge_kind string, source string, target string",
    "definitions": "paper string, term string, text string",
    "aliases": "paper string, term string, alias string",
    "dependencies": "paper string, term string, depends_on string",
    "terms": "paper string, artifact string, term string",
    "requirements": "paper string, artifact string, term string",
    "states": "paper string, mode string, stage string, attempts int, error string",
}
BANK = ("definitions", "aliases", "dependencies", "terms", "requirements")


class Snapshots:
    """The store under ``root``, with ``tables`` by name as DDL; each has a column ``paper``."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] | None = None):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables or TABLES
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self._conf)

    # Writing

    def stage(self, papers: DataFrame, tables: dict[str, DataFrame]) -> dict:
        """Write the rows that ``tables`` will have for ``papers`` (paper); returns what ``commit`` takes."""
        name = uuid.uuid4().hex
        papers.select(F.col("paper").cast("string")).where("paper is not null").distinct().write.parquet(f"{self.root}/papers/staged_in={name}")
        for table, rows in tables.items():
            kind = T.StructType.fromDDL(self.tables[table])
            rows.select(*[F.col(f.name).cast(f.dataType) for f in kind.fields]).where("paper is not null").write.parquet(f"{self.root}/{table}/staged_in={name}")
        return {"stage": name, "tables": sorted(tables), "full": False}

    def commit(self, staged: dict) -> int:
        """Make a stage visible; returns the commit's number."""
        files, text = self._files(), json.dumps(staged, sort_keys=True)
        aside = self._path(f"commits/.{uuid.uuid4().hex}")
        out = files.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        number = max((n for n, _ in self.commits()), default=-1) + 1
        while True:
            try:
                context.rename(aside, self._path(f"commits/{number:012d}.json"), none)
                return number
            except Exception as error:  # noqa: BLE001 - Java's class is only in the text
                if "FileAlreadyExists" not in str(error):
                    raise
                number += 1

    def write(self, papers: DataFrame, tables: dict[str, DataFrame]) -> int:
        return self.commit(self.stage(papers, tables))

    # Reading

    def commits(self, at: int | None = None) -> list[tuple[int, dict]]:
        """(number, record) of the commits that readers need, up to ``at``, in order: from the last full one on."""
        pattern = f"{self.root}/commits/*.json"
        if not self._files().exists(self._path("commits")):
            return []
        found = self.spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json", 1).cast("long").alias("n"), "value") if self._files().globStatus(self._jvm.org.apache.hadoop.fs.Path(pattern)) else None
        records = sorted((r.n, json.loads(r.value)) for r in found.collect() if at is None or r.n <= at) if found is not None else []
        full = max((n for n, r in records if r["full"]), default=0)
        return [(n, r) for n, r in records if n >= full]

    def _of(self, name: str, stages: list[tuple[int, str]], kind: T.StructType) -> DataFrame:
        """Rows of a folder's stages with the number of their commits (committed_as)."""
        kind = T.StructType([*kind.fields, T.StructField("staged_in", T.StringType())])
        rows = self.spark.read.schema(kind).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/staged_in={s}" for _, s in stages])
        numbers = self.spark.createDataFrame([(s, n) for n, s in stages], "staged_in string, committed_as long")
        return rows.join(F.broadcast(numbers), "staged_in").drop("staged_in")  # a row for each commit since the last compaction

    def read(self, table: str, at: int | None = None) -> DataFrame:
        """The rows of a table as of the newest commit (or commit ``at``)."""
        kind = T.StructType.fromDDL(self.tables[table])
        stages = [(n, r["stage"]) for n, r in self.commits(at) if table in r["tables"]]
        if not stages:
            return self.spark.createDataFrame([], kind)
        rows = self._of(table, stages, kind)
        if len(stages) > 1:
            owners = self._of("papers", stages, T.StructType.fromDDL("paper string")).groupBy("paper").agg(F.max("committed_as").alias("committed_as"))
            rows = rows.join(owners, ["paper", "committed_as"], "left_semi")
        return rows.select(*kind.names)

    def compact(self) -> int:
        """Commit all present rows as one stage that readers start from."""
        at = max((n for n, _ in self.commits()), default=-1)
        papers = None
        for table in self.tables:
            own = self.read(table, at).select("paper").distinct()
            papers = own if papers is None else papers.unionByName(own)
        staged = self.stage(papers, {t: self.read(t, at) for t in self.tables})
        if max((n for n, _ in self.commits()), default=-1) != at:
            raise RuntimeError("another commit came while the store was being compacted; its stage stays unread")
        return self.commit(staged | {"full": True})

    def vacuum(self) -> int:
        """Remove stages that no needed record names (also those still being written: run it alone); returns how many."""
        known = {r["stage"] for _, r in self.commits()}
        gone = set()
        for name in ("papers", *self.tables):
            for status in self._files().globStatus(self._path(f"{name}/staged_in=*")) or []:
                stage = status.getPath().getName().removeprefix("staged_in=")
                if stage not in known:
                    self._files().delete(status.getPath(), True)
                    gone.add(stage)
        return len(gone)


def persist_results(store: Snapshots, results: DataFrame, new: dict[str, DataFrame], mode: str, order: str = "ord") -> tuple[int | None, int | None]:
    """Persist the extraction results of a batch of papers; returns the numbers of the two commits (of successes and failures).

    results (paper, error, n_definitions, n_terms), a row for each paper; ``new`` has the tables' new rows,
    artifacts and edges with a column ``order`` (of equal keys the last row wins).  Papers with an
    error, without statements, or in a mode with definitions (defs, full) without a bank (n_definitions
    null) or a term map (n_terms null) leave only a failed state, in a commit after that of the
    others.  Artifacts and edges are merged into a paper's old ones, definition tables replace them.
    If the batch's own write breaks off, all its papers are recorded as failed and the error goes on.
    """
    old_states = store.read("states").select("paper", F.col("attempts").alias("before"))
    asked = results.withColumn("paper", F.col("paper").cast("string")).where("paper is not null")
    n_nodes = new["artifacts"].groupBy(F.col("paper").cast("string").alias("paper")).agg(F.count("*").alias("n_nodes"))
    verdicts = decided(asked.join(n_nodes, "paper", "left"), mode).join(old_states, "paper", "left")
    states = verdicts.select("paper", F.lit(mode).alias("mode"), "stage", (F.coalesce("before", F.lit(0)) + 1).alias("attempts"), F.col("reason").alias("error"))
    states = materialize(states, "verdicts")  # every table of the write, and its papers, read them

    def part(rows: DataFrame, papers: DataFrame) -> DataFrame:
        return rows.withColumn("paper", F.col("paper").cast("string")).join(papers, "paper", "left_semi")

    good, bad = (states.where(F.col("stage") == s) for s in ("complete", "failed"))
    papers = good.select("paper")
    try:
        tables = {"states": good}
        for name, put in (("artifacts", put_artifacts), ("edges", put_edges)):
            rows = part(new[name], papers)
            tables[name] = put(part(store.read(name), papers), rows.select(*T.StructType.fromDDL(store.tables[name]).names, order), order)
        if mode in ("defs", "full"):
            tables |= {name: part(new[name], papers).distinct() if name in new else store.read(name).limit(0) for name in BANK}
        first = store.write(papers, tables)
    except Exception as error:
        message = str(error)[:2000]
        store.write(states.select("paper"), {"states": states.withColumns({"stage": F.lit("failed"), "error": F.lit(message)})})
        raise
    return first, store.write(bad.select("paper"), {"states": bad})
