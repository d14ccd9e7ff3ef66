"""Token ids of a corpus as binary shards with Elias-Fano document boundaries.

The ranges of shards are found by a pass over the documents' ids and text hashes alone (equal
ids are in order of the hash; null ids first).  Then each text is encoded where it lies, and
only its ids, 2 or 4 bytes each, go to the shard whose range it falls into, once and in
ascending order from shard to shard.  A shard file is

    ids of its documents, concatenated, 2 or 4 bytes each
    Elias-Fano code of the documents' ends in that array
    Elias-Fano code of the ids, as differences from the first one
    footer: lengths, first id, number of null ids, width, magic

and its offsets come from the select structure, block by block: a reader fetches the footer, the
headers and the slices of its block, never a whole code.  A task writes a file of its
own name and returns a manifest row; only files in the written manifest count, so a task that
ran twice or was lost leaves nothing that is read.  Files go through ``pyarrow.fs``.

Null and empty texts have only the end id.  An empty table has no shard and no rows.  Repeated
rows are written as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.llm import elias_fano
from papyrion.llm.rows import quoted
from papyrion.llm.vocabulary import small_groups, word_encoder
from papyrion.workspace import Table, materialize, shared_folder

FOOTER = "<QQQqQI8s"
MAGIC = b"EFTOKEN1"
MANIFEST = "shard int, path string, n_docs long, n_ids long, width int"


def _locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


#: Stands for a null id, before all others.
FIRST = -(2**63)


def _encoder(tokenizer_path: str, end_id: int, lows: list[tuple[int, int, int]]):
    ids = np.array([x[0] for x in lows], np.int64)

    def shard_of(batch: pa.RecordBatch) -> np.ndarray:
        """The last range whose low end (id, hash, salt) isn't above the row."""
        rows = batch.column(0).fill_null(FIRST).to_numpy()
        found = np.searchsorted(ids, rows, "right") - 1
        for k in np.flatnonzero(np.searchsorted(ids, rows, "left") <= found):  # a range begins inside this id's rows
            found[k] = bisect_right(lows, (int(rows[k]), batch.column(1)[k].as_py(), batch.column(2)[k].as_py())) - 1
        return np.maximum(found, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            shards = shard_of(batch)
            at = 0
            for group in small_groups(batch.column(3).to_pylist()):
                rows = batch.slice(at, len(group))
                codes = pa.array([code + end for code in encoder.encode(group)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shards[at : at + len(group)], pa.int32()), rows.column(0), rows.column(1), codes], names=["shard", "id", "h", "code"])
                at += len(group)

    return run


def _ranges(named: DataFrame, shard_bytes: int) -> list[tuple[int, int, int]]:
    """Low ends (id, hash, salt) of ranges of about ``shard_bytes`` of text, from a table without texts."""
    marks = Table(named.select(F.coalesce("id", F.lit(FIRST)).alias("id"), "h", "salt", F.coalesce(F.octet_length("t"), F.lit(0)).alias("size")), "marks")
    held = marks.df.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(1, min(held[0] // shard_bytes + 1, held[1]))
    dealt = marks.df.repartitionByRange(parts, "id", "h", "salt").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "h", "salt")).alias("low"))
    lows = sorted(tuple(r.low) for r in dealt.collect())  # a row per shard
    marks.drop()
    return lows


class _Output:
    """A shard file that is being written."""

    def __init__(self, folder: str, shard: int, width: int):
        self.shard, self.width = shard, width
        self.path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        where, name = _locate(self.path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.ids, self.lengths = where.open_output_stream(name), [], []

    def add(self, ids: pa.Array, codes: pa.Array) -> None:
        self.ids.append(ids)
        for code in codes:
            self.out.write(code.as_buffer())
            self.lengths.append(len(code.as_buffer()) // self.width)

    def close(self) -> pa.RecordBatch:
        """Boundaries, ids and footer; the manifest's row."""
        known = pa.chunked_array(self.ids)
        ends = np.cumsum(np.array(self.lengths, np.int64))
        numbers = known.drop_null().to_numpy()
        first = int(numbers[0]) if len(numbers) else 0
        codes = elias_fano.encode(ends), elias_fano.encode(numbers - first)
        for code in codes:
            self.out.write(code)
        self.out.write(struct.pack(FOOTER, int(ends[-1]) * self.width, len(codes[0]), len(codes[1]), first, known.null_count, self.width, MAGIC))
        self.out.close()
        return pa.RecordBatch.from_pydict({"shard": pa.array([self.shard], pa.int32()), "path": [self.path], "n_docs": [len(ends)], "n_ids": [int(ends[-1])], "width": pa.array([self.width], pa.int32())})


def _writer(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held is None or held.shard != shards[a]:
                    if held is not None:
                        yield held.close()
                    held = _Output(folder, int(shards[a]), width)
                held.add(batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a))
        if held is not None:
            yield held.close()

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 24) -> DataFrame:
    """Write the shards and return the written manifest (shard, path, n_docs, n_ids, width, base: ids in earlier shards)."""
    text = F.col(quoted(text_col)).cast("string")
    salt = F.xxhash64(F.monotonically_increasing_id())  # rows alike in all else are dealt out too
    named = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), salt.alias("salt"), text.alias("t"))
    lows = _ranges(named, shard_bytes)
    coded = named.mapInArrow(_encoder(tokenizer_path, end_id, lows), "shard int, id long, h long, code binary")
    dealt = coded.repartitionById(max(1, len(lows)), "shard").sortWithinPartitions("shard", "id", "h")
    width = np.dtype(word_encoder(tokenizer_path).kind).itemsize
    manifest = materialize(dealt.select("shard", "id", "code").mapInArrow(_writer(folder, width), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """An open shard file."""

    def __init__(self, path: str):
        where, name = _locate(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        payload, a, b, self.first, self.nulls, self.width, magic = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        self.ends = elias_fano.Reader(lambda at, n: self.file.read_at(n, payload + at))
        self.ids = elias_fano.Reader(lambda at, n: self.file.read_at(n, payload + a + at))

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Offsets of documents first..last-1 and the end of the last one."""
        start = self.ends[first - 1] if first else 0
        return np.concatenate([[start], self.ends.block(first, last)])

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = max(0, min(last, self.nulls) - first)
        return [None] * nulls + (self.ids.block(max(0, first - self.nulls), max(0, last - self.nulls)) + self.first).tolist()

    def tokens(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with Shard(path) as shard:
                at = shard.bounds(first, last)
                ids = shard.doc_ids(first, last)
                sums = [zlib.crc32(shard.tokens(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_shards(manifest: DataFrame, block: int = 2048, task_bytes: int = 1 << 24) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files in blocks of documents.

    The blocks are dealt to a task for about each ``task_bytes`` of the shards (AQE would see
    only the few bytes of the manifest's rows and merge them into one task).
    """
    held = manifest.agg(F.coalesce(F.sum(F.col("n_ids") * F.col("width")), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("n_docs") / block)), F.lit(0))).first()
    tasks = max(1, min(int(held[1]), -(-int(held[0]) // task_bytes)))
    starts = F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(block)))
    blocks = manifest.select("path", "base", "n_docs", starts.alias("first"))
    blocks = blocks.select("path", "base", "first", F.least(F.col("first") + block, "n_docs").alias("last"))
    return blocks.repartition(tasks, "path", "first").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus under the shared folder, then read it back."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, folder, tokenizer_path, end_id, id_col, text_col))
