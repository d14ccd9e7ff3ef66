"""Compare the rows of each bucket without ever gathering a large bucket in one task.

A bucket with more than ``block`` rows is cut into blocks by a hash of the row, and each pair
of blocks becomes a unit of its own, so a hot bucket is spread over many tasks and still
every pair of its rows meets in exactly one unit.  Units are dealt by hash, sorted inside
their partition and read as a stream, so thousands of small buckets share one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.workspace import Table


def units(rows: DataFrame, keys: list[str], spread: str, block: int) -> DataFrame:
    """``rows`` dealt out as units (keys, __i, __j), with __side 0 or 1 (0 only where __i = __j).

    ``spread`` is an expression that deals the rows of a large bucket to its blocks.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    hot = Table(sizes, "hot").df
    m = F.greatest(F.ceil(F.col("__n") / block).cast("int"), F.lit(1))
    placed = rows.join(hot, keys, "left").withColumn("__m", F.coalesce(m, F.lit(1)))
    placed = placed.withColumn("__c", F.pmod(F.xxhash64(F.expr(spread), F.lit(7)), F.col("__m")).cast("int"))
    dealt = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    dealt = dealt.select(*rows.columns, F.least("__c", "__o").alias("__i"), F.greatest("__c", "__o").alias("__j"), (F.col("__c") > F.col("__o")).cast("int").alias("__side"))
    order = [*keys, "__i", "__j"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "__side")


def each_unit(keys: list[str], work: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], least: int = 1 << 14) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: ``work`` gets whole units, as a table with [low, high) partners for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= least:
                table = pa.Table.from_batches(held).combine_chunks()
                ends = _bounds(table, keys)
                cut = int(ends[-2]) if len(ends) > 2 else 0  # the last unit may go on
                if cut:
                    yield from _units(table.slice(0, cut), keys, work)
                rest = table.slice(cut)
                held, rows = rest.to_batches(), (rest.num_rows if cut else 0)
        if held:
            yield from _units(pa.Table.from_batches(held).combine_chunks(), keys, work)

    return run


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the units, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in [*keys, "__i", "__j"]:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _units(table: pa.Table, keys: list[str], work: Callable) -> Iterator[pa.RecordBatch]:
    starts = _bounds(table, keys)
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    begin = np.repeat(starts[:-1], sizes)
    here = np.arange(table.num_rows)
    cross = table.column("__i").to_numpy() != table.column("__j").to_numpy()
    side = table.column("__side").to_numpy()
    ones = np.concatenate([[0], np.cumsum(side)])
    middle = end - (ones[end] - ones[begin])  # side 1 comes last
    low = np.where(cross, np.where(side == 0, middle, end), np.minimum(here + 1, end))
    busy = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if len(busy) < table.num_rows:  # without units of one row
        map_to = np.full(table.num_rows + 1, 0)
        keep = np.zeros(table.num_rows, bool)
        keep[busy] = True
        map_to = np.concatenate([[0], np.cumsum(keep)])
        table, low, end = table.take(pa.array(busy)), map_to[low[busy]], map_to[end[busy]]
    if table.num_rows:
        yield from work(table, low, end)
