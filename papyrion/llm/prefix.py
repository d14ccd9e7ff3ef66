"""Running sums over an order that no single task could hold.

Rows are cut into ranges of the order; the totals of the ranges are summed first (few rows),
and then each range sums its own rows from there.  A range is one task's work, so callers bound
it: the length histogram has at most 1,024 different lengths in a range, and the blocks of a
source fall into 1,024 ranges of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, within: list[str], order: str, range_of: Column, values: list[str]) -> DataFrame:
    """``rows`` with ``<value>_to``: the sum of the value up to and including this row's ``order``.

    ``range_of`` must not decrease as ``order`` does.  The ranges of a key in ``within`` meet in
    one task, so it must take few values.  Rows that tie in ``order`` get the same sum.
    """
    cut = rows.withColumn("__r", range_of)
    totals = cut.groupBy(*within, "__r").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    before = Window.partitionBy(*within).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*within, "__r", *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    here = Window.partitionBy(*within, "__r").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    summed = cut.select("*", *[F.sum(v).over(here).alias(f"{v}_to") for v in values])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*within, "__r"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return summed.alias("a").join(totals.alias("b"), on).select(
        *[F.col(f"a.{c}") for c in rows.columns], *[(F.col(f"a.{v}_to") + F.col(f"b.__{v}")).alias(f"{v}_to") for v in values]
    )
