"""Order-dependent work over whole tables without a single-task window.

A window without partition keys sends every row to one task. Here rows are range-partitioned by the order, each
range is scanned on its own, and the totals of the ranges before it (one small row for each range) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], by: Sequence[str] = (), *, before: bool = False, most: bool = False) -> DataFrame:
    """``df`` with running sums in ``order`` (which must be total), within groups ``by`` or over the whole table.

    ``before`` leaves the row itself out. ``most`` takes running maxima instead (null where there is nothing before).
    """
    fold = F.max if most else lambda v: F.coalesce(F.sum(v), F.lit(0))
    over = (lambda v, w: F.max(v).over(w)) if most else lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0))
    join = F.greatest if most else lambda a, b: a + b
    upto = -1 if before else Window.currentRow
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumns({k: over(v, w) for k, v in sums.items()})
    scratch = Scratch(df.sparkSession, "running")
    terms = {f"__t_{k}": v for k, v in sums.items()}
    ranged = scratch.table(df.withColumns(terms).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__range").agg(*(fold(F.col(f"__t_{k}")).alias(f"__s_{k}") for k in sums))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("__range", *(over(F.col(f"__s_{k}"), earlier).alias(f"__o_{k}") for k in sums))
    local = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    out = ranged.withColumns({k: over(F.col(f"__t_{k}"), local) for k in sums}).join(F.broadcast(offsets), "__range")
    return out.select(*[c for c in df.columns if c not in sums], *(join(F.col(k), F.col(f"__o_{k}")).alias(k) for k in sums))


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rn", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with its position in a total order, from 1."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return running(df, order, {name: F.lit(1).cast("long")})
