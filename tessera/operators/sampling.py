"""Splits, folds, resamples and samples, from md5 keys of row ids.

The same seed gives the same rows in any partitioning, and sizes are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import index, md5_key
from tessera.operators import resampling
from tessera.plans.ordered import row_numbers
from tessera.plans.selection import quantiles


def _numbered(df: DataFrame, id_col: str, seed: int | None, shuffle: bool, stream: str) -> tuple[DataFrame, int]:
    n = df.count()
    key = md5_key(seed, stream, F.col(id_col))
    order = [F.col("__key"), F.col(id_col)] if shuffle else [F.col(id_col)]
    return row_numbers(df.withColumn("__key", key), order, "__rn").drop("__key"), n


def train_test_split(df: DataFrame, id_col: str, *, test_size: float = 0.2, seed: int | None = None, shuffle: bool = True) -> DataFrame:
    """``df`` with ``split`` (train or test); ``max(1, ceil(n test_size))`` rows are test, taken first in shuffled (or id) order."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie in (0, 1)")
    numbered, n = _numbered(df, id_col, seed, shuffle, "split")
    if n < 2:
        raise ValueError("at least 2 rows are needed")
    return numbered.withColumn("split", F.when(F.col("__rn") <= max(1, ceil(n * test_size)), "test").otherwise("train")).drop("__rn")


def train_val_test_split(df: DataFrame, id_col: str, *, val_size: float = 0.1, test_size: float = 0.1, seed: int | None = None) -> DataFrame:
    """As above with ``val``: test rows come first, then validation rows, the rest trains."""
    if min(val_size, test_size) <= 0 or val_size + test_size >= 1:
        raise ValueError("sizes must be positive and leave rows to train on")
    numbered, n = _numbered(df, id_col, seed, True, "split")
    if n < 3:
        raise ValueError("at least 3 rows are needed")
    test = max(1, ceil(n * test_size))
    val = max(1, ceil(n * val_size))
    return numbered.withColumn("split", F.when(F.col("__rn") <= test, "test").when(F.col("__rn") <= test + val, "val").otherwise("train")).drop("__rn")


def kfold(df: DataFrame, id_col: str, k: int = 5, *, seed: int | None = None, shuffle: bool = True) -> DataFrame:
    """``df`` with ``fold`` from 0; the first ``n % k`` folds have one row more."""
    numbered, n = _numbered(df, id_col, seed, shuffle, "fold")
    if not 2 <= k <= n:
        raise ValueError("k must lie between 2 and the number of rows")
    small, extra = divmod(n, k)
    at = F.col("__rn") - 1
    big = extra * (small + 1)
    fold = F.when(at < big, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - big) / small))
    return numbered.withColumn("fold", fold.cast("int")).drop("__rn")


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, *, seed: int | None = None) -> DataFrame:
    """``df`` with ``fold``: each label's rows are dealt in turn, starting at fold 0.

    Positions within a label come from counts per (label, slice), so a label that holds most rows is not one task's work.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    keyed = df.withColumn("__key", md5_key(seed, "fold", F.col(id_col))).withColumn("__slice", F.conv(F.substring("__key", 1, 2), 16, 10).cast("int"))
    sizes = keyed.groupBy(label, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select(label, "__slice", F.coalesce(F.sum("__n").over(Window.partitionBy(label).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(label, "__slice").orderBy("__key", id_col)) - 1
    return keyed.withColumn("__own", own).join(sizes, [label, "__slice"]).withColumn("fold", F.pmod(F.col("__own") + F.col("__before"), F.lit(k)).cast("int")).select(*df.columns, "fold")


def bootstrap(df: DataFrame, value: str, id_col: str, statistic: str | Callable[[list], float] = "mean", *, n_resamples: int = 10_000, confidence: float = 0.95, seed: int | None = None, method: str | None = None) -> DataFrame:
    """``statistic, mean, std, ci_lower, ci_upper, n_resamples``: percentile interval over resamples with replacement.

    ``statistic`` is mean, sum, min, max or median; by ``counts``, tasks work out what each run draws of their rows and shuffle one
    row for each run (``resampling``). ``draws`` joins every single draw, by an md5 key that any engine can repeat, with its row.
    Unless told, more than ``resampling.MOST_DRAWN`` draws go by counts; both have the same distribution. Any other function of a list is computed in Python, from the drawn rows of each resample.
    """
    if n_resamples < 2 or not 0 < confidence < 1:
        raise ValueError("n_resamples must be at least 2 and confidence lie in (0, 1)")
    rows = df.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("x"))
    n = rows.count()
    if not n:
        raise ValueError("no values")
    spark = df.sparkSession
    native = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    method = method or ("draws" if n * n_resamples <= resampling.MOST_DRAWN else "counts")
    if method not in ("counts", "draws") or not (callable(statistic) or statistic in (*native, "median")):
        raise ValueError(f"unknown statistic {statistic!r} or method {method!r}")

    def seen_of(rows: DataFrame) -> DataFrame:
        if statistic == "median":
            return quantiles(rows.select("x"), [0.5]).select(F.col("q")[0].alias("s"))
        return rows.agg(native[statistic]("x").alias("s"))

    if method == "counts" and not callable(statistic):
        at, n = resampling.placed(rows)
        seen, runs = seen_of(rows), resampling.resampled(at, n, statistic, runs=n_resamples, seed=seed or 0)
    else:
        seen, runs = _drawn(rows, n, statistic, n_resamples, seed, native, seen_of)
    tail = (1 - confidence) / 2
    low, high = int(np.floor(n_resamples * tail)), min(int(np.ceil(n_resamples * (1 - tail))), n_resamples - 1)
    # order statistics as exact percentiles at whole positions
    at = F.percentile("s", F.array(F.lit(low / (n_resamples - 1)), F.lit(high / (n_resamples - 1))))
    one = runs.agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"), at.alias("q"))
    return seen.select(F.col("s").alias("statistic")).crossJoin(one).select("statistic", "mean", "std", F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"), F.lit(n_resamples).cast("long").alias("n_resamples"))


def _drawn(rows: DataFrame, n: int, statistic: str | Callable[[list], float], n_resamples: int, seed: int | None, native: dict[str, Callable], seen_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The statistic of all rows and of each resample, from single draws."""
    spark = rows.sparkSession
    placed = row_numbers(rows, [F.col("id")], "at").select((F.col("at") - 1).alias("at"), "x")
    draws = spark.range(n_resamples * n).select(F.floor(F.col("id") / n).alias("run"), F.pmod(F.col("id"), F.lit(n)).alias("draw")).withColumn("at", index(F.lit(n), seed, "bootstrap", F.col("run"), F.col("draw")))
    drawn = draws.join(placed, "at").select("run", "x")
    if callable(statistic):
        fn = lambda p: pd.DataFrame({"s": [float(statistic(p["x"].tolist()))]})
        return rows.groupBy().applyInPandas(fn, "s double"), drawn.groupBy("run").applyInPandas(fn, "s double")
    if statistic == "median":
        return seen_of(rows), quantiles(drawn, [0.5], ["run"]).select("run", F.col("q")[0].alias("s"))
    return seen_of(rows), drawn.groupBy("run").agg(native[statistic]("x").alias("s"))


def reservoir_sample(df: DataFrame, id_col: str, n: int, *, seed: int | None = None) -> DataFrame:
    """A uniform sample of exactly ``n`` rows: those with the least keys, kept per task before they are merged."""
    if n < 1:
        raise ValueError("n must be positive")
    return df.withColumn("__key", md5_key(seed, "reservoir", F.col(id_col))).orderBy("__key", id_col).limit(n).drop("__key")
