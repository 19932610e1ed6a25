"""Descriptive statistics. Null values are left out; groups are the distinct values of ``by`` (all rows if empty).

Quantiles interpolate linearly at ``p (n - 1)``; they are selected without gathering a large group (``plans/selection.py``). Variances divide by n - 1 and are 0 for one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import ratio
from tessera.plans.ordered import row_numbers
from tessera.plans.scratch import Scratch
from tessera.plans.selection import attach_groups, quantiles


def _keyed(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))


def attach(df: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the columns of a per-group summary: one row without groups, else a join on the keys, null ones included."""
    return attach_groups(df, summary, by)


def _not_empty(df: DataFrame, n: Column) -> Column:
    return F.when(n > 0, n).otherwise(F.raise_error(F.lit("no values")).cast("long"))


def describe(df: DataFrame, value: str, by: Sequence[str] = (), *, method: str = "default") -> DataFrame:
    """Thirteen figures per group; an empty table without groups raises.

    Skewness and kurtosis divide population moments by the *sample* deviation before the usual small-sample factors, unless
    ``method="textbook"``; they need 3 and 4 values.
    """
    x = _keyed(df, value, by)
    one = x.groupBy(*by).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"), F.min("x").alias("minimum"), F.max("x").alias("maximum"),
        F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
    )
    if not by:
        one = one.withColumn("n", _not_empty(one, F.col("n")))
    q = Scratch(df.sparkSession, "describe").table(quantiles(x, [0.25, 0.5, 0.75], by), "quantiles")
    deviation = quantiles(attach(x, q, by).select(*by, F.abs(F.col("x") - F.col("q")[1]).alias("x")), [0.5], by, name="mad")
    n = F.col("n").cast("double")
    shrink = F.lit(1.0) if method == "textbook" else (n - 1) / n
    skew = F.col("g1") * F.pow(shrink, F.lit(1.5)) * ratio(F.sqrt(n * (n - 1)), n - 2)
    raw = (F.col("g2") + 3) * shrink * shrink
    kurt = ratio((n + 1) * (n - 1) * raw, (n - 2) * (n - 3)) - ratio(3 * (n - 1) * (n - 1), (n - 2) * (n - 3))
    flat = F.col("variance") == 0
    out = attach(attach(one, q, by), deviation.withColumn("mad", F.col("mad")[0]), by) if by else one.join(F.broadcast(q), how="left").join(F.broadcast(deviation.withColumn("mad", F.col("mad")[0])), how="left")
    return out.select(
        *by, "n", "mean", "variance", F.sqrt("variance").alias("std"), "minimum", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "maximum",
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.when(flat | (F.col("n") < 3), 0.0).otherwise(skew).alias("skewness"), F.when(flat | (F.col("n") < 4), 0.0).otherwise(kurt).alias("kurtosis"), "mad",
    )


def descriptive_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, mean, std, min, max, q25, median, q75``; NaN and infinities raise."""
    x = F.col("x")
    sound = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("values must be finite")).cast("double")).otherwise(x)
    rows = _keyed(df, value, by).withColumn("x", sound)
    one = rows.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    if not by:
        one = one.withColumn("n", _not_empty(one, F.col("n")))
    q = quantiles(rows, [0.25, 0.5, 0.75], by)
    return (attach(one, q, by) if by else one.join(F.broadcast(q), how="left")).select(*by, "n", "mean", "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def quantile(df: DataFrame, value: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    found = quantiles(_keyed(df, value, by), [p], by, name="quantile").withColumn("quantile", F.col("quantile")[0])
    return found if by else df.sparkSession.range(1).join(F.broadcast(found), how="left").select("quantile")


def z_scores(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``z``: distance from the mean in sample deviations, 0 where all values are equal."""
    one = _keyed(df, value, by).groupBy(*by).agg(F.avg("x").alias("__mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("__std"))
    return attach(df, one, by).withColumn("z", ratio(F.col(value) - F.col("__mean"), F.col("__std"))).drop("__mean", "__std")


def median_and_mad(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    x = _keyed(df, value, by)
    mid = quantiles(x, [0.5], by, name="m")
    mid = Scratch(df.sparkSession, "median").table(mid.select(*by, F.col("m")[0].alias("__median")), "median")
    mad = quantiles(attach(x, mid, by).select(*by, F.abs(F.col("x") - F.col("__median")).alias("x")), [0.5], by, name="m")
    return attach(mid, mad.select(*by, F.col("m")[0].alias("__mad")), by)


def robust_z_scores(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``z``: 0.6745 (x - median) / MAD, 0 where MAD is 0."""
    return attach(df, median_and_mad(df, value, by), by).withColumn("z", ratio(0.6745 * (F.col(value) - F.col("__median")), F.col("__mad"))).drop("__median", "__mad")


def _positive(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.raise_error(F.lit("values must be positive")).cast("double"))


def geometric_mean(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return _keyed(df, value, by).groupBy(*by).agg(F.exp(F.avg(F.ln(_positive(F.col("x"))))).alias("geometric_mean"))


def harmonic_mean(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return _keyed(df, value, by).groupBy(*by).agg((F.count("x") / F.sum(1 / _positive(F.col("x")))).alias("harmonic_mean"))


def winsorise(df: DataFrame, value: str, by: Sequence[str] = (), *, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """``df`` with ``winsorised``: the value clamped to two quantiles."""
    if not 0 <= lower <= upper <= 1:
        raise ValueError("0 <= lower <= upper <= 1 must hold")
    one = quantiles(_keyed(df, value, by), [lower, upper], by, name="__q")
    clamped = F.greatest(F.col("__q")[0], F.least(F.col("__q")[1], F.col(value).cast("double")))
    return attach(df, one, by).withColumn("winsorised", F.when(F.col(value).isNotNull(), clamped)).drop("__q")


def trim_mean(df: DataFrame, value: str, by: Sequence[str] = (), *, proportion: float = 0.1) -> DataFrame:
    """Mean without the ``floor(n proportion)`` least and greatest values.

    Works on counts of distinct values, so tails are cut without a row number for every row.
    """
    if not 0 <= proportion < 0.5:
        raise ValueError("proportion must lie in [0, 0.5)")
    counts = _keyed(df, value, by).groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
    from tessera.plans.ordered import running

    placed = running(counts, [F.col("x")], {"upto": F.col("c")}, by)
    n = _keyed(df, value, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    k = F.floor(F.col("n") * F.lit(proportion))
    kept = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("n") - k) - F.greatest(F.col("upto") - F.col("c"), k))
    return attach(placed, n, by).withColumn("k", kept).groupBy(*by).agg((F.sum(F.col("x") * F.col("k")) / F.sum("k")).alias("trim_mean"))


def entropy(df: DataFrame, key: str, by: Sequence[str] = (), *, count: str | None = None) -> DataFrame:
    """Shannon entropy in nats of the shares of ``key``; ``count`` names a column of counts, else rows count 1.

    Negative counts raise, and so does a total of 0.
    """
    c = F.sum(F.when(F.col(count) < 0, F.raise_error(F.lit("counts must not be negative")).cast("double")).otherwise(F.col(count))) if count else F.count(F.lit(1))
    counts = df.groupBy(*by, key).agg(c.cast("double").alias("c"))
    # -sum(p ln p) = ln N - sum(c ln c) / N
    total = F.sum("c")
    inner = F.sum(F.when(F.col("c") > 0, F.col("c") * F.ln("c")).otherwise(0.0))
    return counts.groupBy(*by).agg(F.when(total > 0, F.ln(total) - inner / total).otherwise(F.raise_error(F.lit("the total must be positive")).cast("double")).alias("entropy"))


__all__ = ["attach", "describe", "descriptive_stats", "entropy", "geometric_mean", "harmonic_mean", "median_and_mad", "quantile", "robust_z_scores", "row_numbers", "trim_mean", "winsorise", "z_scores"]
