"""Hypothesis tests and corrections for multiple testing. Null values are left out.

Statistics come from one aggregate over the samples, and p-values from expressions on its single row (per group).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import md5_key
from tessera.functions.special import chi2_tail, normal_cdf, t_two_tailed
from tessera.functions.vectors import ratio
from tessera.operators import resampling
from tessera.plans.ordered import row_numbers, running

_INF = float("inf")


def _two(df: DataFrame, value: str, group: str, a: object, b: object, by: Sequence[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull() & F.col(group).isin([a, b])).select(*by, F.col(value).cast("double").alias("x"), (F.col(group) == F.lit(a)).alias("first"))


def _at_least(n: Column, least: int, value: Column) -> Column:
    return F.when(n >= least, value).otherwise(F.raise_error(F.lit(f"each sample needs at least {least} values")).cast("double"))


def cohens_d(n1: Column, n2: Column, m1: Column, m2: Column, v1: Column, v2: Column) -> Column:
    """Difference of means in pooled standard deviations; 0 for samples under 2 or without spread."""
    pooled = F.sqrt(ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.when((n1 < 2) | (n2 < 2), 0.0).otherwise(ratio(m1 - m2, pooled))


def welch_t_test(df: DataFrame, value: str, group: str, a: object, b: object, by: Sequence[str] = ()) -> DataFrame:
    """``statistic, p_value, effect_size, n1, n2``. Without any spread t is 0 and p is 1, whatever the means."""
    pick = lambda f, first: f(F.when(F.col("first") if first else ~F.col("first"), F.col("x")))
    one = _two(df, value, group, a, b, by).groupBy(*by).agg(*(pick(f, w).alias(f"{n}{k}") for w, k in ((True, 1), (False, 2)) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))))
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    se2 = v1 / n1 + v2 / n2
    flat = se2 == 0
    t = F.when(flat, 0.0).otherwise(F.try_divide(m1 - m2, F.sqrt(se2)))
    df_ = F.when(flat, (n1 + n2 - 2).cast("double")).otherwise(F.try_divide(se2 * se2, F.pow(v1 / n1, F.lit(2)) / (n1 - 1) + F.pow(v2 / n2, F.lit(2)) / (n2 - 1)))
    one = one.withColumn("t", _at_least(F.least(n1, n2), 2, t)).withColumn("df", df_)
    return one.select(*by, F.col("t").alias("statistic"), t_two_tailed(F.col("t"), F.col("df")).alias("p_value"), cohens_d(n1, n2, m1, m2, v1, v2).alias("effect_size"), "n1", "n2")


def one_sample_t_test(df: DataFrame, value: str, mu: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """``statistic, p_value, effect_size (unsigned), n1``. Without spread p is 0 (t infinite) if the mean is not ``mu``, else 1."""
    one = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n1"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    gap = F.col("m") - mu
    t = F.when(F.col("s") == 0, F.when(gap == 0, 0.0).when(gap > 0, _INF).otherwise(-_INF)).otherwise(F.try_divide(gap, F.col("s") / F.sqrt("n1")))
    one = one.withColumn("t", _at_least(F.col("n1"), 2, t))
    p = F.when(F.col("t") == 0, 1.0).otherwise(t_two_tailed(F.col("t"), (F.col("n1") - 1).cast("double")))
    return one.select(*by, F.col("t").alias("statistic"), p.alias("p_value"), ratio(F.abs(gap), F.col("s")).alias("effect_size"), "n1")


def _by_value(two: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values with their counts in both samples, and running counts up to each."""
    counts = two.groupBy(*by, "x").agg(F.count_if("first").alias("c1"), F.count_if(~F.col("first")).alias("c2"))
    return running(counts, [F.col("x")], {"f1": F.col("c1"), "f2": F.col("c2")}, by)


def mann_whitney(df: DataFrame, value: str, group: str, a: object, b: object, by: Sequence[str] = ()) -> DataFrame:
    """``statistic`` (the smaller U), ``p_value`` by the normal approximation with continuity 0.5 and no correction for ties, rank-biserial effect, n1, n2.

    Ranks are averaged within ties; they follow from counts per distinct value, so no row is ranked on its own.
    """
    v = _by_value(_two(df, value, group, a, b, by), by)
    upto, here = F.col("f1") + F.col("f2"), F.col("c1") + F.col("c2")
    rank = upto - (here - 1) / 2.0
    one = v.groupBy(*by).agg(F.sum(F.col("c1") * rank).alias("r1"), F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    one = one.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2.0).withColumn("u", _at_least(F.least(n1, n2), 1, F.least(F.col("u1"), n1 * n2 - F.col("u1"))))
    sigma = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    z = ratio(F.col("u") - n1 * n2 / 2.0 + 0.5, sigma)
    return one.select(*by, F.col("u").alias("statistic"), F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(z)))).alias("p_value"), (1 - 2 * F.col("u") / (n1 * n2)).alias("effect_size"), "n1", "n2")


def ks_test(df: DataFrame, value: str, group: str, a: object, b: object, by: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: ``statistic`` D, asymptotic ``p_value``, ``effect_size`` D, n1, n2."""
    v = _by_value(_two(df, value, group, a, b, by), by)
    n = _two(df, value, group, a, b, by).groupBy(*by).agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2"))
    from tessera.operators.stats import attach

    one = attach(v, n, by).groupBy(*by).agg(F.max(F.abs(F.try_divide("f1", "n1") - F.try_divide("f2", "n2"))).alias("d"), F.any_value("n1").alias("n1"), F.any_value("n2").alias("n2"))
    one = one.withColumn("d", _at_least(F.least("n1", "n2"), 1, F.col("d")))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    term = lambda s, k: s + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam)
    p = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(99)), F.lit(0.0), term)
    return one.select(*by, F.col("d").alias("statistic"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p_value"), F.col("d").alias("effect_size"), "n1", "n2")


def chi_squared_test(df: DataFrame, observed: str, expected: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Goodness of fit of counts (one row per category) to ``expected`` or to equal shares: ``statistic, p_value, effect_size`` (Cramer's V), n1 (total), n2 (categories)."""
    o = F.col(observed).cast("double")
    rows = df.withColumn("__o", F.when(o < 0, F.raise_error(F.lit("counts must not be negative")).cast("double")).otherwise(o))
    if expected is None:
        share = rows.groupBy(*by).agg((F.sum("__o") / F.count(F.lit(1))).alias("__e"))
        from tessera.operators.stats import attach

        rows = attach(rows, share, by)
    else:
        rows = rows.withColumn("__e", F.col(expected).cast("double"))
    e = F.when(F.col("__e") > 0, F.col("__e")).otherwise(F.raise_error(F.lit("expected counts must be positive")).cast("double"))
    one = rows.groupBy(*by).agg(F.sum(F.pow(F.col("__o") - e, F.lit(2)) / e).alias("s"), F.sum("__o").alias("n"), F.count(F.lit(1)).alias("k"))
    free = (F.col("k") - 1).cast("double")
    one = one.withColumn("s", _at_least(F.col("k"), 2, F.col("s")))
    return one.select(*by, F.col("s").alias("statistic"), chi2_tail(F.col("s"), free).alias("p_value"), F.sqrt(ratio(F.col("s"), F.col("n") * free)).alias("effect_size"), F.col("n").cast("long").alias("n1"), F.col("k").alias("n2"))


def permutation_test(df: DataFrame, value: str, group: str, a: object, b: object, *, id_col: str, n_permutations: int = 10_000, seed: int = 0, statistic: Callable[[list, list], float] | None = None, method: str | None = None) -> DataFrame:
    """``statistic, p_value, n1, n2``: how often a shuffled split is at least as far apart; p = (count + 1) / (permutations + 1).

    The statistic is the difference of means. By ``counts``, tasks work out which of their rows each permutation takes as the first
    sample and shuffle one sum for each permutation (``resampling``). ``draws`` orders the rows of every permutation by an md5 key
    that any engine can repeat. Unless told, more than ``resampling.MOST_DRAWN`` ordered rows go by counts; both have the same
    distribution. Any other ``statistic`` runs in Python, on the rows of each permutation.
    """
    two = _two(df.withColumn("__id", F.col(id_col).cast("string")), value, group, a, b, ["__id"])
    sizes = two.agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2")).first()
    n1, n2 = sizes["n1"], sizes["n2"]
    if not n1 or not n2:
        raise ValueError("both samples need values")
    method = method or ("draws" if (n1 + n2) * n_permutations <= resampling.MOST_DRAWN else "counts")
    if method == "counts" and statistic is None:
        at, n = resampling.placed(two.select(F.col("__id").alias("id"), "x"))
        mean = lambda c: F.avg(F.when(c, F.col("x")))
        seen = two.agg((mean(F.col("first")) - mean(~F.col("first"))).alias("statistic"), F.sum("x").alias("all"))
        sums = resampling.subset_sums(at, n, n1, runs=n_permutations, seed=seed).join(F.broadcast(seen))
        far = F.abs(F.col("s") / n1 - (F.col("all") - F.col("s")) / n2) >= F.abs("statistic") - 1e-12
        one = sums.groupBy("statistic").agg(F.count_if(far).alias("c"))
        return one.select("statistic", ((F.col("c") + 1) / (n_permutations + 1)).alias("p_value"), F.lit(n1).cast("long").alias("n1"), F.lit(n2).cast("long").alias("n2"))
    if method not in ("counts", "draws"):
        raise ValueError(f"unknown method {method!r}")
    runs = df.sparkSession.range(n_permutations).withColumnRenamed("id", "run")
    # the samples are spread over the runs; a test's samples are far fewer than a corpus
    spread = two.crossJoin(runs).withColumn("rn", F.row_number().over(Window.partitionBy("run").orderBy(md5_key(seed, "permutation", F.col("run"), F.col("__id")), "__id")))
    spread = spread.withColumn("first", F.col("rn") <= n1)
    if statistic is None:
        gap = lambda d: d.agg((F.avg(F.when(F.col("first"), F.col("x"))) - F.avg(F.when(~F.col("first"), F.col("x")))).alias("s"))
        seen, drawn = gap(two.groupBy()), gap(spread.groupBy("run"))
    else:
        fn = lambda p: pd.DataFrame({"s": [float(statistic(p.loc[p["first"], "x"].tolist(), p.loc[~p["first"], "x"].tolist()))]})
        seen, drawn = two.groupBy().applyInPandas(fn, "s double"), spread.groupBy("run").applyInPandas(fn, "s double")
    seen = seen.select(F.col("s").alias("statistic"))
    one = drawn.crossJoin(F.broadcast(seen)).groupBy("statistic").agg(F.count_if(F.abs("s") >= F.abs("statistic") - 1e-12).alias("c"), F.count(F.lit(1)).alias("m"))
    return one.select("statistic", ((F.col("c") + 1) / (F.col("m") + 1)).alias("p_value"), F.lit(n1).cast("long").alias("n1"), F.lit(n2).cast("long").alias("n2"))


def _family(df: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    from tessera.operators.stats import attach

    bad = F.col(p).isNull() | (F.col(p) < 0) | (F.col(p) > 1)
    checked = df.withColumn(p, F.when(bad, F.raise_error(F.lit("p-values must lie in [0, 1]")).cast("double")).otherwise(F.col(p)))
    return attach(checked, df.groupBy(*by).agg(F.count(F.lit(1)).alias("__m")), by)


def _alpha(alpha: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie in (0, 1)")


def bonferroni(df: DataFrame, p: str, by: Sequence[str] = (), *, alpha: float = 0.05) -> DataFrame:
    """``df`` with ``adjusted_p, rejected``."""
    _alpha(alpha)
    out = _family(df, p, by).withColumn("adjusted_p", F.least(F.lit(1.0), F.col(p) * F.col("__m"))).drop("__m")
    return out.withColumn("rejected", F.col("adjusted_p") <= alpha)


def _step(df: DataFrame, p: str, by: Sequence[str], id_col: str, up: bool) -> DataFrame:
    """Ranked p-values with a running extreme; a family without groups is range-partitioned, not gathered in one window."""
    x, m, rn = F.col(p), F.col("__m"), F.col("__rn")
    ranked = row_numbers(_family(df, p, by), [x, F.col(id_col)], "__rn", by)
    if up:
        least = running(ranked, [x.desc(), F.col(id_col).desc()], {"adjusted_p": -(x * m / rn)}, by, most=True)
        return least.withColumn("adjusted_p", F.least(F.lit(1.0), -F.col("adjusted_p")))
    return running(ranked, [x, F.col(id_col)], {"adjusted_p": F.least(F.lit(1.0), x * (m - rn + 1))}, by, most=True)


def holm(df: DataFrame, p: str, by: Sequence[str] = (), *, id_col: str, alpha: float = 0.05) -> DataFrame:
    """Step-down: ``df`` with ``adjusted_p, rejected``; ties in order of ``id_col``."""
    _alpha(alpha)
    return _step(df, p, by, id_col, False).withColumn("rejected", F.col("adjusted_p") <= alpha).drop("__m", "__rn")


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), *, id_col: str, alpha: float = 0.05) -> DataFrame:
    """Step-up: ``df`` with ``adjusted_p, rejected``."""
    _alpha(alpha)
    return _step(df, p, by, id_col, True).withColumn("rejected", F.col("adjusted_p") <= alpha).drop("__m", "__rn")
