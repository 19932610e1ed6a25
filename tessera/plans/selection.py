"""Exact order statistics of groups of any size, without gathering a group's values anywhere.

A mergeable sketch of each group, of bounded size, gives values that bracket each wanted rank. One pass counts the rows
below and within each bracket, which proves that it holds the rank, or replaces it by the whole range of the group where it
does not. Only rows within a bracket, about one in a hundred, are shuffled: as counts of distinct values, range-partitioned
by group and value, whose running sums give the value at each rank. The sketch decides how much is shuffled, never the result.

Groups of at most ``SMALL`` rows, which one buffer holds, take Spark's own aggregate: same values, fewer jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordered import running
from tessera.plans.scratch import Scratch

#: Rows of a group whose values may meet in one buffer.
SMALL = 100_000
#: Steps of the sketch's answers, and how far a bracket reaches beyond a wanted rank, in steps.
STEPS, REACH = 400, 2
#: The sketch's ranks are right to one in so many rows.
ACCURACY = 2_000
#: Groups whose brackets are broadcast to the rows; with more, both sides are shuffled by group.
FEW_GROUPS = 20_000


def attach_groups(df: DataFrame, summary: DataFrame, by: Sequence[str], groups: int | None = None) -> DataFrame:
    """``df`` with the columns of a per-group summary, null keys matching null keys; ``groups`` is the counted size of the summary."""
    if not by:
        return df.join(F.broadcast(summary), how="left")  # one row, or none of nothing
    keys = {k: f"__key_{i}" for i, k in enumerate(by)}
    side = summary.select(*(F.col(k).alias(v) for k, v in keys.items()), *(c for c in summary.columns if c not in keys))
    if groups is not None and groups <= FEW_GROUPS:
        side = F.broadcast(side)
    same = F.lit(True)
    for k, v in keys.items():
        same = same & df[k].eqNullSafe(side[v])
    return df.join(side, same).drop(*keys.values())


def quantiles(x: DataFrame, ps: Sequence[float], by: Sequence[str] = (), *, value: str = "x", name: str = "q", small: int = SMALL) -> DataFrame:
    """``by`` and ``name``, an array of the quantiles ``ps``: linear between the values at the ranks around ``p (n - 1)``.

    ``value`` must be a double; nulls are left out, NaN counts as greater than all. Groups are the distinct ``by`` with a value,
    null keys included; one group without ``by``, and no row if there is nothing.
    """
    if not ps or not all(0 <= p <= 1 for p in ps):
        raise ValueError("p must lie in [0, 1]")
    x = x.where(F.col(value).isNotNull()).select(*by, value)
    sizes = Scratch(x.sparkSession, "sizes").table(x.groupBy(*by).agg(F.count(value).alias("__n")).where("__n > 0"), "sizes")
    large = sizes.where(F.col("__n") > small)
    n = large.count()
    plain = F.percentile(value, F.array(*(F.lit(float(p)) for p in ps))).alias(name)
    if not n:
        return x.groupBy(*by).agg(plain) if by else x.groupBy().agg(plain).where(F.col(name).isNotNull())
    if not by:
        return _selected(x, ps, by, value, name)
    flagged = attach_groups(x, sizes, by, sizes.count())
    few = flagged.where(F.col("__n") <= small).groupBy(*by).agg(plain)
    return few.unionByName(_selected(flagged.where(F.col("__n") > small).select(*by, value), ps, by, value, name))


def _selected(x: DataFrame, ps: Sequence[float], by: Sequence[str], value: str, name: str) -> DataFrame:
    scratch = Scratch(x.sparkSession, "quantiles")
    grid = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
    groups = x.groupBy(*by).agg(F.count(value).alias("__n"), F.percentile_approx(value, grid, ACCURACY).alias("__grid")).where("__n > 0")
    n, last = F.col("__n"), F.col("__n") - 1

    def at(step: Column) -> Column:
        return F.element_at("__grid", (F.greatest(F.lit(0), F.least(F.lit(STEPS), step)) + 1).cast("int"))

    columns: list[Column] = []
    for i, p in enumerate(ps):
        low = F.floor(last * F.lit(float(p)))
        high = F.ceil(last * F.lit(float(p)))
        columns += [low.alias(f"__r{i}"), high.alias(f"__s{i}"), at(F.floor(low / n * STEPS) - REACH).alias(f"__lo{i}"), at(F.ceil((high + 1) / n * STEPS) + REACH).alias(f"__hi{i}")]
    brackets = scratch.table(groups.select(*by, n, at(F.lit(0)).alias("__least"), at(F.lit(STEPS)).alias("__most"), *columns), "brackets")
    size = brackets.count()
    v = F.col(value)
    each = range(len(ps))
    rows = attach_groups(x, brackets, by, size)
    counts = rows.groupBy(*by).agg(
        *(F.count_if(v < F.col(f"__lo{i}")).alias(f"__b{i}") for i in each), *(F.count_if((v >= F.col(f"__lo{i}")) & (v <= F.col(f"__hi{i}"))).alias(f"__m{i}") for i in each)
    )
    proved = attach_groups(brackets, counts, by, size)
    holds = [(F.col(f"__r{i}") >= F.col(f"__b{i}")) & (F.col(f"__s{i}") < F.col(f"__b{i}") + F.col(f"__m{i}")) for i in each]
    # without a proof the bracket is everything: null bounds stand for none
    kept = [F.when(ok, F.col(f"__{c}{i}")).alias(f"__{c}{i}") for i, ok in enumerate(holds) for c in ("lo", "hi")]
    below = [F.when(ok, F.col(f"__b{i}")).otherwise(F.lit(0)).alias(f"__b{i}") for i, ok in enumerate(holds)]
    proved = scratch.table(proved.select(*by, "__n", *(f"__{c}{i}" for i in each for c in "rs"), *kept, *below), "proved")
    rows = attach_groups(x, proved, by, size)
    inside = [F.when(F.col(f"__lo{i}").isNull() | ((v >= F.col(f"__lo{i}")) & (v <= F.col(f"__hi{i}"))), F.lit(i)) for i in each]
    found = rows.select(*by, v.alias("__x"), F.explode(F.array_compact(F.array(*inside))).alias("__i")).groupBy(*by, "__i", "__x").agg(F.count("*").alias("__c"))
    order = [*by, "__i", "__x"]
    placed = scratch.table(running(found, [F.col(c) for c in order], {"__upto": F.col("__c")}), "placed")
    start = placed.groupBy(*by, "__i").agg(F.min(F.col("__upto") - F.col("__c")).alias("__start"))
    ranked = attach_groups(placed, start, [*by, "__i"], size * len(ps))
    ranked = attach_groups(ranked, proved, by, size)

    def own(c: str) -> Column:
        return F.element_at(F.array(*(F.col(f"__{c}{i}") for i in each)), F.col("__i") + 1)

    upto = own("b") + F.col("__upto") - F.col("__start")
    one = ranked.groupBy(*by, "__i").agg(F.min(F.when(upto > own("r"), F.col("__x"))).alias("__a"), F.min(F.when(upto > own("s"), F.col("__x"))).alias("__z"), F.any_value("__n").alias("__n"))
    p = F.element_at(F.array(*(F.lit(float(p)) for p in ps)), F.col("__i") + 1)
    position = (F.col("__n") - 1) * p
    share = position - F.floor(position)
    between = F.when(F.col("__a") == F.col("__z"), F.col("__a")).otherwise((1 - share) * F.col("__a") + share * F.col("__z"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("__i", between.alias("v")))), lambda s: s["v"])
    return one.groupBy(*by).agg(values.alias(name))
