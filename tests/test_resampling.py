"""Resamples by counts are distributed as drawn ones."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import resampling, sampling, testing


def values(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id long, x double").repartition(3)


@pytest.mark.parametrize("once", [False, True])
def test_leaves_take_all_draws(once):
    """What runs take of all leaves adds up, and the draws before a leaf are those of the leaves before it."""
    tree = resampling._Tree(1000, 300, 50, 9, once, 64)
    here = [tree.at(leaf) for leaf in range(16)]
    assert (sum(h for h, _ in here) == 300).all()
    for leaf in range(16):
        assert (here[leaf][1] == sum((h for h, _ in here[:leaf]), np.zeros(50, int))).all()
        if once:
            assert here[leaf][0].max() <= (64 if leaf < 15 else 40)
    # each value is taken equally often, and in subsets never twice
    taken = np.zeros(1000)
    wide = resampling._Tree(1000, 300, 4000, 9, once, 64)
    for leaf in range(16):
        counts, _ = wide.at(leaf)
        size = 64 if leaf < 15 else 40

        def of(runs, ends, places, counts=counts, leaf=leaf, size=size):
            assert ends[-1] == len(places) == counts[runs].sum()
            for lo, hi in zip(ends - counts[runs], ends, strict=True):
                assert (np.diff(places[lo:hi]) >= (1 if once else 0)).all()
            taken[leaf * 64 : leaf * 64 + size] += np.bincount(places, minlength=size)

        wide.draws(leaf, size, counts, of)
    assert taken.sum() == 4000 * 300 and abs(taken / 4000 - 0.3).max() < 0.06


def test_statistics_of_resamples(spark):
    xs = np.round(np.random.default_rng(2).normal(size=900), 2)
    rows, n = resampling.placed(values(spark, xs))
    rng = np.random.default_rng(3)
    drawn = xs[rng.integers(0, n, (3000, n))]
    for name, fn in (("mean", np.mean), ("sum", np.sum), ("median", np.median), ("min", np.min), ("max", np.max)):
        got = np.array([r.s for r in resampling.resampled(rows, n, name, runs=3000, seed=1, leaf=100).collect()])
        want = fn(drawn, axis=1)
        assert len(got) == 3000 and np.isin(np.round(got, 2), np.round(xs, 2)).all() if name in ("min", "max") else True
        scale = max(want.std(), 1e-9)
        assert abs(got.mean() - want.mean()) < 0.15 * scale and abs(got.std() - want.std()) < 0.1 * scale + 1e-9
        for q in (0.05, 0.5, 0.95):
            assert abs(np.quantile(got, q) - np.quantile(want, q)) < 0.3 * scale


def test_small_and_constant_samples(spark):
    for xs in ([3.0], [3.0] * 700):
        for name, want in (("mean", 3), ("median", 3), ("min", 3), ("sum", 3 * len(xs))):
            r = sampling.bootstrap(values(spark, xs), "x", "id", name, n_resamples=20, method="counts").first()
            assert (r.statistic, r.mean, r.std, r.ci_lower, r.ci_upper) == (want, want, 0, want, want)
    # both values of a sample of two, by all four draws
    got = [r.s for r in resampling.resampled(*resampling.placed(values(spark, [0, 1])), "mean", runs=4000, seed=0).collect()]
    assert abs(np.mean(np.array(got) == 0.5) - 0.5) < 0.04 and abs(np.mean(np.array(got) == 0) - 0.25) < 0.04


def test_the_seed_decides_and_partitioning_does_not(spark):
    xs = np.arange(300.0)
    one, two, other = (sampling.bootstrap(values(spark, xs).repartition(n), "x", "id", n_resamples=50, seed=s, method="counts").first() for n, s in ((1, 4), (5, 4), (1, 5)))
    assert one.mean == pytest.approx(two.mean) and one.ci_lower == pytest.approx(two.ci_lower) and one.mean != other.mean


def test_permutations_against_all_splits(spark):
    a, b = [1.0, 5.0, 6.5, 9.0], [0.0, 2.0, 2.5, 3.0, 4.0]
    both = a + b
    seen = np.mean(a) - np.mean(b)
    gaps = [np.mean([both[i] for i in c]) - np.mean([both[i] for i in range(9) if i not in c]) for c in combinations(range(9), 4)]
    want = np.mean([abs(g) >= abs(seen) - 1e-12 for g in gaps])
    df = spark.createDataFrame([(i, "a" if i < 4 else "b", x) for i, x in enumerate(both)], "id long, g string, x double")
    got = testing.permutation_test(df, "x", "g", "a", "b", id_col="id", n_permutations=20_000, method="counts").first()
    drawn = testing.permutation_test(df, "x", "g", "a", "b", id_col="id", n_permutations=500, method="draws").first()
    assert got.statistic == pytest.approx(seen) == drawn.statistic and abs(got.p_value - want) < 0.015 and abs(drawn.p_value - want) < 0.08
    assert (got.n1, got.n2) == (4, 5)
    with pytest.raises(ValueError, match="method"):
        testing.permutation_test(df, "x", "g", "a", "b", id_col="id", method="x")
    with pytest.raises(ValueError, match="unknown"):
        sampling.bootstrap(df, "x", "id", "mode")


def test_a_rank_opens_few_leaves():
    """Only leaves that hold the rank of some run are worked on, and they are all of them."""
    tree = resampling._Tree(100_000, 100_000, 200, 3, False, 500)
    rank = 49_999
    want = [leaf for leaf in range(200) for here, before in [tree.at(leaf)] if ((before <= rank) & (rank < before + here)).any()]
    assert tree.holding((rank,)) == want and len(want) < 20


def test_leaves_are_dealt_to_many_tasks(spark):
    """Little data, much work: partitions are not put together."""
    rows = spark.range(20_000).select(F.col("id").alias("at"), F.col("id").cast("double").alias("x"))
    sums = resampling._partials(rows, resampling._Tree(20_000, 7_000, 3, 0, True, 512), None, sums_only=True)
    assert sums.select(F.spark_partition_id()).distinct().count() > 10
    got = sorted(r.s for r in resampling.subset_sums(rows, 20_000, 20_000, runs=3, seed=0).collect())
    assert got == [19_999 * 10_000.0] * 3
