"""Resamples as counts: how often each run draws from each leaf of a table, without drawing rows one by one and moving them.

Values are numbered in their order and cut into leaves. A balanced tree over the leaves splits the number of draws of every
run from the top: by binomial draws for samples with replacement, by hypergeometric ones for subsets without. The draws of a
node follow from the seed and the node alone, so the task that holds a leaf finds what all runs take from it, and how much
they take from the leaves before, on its own. Runs are distributed as if rows had been drawn one by one.

What leaves a task is one row of partial sums for each run; tasks add up those of their leaves before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.ordered import row_numbers
from tessera.plans.scratch import Scratch

#: Draws of all runs together that may be made and moved one by one.
MOST_DRAWN = 1_000_000
#: Values of a leaf, and draws of a leaf that are held at once.
LEAF, DRAWS = 512, 1 << 21
#: Tasks that leaves are dealt to, at most.
TASKS = 240

_PARTIAL = "run long, s double, low double, high double, a double, z double"


class _Tree:
    """What ``runs`` runs take from each leaf of ``n`` values, ``total`` in all, each value at most once if ``once``."""

    def __init__(self, n: int, total: int, runs: int, seed: int, once: bool, leaf: int):
        self.n, self.total, self.runs, self.seed, self.once, self.leaf = n, total, runs, seed, once, leaf

    def _size(self, lo: int, hi: int) -> int:
        return min(self.n, hi * self.leaf) - lo * self.leaf

    def _split(self, lo: int, hi: int, here: np.ndarray) -> np.ndarray:
        """How many of a node's draws fall into its left half."""
        mid = (lo + hi) // 2
        rng = np.random.default_rng([self.seed, 1, lo, hi])
        left, right = self._size(lo, mid), self._size(mid, hi)
        return rng.hypergeometric(left, right, here) if self.once else rng.binomial(here, left / (left + right))

    def at(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Draws of each run from this leaf, and from all leaves before it."""
        lo, hi = 0, -(-self.n // self.leaf)
        here, before = np.full(self.runs, self.total, np.int64), np.zeros(self.runs, np.int64)
        while hi - lo > 1:
            mid, taken = (lo + hi) // 2, self._split(lo, hi, here)
            if leaf < mid:
                here, hi = taken, mid
            else:
                here, before, lo = here - taken, before + taken, mid
        return here, before

    def holding(self, ranks: tuple[int, ...]) -> list[int]:
        """Leaves that hold one of these ranks of any run's draws; nodes without one are not looked into."""
        found, open_nodes = [], [(0, -(-self.n // self.leaf), np.full(self.runs, self.total, np.int64), np.zeros(self.runs, np.int64))]
        while open_nodes:
            lo, hi, here, before = open_nodes.pop()
            if not any(((before <= r) & (r < before + here)).any() for r in ranks):
                continue
            if hi - lo == 1:
                found.append(lo)
                continue
            mid, taken = (lo + hi) // 2, self._split(lo, hi, here)
            open_nodes += [(lo, mid, taken, before), (mid, hi, here - taken, before + taken)]
        return sorted(found)

    def draws(self, leaf: int, size: int, counts: np.ndarray, of: Callable[[np.ndarray, np.ndarray, np.ndarray], None], *, ordered: bool = True) -> None:
        """``of(runs, ends, places)`` for batches of runs: the places in the leaf that each run takes, up to its end, ascending if ``ordered``."""
        rng = np.random.default_rng([self.seed, 2, leaf])
        step = max(1, DRAWS // max(1, size if self.once else int(counts.mean()) + 1))
        for lo in range(0, self.runs, step):
            c = counts[lo : lo + step]
            if self.once:
                order = rng.random((len(c), size)).argsort(axis=1)
                if ordered:
                    run, place = np.nonzero(order.argsort(axis=1) < c[:, None])
                else:
                    place = order[np.arange(size) < c[:, None]]
            else:
                run = np.repeat(np.arange(len(c)), c)
                place = rng.integers(0, size, len(run))
                if ordered:
                    place = np.sort(run * size + place) - run * size
            of(np.arange(lo, lo + len(c)), np.cumsum(c), place)


def _partials(rows: DataFrame, tree: _Tree, ranks: tuple[int, int] | None, *, sums_only: bool = False) -> DataFrame:
    """For each leaf and run the sum, least and greatest of what it takes, and its values at two ranks where they fall into this leaf.

    Other than sums need each run's draws in order, and are left out with ``sums_only``.
    """
    leaf_size = tree.leaf

    def work(t: pa.Table) -> pa.Table:
        at = t["at"].to_numpy()
        order = np.argsort(at)
        x, leaf = t["x"].to_numpy()[order], int(at[0] // leaf_size)
        counts, before = tree.at(leaf)
        s, low, high, a, z = (np.full(tree.runs, np.nan) for _ in range(5))

        def of(runs: np.ndarray, ends: np.ndarray, places: np.ndarray) -> None:
            c = counts[runs]
            starts = ends - c
            some = c > 0
            taken = x[places]
            s[runs] = 0.0
            if len(taken):
                s[runs[some]] = np.add.reduceat(taken, starts[some])
            if len(taken) and not sums_only:
                low[runs[some]], high[runs[some]] = taken[starts[some]], taken[ends[some] - 1]
            for rank, out in zip(ranks or (), (a, z), strict=False):
                inside = (before[runs] <= rank) & (rank < before[runs] + c)
                out[runs[inside]] = taken[starts[inside] + rank - before[runs[inside]]]

        tree.draws(leaf, len(x), counts, of, ordered=not sums_only)
        columns = [pa.array(v, mask=np.isnan(v)) for v in (s, low, high, a, z)]
        return pa.table([pa.array(np.arange(tree.runs)), *columns], names=["run", "s", "low", "high", "a", "z"])

    leaves = rows.withColumn("leaf", F.floor(F.col("at") / leaf_size))
    if ranks is not None:  # other leaves hold no wanted value
        leaves = leaves.where(F.col("leaf").isin(tree.holding(ranks)))
    # a leaf is little data but much work, so the number of tasks is said, or small partitions would be put together
    return leaves.repartition(max(1, min(TASKS, -(-tree.n // leaf_size))), "leaf").groupBy("leaf").applyInArrow(work, _PARTIAL)


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows(id, x)`` as ``(at, x)``, numbered from 0 in the order of x and id, and how many there are."""
    found = Scratch(rows.sparkSession, "resampling").table(row_numbers(rows, [F.col("x"), F.col("id")], "at").select((F.col("at") - 1).alias("at"), "x"), "placed")
    return found, found.count()


def resampled(rows: DataFrame, n: int, statistic: str, *, runs: int, seed: int, leaf: int = LEAF) -> DataFrame:
    """``run, s``: a statistic (mean, sum, min, max or median) of each of ``runs`` samples of n of the placed rows, with replacement."""
    tree = _Tree(n, n, runs, seed, False, leaf)
    middle = (n - 1) // 2, n // 2
    one = _partials(rows, tree, middle if statistic == "median" else None, sums_only=statistic in ("mean", "sum")).groupBy("run")
    value = {"sum": F.sum("s"), "mean": F.sum("s") / n, "min": F.min("low"), "max": F.max("high"), "median": (F.max("a") + F.max("z")) / 2}[statistic]
    return one.agg(value.alias("s"))


def subset_sums(rows: DataFrame, n: int, size: int, *, runs: int, seed: int, leaf: int = LEAF) -> DataFrame:
    """``run, s``: the sum over a uniform subset of ``size`` of the n placed rows, for each of ``runs`` runs."""
    return _partials(rows, _Tree(n, size, runs, seed, True, leaf), None, sums_only=True).groupBy("run").agg(F.sum("s").alias("s"))
