"""Anomaly detectors. Each returns ``df`` with ``score`` and ``is_outlier``; count the flags for the number of outliers.

Null values get a null score and are never flagged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import md5_key
from tessera.functions.vectors import ratio
from tessera.operators.pairs import nearest
from tessera.operators.stats import attach, robust_z_scores, z_scores
from tessera.plans.scratch import Scratch
from tessera.plans.selection import quantiles


def _flagged(df: DataFrame, threshold: float) -> DataFrame:
    return df.withColumn("is_outlier", F.coalesce(F.col("score") > threshold, F.lit(False)))


def zscore_detector(df: DataFrame, value: str, by: Sequence[str] = (), *, threshold: float = 3.0) -> DataFrame:
    return _flagged(z_scores(df, value, by).withColumn("score", F.abs("z")).drop("z"), threshold)


def mad_detector(df: DataFrame, value: str, by: Sequence[str] = (), *, threshold: float = 3.5) -> DataFrame:
    return _flagged(robust_z_scores(df, value, by).withColumn("score", F.abs("z")).drop("z"), threshold)


def iqr_detector(df: DataFrame, value: str, by: Sequence[str] = (), *, threshold: float = 1.5) -> DataFrame:
    """Score: how far beyond a fence of ``threshold`` interquartile ranges, in those ranges; flagged beyond the fence."""
    one = quantiles(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x")), [0.25, 0.75], by, name="__q")
    rows = attach(df, one, by)
    lo, hi, x = F.col("__q")[0], F.col("__q")[1], F.col(value).cast("double")
    iqr = hi - lo
    beyond = F.greatest(lo - threshold * iqr - x, x - hi - threshold * iqr, F.lit(0.0))
    score = F.when(x.isNotNull(), ratio(beyond, iqr))
    return rows.withColumn("score", score).withColumn("is_outlier", F.coalesce(F.col("score") > 0, F.lit(False))).drop("__q")


def lof(df: DataFrame, *, id_col: str = "id", vector: str = "v", k: int = 20, threshold: float = 1.5) -> DataFrame:
    """``id, score, is_outlier``: local outlier factor over k nearest neighbours (ties by id).

    A point whose neighbours all coincide with it has infinite density; its factor is 1 if its neighbours' density is infinite too.
    """
    if not 0 < k < df.count():
        raise ValueError("k must lie between 1 and the number of points less one")
    near = Scratch(df.sparkSession, "lof").table(nearest(df, k, id_col=id_col, vector=vector), "near")  # read three times
    reach = near.groupBy(F.col("i").alias("j")).agg(F.max("d").alias("kd"))
    dist = near.join(reach, "j").select("i", "j", F.greatest("kd", "d").alias("rd"))
    density = dist.groupBy("i").agg(F.avg("rd").alias("m")).select("i", F.when(F.col("m") > 0, F.try_divide(F.lit(1.0), "m")).otherwise(float("inf")).alias("lrd"))
    other = density.select(F.col("i").alias("j"), F.col("lrd").alias("lj"))
    one = dist.join(other, "j").groupBy("i").agg(F.avg("lj").alias("mean")).join(density, "i")
    inf = float("inf")
    score = F.when(F.col("lrd") == inf, F.when(F.col("mean") == inf, 1.0).otherwise(0.0)).when(F.col("mean") == inf, inf).otherwise(F.try_divide("mean", "lrd"))
    return one.select(F.col("i").alias("id"), score.alias("score"), (score > threshold).alias("is_outlier"))


def _c(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finisher of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _tree_samples(rows: DataFrame, n_trees: int, size: int, seed: int) -> list[np.ndarray]:
    """For each tree the values of the ``size`` rows of ``rows(id, x)`` that have the least keys, sorted.

    A key is the first half of the row's md5 key, mixed with the number of the tree. Each task hands on its own least keys.
    """

    def least(tree: np.ndarray, key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((x, key, tree))
        tree, key, x = tree[order], key[order], x[order]
        few = np.arange(len(tree)) - np.searchsorted(tree, tree) < size
        return tree[few], key[few], x[few]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = _mix(np.arange(1, n_trees + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))[:, None]
        bound = np.full(n_trees, np.iinfo(np.int64).max)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, waiting = [none], 0
        for p in batches:
            h = np.frombuffer(b"".join(p["k"]), ">u8").astype(_U)
            keys = (_mix(h[None, :] ^ salt) >> _U(1)).astype(np.int64)
            tree, at = np.nonzero(keys <= bound[:, None])
            held.append((tree, keys[tree, at], p["x"].to_numpy()[at]))
            waiting += len(tree)
            if waiting > 2 * n_trees * size:
                held, waiting = [least(*map(np.concatenate, zip(*held, strict=True)))], 0
                tree, key, _ = held[0]
                last = np.searchsorted(tree, np.arange(n_trees), "right") - 1
                full = np.bincount(tree, minlength=n_trees) >= size
                bound[full] = key[last[full]]
        tree, key, x = least(*map(np.concatenate, zip(*held, strict=True)))
        yield pd.DataFrame({"tree": tree, "key": key, "x": x})

    keyed = rows.select(F.unhex(F.substring(md5_key(seed, "isolation", F.col("id")), 1, 16)).alias("k"), "x")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("key", "x"))
    found = keyed.mapInPandas(run, "tree long, key long, x double").withColumn("rank", rank).where(F.col("rank") <= size).select("tree", "x")
    got = found.toPandas()  # n_trees x size rows at most
    return [np.sort(got["x"].to_numpy()[got["tree"].to_numpy() == t]) for t in range(n_trees)]


def isolation_score(df: DataFrame, value: str, id_col: str, *, n_trees: int = 100, subsample_size: int = 256, threshold: float = 0.6, seed: int = 0) -> DataFrame:
    """``id, score, is_outlier`` of a one-dimensional isolation forest: ``2 ** (-mean depth / c(sample))``.

    Trees are built on ``n_trees`` samples of ``subsample_size`` values, each drawn from the whole table (rows of least md5 keys,
    mixed per tree); every executor then applies them to its own rows. Agreement with other implementations is statistical.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("x"))
    n = rows.count()
    size = min(subsample_size, n)
    rng = np.random.default_rng(seed)
    depth_limit = int(np.ceil(np.log2(max(size, 2))))
    trees = []
    for sample in _tree_samples(rows, n_trees, size, seed) if n else []:
        cuts: list[tuple[float, float, float]] = []  # (from, to, depth): a tree on a line is a row of intervals
        stack = [(sample, -np.inf, np.inf, 0)]
        while stack:
            s, lo, hi, d = stack.pop()
            if len(s) <= 1 or d >= depth_limit or s[0] == s[-1]:
                cuts.append((lo, hi, d + _c(len(s))))
                continue
            at = rng.uniform(s[0], s[-1])
            i = int(np.searchsorted(s, at))
            stack += [(s[:i], lo, at, d + 1), (s[i:], at, hi, d + 1)]
        cuts.sort()
        trees.append((np.array([c[0] for c in cuts]), np.array([c[2] for c in cuts])))
    kind = df.schema[id_col].dataType.simpleString()
    scale = _c(size) or 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x = p["x"].to_numpy()
            depth = np.zeros(len(x))
            for lo, d in trees:
                depth += d[np.maximum(np.searchsorted(lo, x, "right") - 1, 0)]
            yield pd.DataFrame({"id": p["id"], "score": 2 ** (-depth / len(trees) / scale) if size > 1 else np.ones(len(x))})

    return rows.mapInPandas(run, f"id {kind}, score double").withColumn("is_outlier", F.col("score") > threshold)
