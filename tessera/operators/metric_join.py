"""Exact Euclidean joins that look only where the triangle inequality allows a match.

Pivots cut the vectors into cells of what lies nearest to each, and a cell into rings of similar distance to its pivot: a ring
is a block of bounded size, whatever a cell holds. A row first meets its own block. That gives it a distance that its k-th
neighbour cannot exceed, and it then visits only blocks that may hold something as near: by the distances from row and ring
to the pivot, by how far the cell reaches, and by the half space between its own pivot and the other. Visitors of a popular
block are dealt into parts, each of which gets the block.

Nothing is approximate: pivots decide how many pairs are compared, never which neighbours are found. On vectors without any
structure all blocks would be visited; where a look at some rows says so, pairs are compared in larger blocks instead
(``pairs.nearest_by_blocks``), so that what is shuffled does not follow their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pairs import _distances, _ids, _k_best, _matrix, nearest_by_blocks
from tessera.plans.ordered import row_numbers
from tessera.plans.scratch import Scratch, broadcast_if_small

#: Rows of a block, and visitors that meet it in one task.
BLOCK, VISITORS = 512, 4_096
#: Pivots at most; they are chosen among so many rows for each, far from one another.
PIVOTS, CANDIDATES = 256, 8
#: Rows that tell which share of the blocks has to be visited; beyond this share, all pairs are compared by larger blocks instead.
LOOKED, WORTH = 1_000, 0.2
#: Rows up to which visits are few anyway.
WORTH_FROM = 2_048
#: Bounds give way by this share, so that rounding never hides a neighbour.
SLACK = 1e-9


def finite(vector: str) -> F.Column:
    """Whether a vector has finite components only."""
    return F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """At most n rows, each the farthest from those before it."""
    chosen = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class Cells:
    """Vectors in blocks: ``rows`` has (id, v, cell, ring, far), ``blocks`` (cell, ring, n, low, high) with the range of ``far``."""

    def __init__(self, df: DataFrame, *, id_col: str, vector: str, block: int = BLOCK, pivots: int = PIVOTS):
        self.scratch = Scratch(df.sparkSession, "cells")
        rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        self.kind = rows.schema["id"].dataType.simpleString()
        self.n = n = rows.count()
        want = max(1, min(pivots, -(-n // block)))
        sample = rows.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(want * CANDIDATES).select("v").collect()
        if len({len(r.v) for r in sample}) > 1 or any(len(r.v) == 0 for r in sample):
            raise ValueError("vectors must have the same, positive length")
        self.pivots = pivot = _spread(np.array([r.v for r in sample], float), want) if n else np.zeros((0, 1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(pa.chunked_array([b.column(1)]))
                    if x.shape[1] != pivot.shape[1]:
                        raise ValueError("vectors must have the same, positive length")
                    d = _distances(x, pivot)
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=["id", "v", "cell", "far"])

        placed = rows.mapInArrow(assign, f"id {self.kind}, v array<double>, cell int, far double")
        placed = self.scratch.table(row_numbers(placed, [F.col("cell"), F.col("far"), F.xxhash64("id"), F.col("id")]), "placed")
        starts = placed.groupBy("cell").agg(F.min("rn").alias("start"))  # one row for each pivot
        within = F.col("rn") - F.col("start")
        self.rows = self.scratch.table(placed.join(F.broadcast(starts), "cell").select("id", "v", "cell", F.floor(within / block).cast("int").alias("ring"), "far", within.alias("place")), "rows")
        self.scratch.drop("placed")
        self.blocks = self.scratch.table(self.rows.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")), "blocks")
        self.n_blocks = self.blocks.count()
        self.reach = np.full(len(pivot), -np.inf)
        for r in self.blocks.groupBy("cell").agg(F.max("high").alias("reach")).collect():  # one row for each pivot
            self.reach[r.cell] = r.reach

    def visits(self, bounded: DataFrame, own: bool) -> DataFrame:
        """Rows of ``bounded(id, v, cell, ring, bound)`` for each block that may hold something within their bound: ``i, a, bound, cell, ring``.

        A row's own block is among them if ``own`` says so.
        """
        pivot, reach = self.pivots, self.reach
        apart = 2 * _distances(pivot, pivot)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, home = _matrix(pa.chunked_array([b.column(1)])), b.column(2).to_numpy()
                bound = b.column(4).to_numpy() * (1 + SLACK)
                d = _distances(x, pivot)
                slack = SLACK * (d + reach)
                with np.errstate(all="ignore"):
                    beyond = (d * d - (d[np.arange(len(d)), home] ** 2)[:, None]) / apart[home]
                far = (d - reach - slack > bound[:, None]) | (beyond - slack > bound[:, None])
                far[np.arange(len(d)), home] = False
                at, to = np.nonzero(~far)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(bound[at]), pa.array(to.astype(np.int32)), pa.array(d[at, to]), pa.array(slack[at, to])],
                    names=["i", "a", "home", "home_ring", "bound", "cell", "far", "slack"],
                )

        seen = bounded.select("id", "v", "cell", "ring", "bound").mapInArrow(look, f"i {self.kind}, a array<double>, home int, home_ring int, bound double, cell int, far double, slack double")
        met = seen.join(broadcast_if_small(self.blocks, self.n_blocks, 50_000), "cell")
        met = met.where((F.col("low") <= F.col("far") + F.col("bound") + F.col("slack")) & (F.col("high") >= F.col("far") - F.col("bound") - F.col("slack")))
        if not own:
            met = met.where((F.col("cell") != F.col("home")) | (F.col("ring") != F.col("home_ring")))
        return met.select("i", "a", "bound", "cell", "ring")

    def meet(self, visits: DataFrame, most: int | None) -> DataFrame:
        """``i, j, d`` within each visitor's bound, of each visitor and block; no more than the ``most`` nearest of them and ties, if given."""
        visits = self.scratch.table(visits, "visits")
        parts = visits.groupBy("cell", "ring").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
        parts = self.scratch.table(parts, "parts")
        side = broadcast_if_small(parts, self.n_blocks, 50_000)
        left = visits.join(side, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int"))
        right = self.rows.join(side, ["cell", "ring"]).select("cell", "ring", F.col("id").alias("j"), F.col("v").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def work(a: pa.Table, c: pa.Table) -> pa.Table:
            i, j = _ids(a["i"]), _ids(c["j"])
            if not len(i) or not len(j):
                return pa.table([i.slice(0, 0), j.slice(0, 0), pa.array([], pa.float64())], names=["i", "j", "d"])
            x, y, bound = _matrix(a["a"]), _matrix(c["c"]), a["bound"].to_numpy()[:, None]
            d = _distances(x, y)
            if most is None:  # whether a pair at just this distance is within it, its differences say
                at, to = np.nonzero(np.abs(d - bound) <= 4 * SLACK * bound)
                d[at, to] = np.sqrt(((x[at] - y[to]) ** 2).sum(1))
            keep = d <= bound
            if most is not None:
                own = np.asarray(i.to_pylist(), object)[:, None] == np.asarray(j.to_pylist(), object)[None, :]
                keep &= ~own & _k_best(np.where(own, np.inf, d), most)
            at, to = np.nonzero(keep)
            return pa.table([i.take(pa.array(at)), j.take(pa.array(to)), pa.array(d[at, to])], names=["i", "j", "d"])

        return left.groupBy("cell", "ring", "part").cogroup(right.groupBy("cell", "ring", "part")).applyInArrow(work, f"i {self.kind}, j {self.kind}, d double")


def nearest_by_cells(df: DataFrame, k: int, *, id_col: str = "id", vector: str = "v", cells: Cells | None = None) -> DataFrame:
    """``i, j, d``: at least the k nearest others of each row, and all that tie with the last; no row is its own neighbour.

    Vectors must be finite; rows with a null id or vector take no part.
    """
    cells = cells or Cells(df, id_col=id_col, vector=vector)
    scratch, kind = cells.scratch, cells.kind

    def local(t: pa.Table) -> pa.Table:
        i, x = _ids(t["id"]), _matrix(t["v"])
        d = _distances(x, x)
        names = np.asarray(i.to_pylist(), object)
        d = np.where(names[:, None] == names[None, :], np.inf, d)
        at, to = np.nonzero(_k_best(d, k) & np.isfinite(d))
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if len(i) > k else np.full(len(i), np.inf)
        # a row without j carries the bound
        every = np.arange(len(i))
        return pa.table(
            [pa.concat_arrays([i.take(pa.array(at)), i]), pa.concat_arrays([i.take(pa.array(to)), pa.nulls(len(i), i.type)]), pa.array(np.concatenate([d[at, to], last[every]]))],
            names=["i", "j", "d"],
        )

    first = scratch.table(cells.rows.select("id", "v", "cell", "ring").groupBy("cell", "ring").applyInArrow(local, f"i {kind}, j {kind}, d double"), "local")
    # k + 1 rows lie within this distance of a pivot, so k others of any row lie within that and its own distance to the pivot
    full = np.full(len(cells.pivots), np.inf)
    for r in cells.rows.where(F.col("place") == k).select("cell", "far").collect():  # one row for each pivot
        full[r.cell] = r.far
    pivot = cells.pivots

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(pa.chunked_array([b.column(1)])), pivot)
                least = np.minimum((d + full).min(axis=1) * (1 + SLACK), b.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(least)], names=["id", "v", "cell", "ring", "bound"])

    own = first.where("j IS NULL").groupBy(F.col("i").alias("id")).agg(F.min("d").alias("local"))
    bounded = cells.rows.join(own, "id").select("id", "v", "cell", "ring", "local").mapInArrow(bound, f"id {kind}, v array<double>, cell int, ring int, bound double")
    # a look at some rows decides how neighbours are found, never which
    looked = bounded.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, cells.n // LOOKED))) == 0)
    if cells.n > WORTH_FROM and cells.visits(looked, own=False).count() > WORTH * cells.n_blocks * looked.count():
        return nearest_by_blocks(cells.rows, k)
    visits = cells.visits(bounded, own=False)
    return first.where("j IS NOT NULL").unionByName(cells.meet(visits, k))


def within_by_cells(df: DataFrame, eps: float, *, id_col: str = "id", vector: str = "v", cells: Cells | None = None) -> DataFrame:
    """``i, j``: ordered pairs at Euclidean distance of at most ``eps``, i itself included."""
    cells = cells or Cells(df, id_col=id_col, vector=vector)
    return cells.meet(cells.visits(cells.rows.withColumn("bound", F.lit(float(eps))), own=True), None).select("i", "j", "d").where(F.col("d") <= eps).select("i", "j")
