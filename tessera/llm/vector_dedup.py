"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Unit vectors with cosine t are ``s = sqrt(2 - 2 t)`` apart, and so is, up to a normal factor, their difference on any
random projection. A pool of projections is drawn; a pair *collides* on one if its values differ by at most ``width``.
The number of collisions over the pool tells near pairs from far ones, and a pair is verified by its
exact cosine if it reaches a count that is calibrated so that nearly all pairs at the threshold reach it.

To find the pairs that are worth counting, several sorted lists are kept. Each takes a few projections of the pool: all but one
are cut into wide cells, which split the list into independent blocks, and by the remaining one the block is sorted; a vector's
partners are those in the window around its own value. How many lists and projections follow from the number
of vectors and from the recall wanted, by simulating pairs at the threshold.

Equal vectors are one node with a weight. A pair is counted in the first list that finds it, so each list's tasks return
sums of links and a spanning forest, never the pairs; a group of f near copies costs f rows there. Blocks that
are large are dealt into chunks, each of which meets the others' rows as a stream.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component; vectors
of different lengths do not link; repeated rows are links of each other; rows with a null vec_id have no component and no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import mix, signed
from tessera.llm._vectors import as_bytes, cosines, element_type, matrix, unit
from tessera.operators.components import connected_components
from tessera.plans.scratch import Scratch, broadcast_if_small

#: Projections in the pool, and the share of pairs at the threshold that must be found.
POOL, RECALL = 48, 0.985
#: Cell width, sorted window and collision width, each in units of the distance at the threshold.
CELL, WINDOW, WIDTH = 4.0, 2.5, 1.5
#: Vectors that a block should hold by chance, and members of a chunk at most.
BY_CHANCE, CHUNK = 48, 1024
#: Pairs compared in one vectorised pass.
PAIRS = 1 << 17


@dataclass
class Lists:
    """Directions per dimension are drawn on demand; the lists' projections, offsets and counts are shared."""

    threshold: float
    seed: int
    picks: np.ndarray  # list x projection, the last one sorted
    shifts: np.ndarray  # list x cell projection, in cells
    least: int  # collisions a pair must reach

    @property
    def apart(self) -> float:
        return sqrt(max(2 - 2 * self.threshold, 1e-6))

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Pool projections of unit vectors in 64ths of the distance at the threshold."""
        d = vectors.shape[1]
        rng = np.random.default_rng([self.seed, d])
        directions = rng.standard_normal((d, POOL))
        return np.rint(vectors @ directions * (64 / self.apart)).astype(np.int32)

    def cells(self, pool: np.ndarray, d: int) -> np.ndarray:
        """Block key of each vector (row) in each list (column)."""
        out = np.empty((len(pool), len(self.picks)), np.uint64)
        wide = int(CELL * 64)
        for t, (pick, shift) in enumerate(zip(self.picks, self.shifts, strict=True)):
            key = np.full(len(pool), (t << 32) + d, np.uint64)
            for c, s in zip(pick[:-1].tolist(), shift.tolist(), strict=True):
                key = mix(key * np.uint64(3) + ((pool[:, c] + int(s * wide)) // wide).astype(np.int64).view(np.uint64))
            out[:, t] = mix(key)
        return out

    def near(self, pool: np.ndarray, t: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs are within the sorted window of a list."""
        lead = pool[:, self.picks[t, -1]]
        return np.abs(lead[i] - lead[j]) <= int(WINDOW * 64)


def _same_cell(width: float, sd: float) -> float:
    """Chance that two values whose difference is normal with ``sd`` share a cell of ``width`` with random borders."""
    z = width / sd
    return erf(z / sqrt(2)) - 2 / z * (1 / sqrt(2 * pi)) * (1 - exp(-z * z / 2))


def calibrate(n: int, threshold: float, *, recall: float = RECALL, seed: int = 11, dimension: int = 64) -> Lists:
    """Lists for about ``n`` vectors; recall is checked on simulated pairs at the threshold and lists are added until it holds."""
    rng = np.random.default_rng(seed)
    apart = sqrt(max(2 - 2 * threshold, 1e-6))
    far = _same_cell(CELL * apart, sqrt(2))
    deep = int(min(12, max(2, ceil(log(max(n / BY_CHANCE, 1.01)) / -log(far)))))
    one = _same_cell(CELL, 1) ** deep * erf(WINDOW / sqrt(2))
    count = ceil(log(1 - recall) / log(1 - one))
    pairs, d = 6000, max(dimension, 2)
    a = unit(rng.standard_normal((pairs, d)))
    b = rng.standard_normal((pairs, d))
    b = unit(b - np.einsum("ij,ij->i", a, b)[:, None] * a)
    b = unit(threshold * a + sqrt(1 - threshold**2) * b)
    while True:
        picks = np.stack([rng.permutation(POOL)[: deep + 1] for _ in range(count)])
        lists = Lists(threshold, seed, picks, rng.random((count, deep)), 0)
        p, q = lists.project(a), lists.project(b)
        both = np.concatenate([p, q])
        i, j = np.arange(pairs), np.arange(pairs) + pairs
        met = (lists.cells(p, d) == lists.cells(q, d)) & np.stack([lists.near(both, t, i, j) for t in range(count)], 1)
        hits = np.sort((np.abs(p - q) <= int(WIDTH * 64)).sum(1))
        lists.least = int(hits[int(0.002 * pairs)])  # all but 2 in 1000 reach it
        if met.any(1).mean() >= recall:
            return lists
        count += max(1, count // 8)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of n nodes by pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class _Rows:
    """Rows of a stream as arrays, all of one dimension."""

    FIELDS = ("block", "query", "cross", "list", "size", "raw", "pool", "cells")

    @classmethod
    def of(cls, batch: pa.RecordBatch, lists: Lists, dtype: np.dtype) -> _Rows:
        out = cls()
        out.block, out.list, out.size = (batch.column(c).to_numpy() for c in ("block", "list", "size"))
        out.query, out.cross = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("query", "cross"))
        out.names = np.array(batch.column("node").to_pylist(), object)
        out.raw = matrix(batch.column("vec").to_pylist(), dtype)
        out.pool = lists.project(unit(out.raw))
        out.cells = lists.cells(out.pool, out.raw.shape[1])
        return out

    def slice(self, lo: int, hi: int) -> _Rows:
        out = _Rows()
        for name in (*self.FIELDS, "names"):
            setattr(out, name, getattr(self, name)[lo:hi])
        return out

    def join(self, other: _Rows) -> _Rows:
        out = _Rows()
        for name in (*self.FIELDS, "names"):
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        return out


def _pairs(rows: _Rows, lists: Lists) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within sorted windows: a chunk's members with each other, and in cross blocks its members with another chunk's."""
    lead = rows.pool[np.arange(len(rows.list)), lists.picks[rows.list, -1]]
    _, block = np.unique(rows.block, return_inverse=True)
    reach = int(WINDOW * 64)
    at = (block.astype(np.int64) << 32) + lead + (1 << 28)
    order = np.argsort(at, kind="stable")
    members = order[~rows.query[order]]
    sorted_at = at[members]
    alone = np.flatnonzero(~rows.cross[members])  # only these meet members of their own chunk
    asking = np.concatenate([members[alone], np.flatnonzero(rows.query)])
    lo = np.concatenate([alone + 1, np.searchsorted(sorted_at, at[asking[len(alone) :]] - reach)])
    n = np.maximum(0, np.searchsorted(sorted_at, at[asking] + reach, "right") - lo)
    total, done = np.cumsum(n), 0
    while done < len(asking):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
        m = n[done:upto]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(asking[done:upto], m), members[np.repeat(lo[done:upto], m) + step]
        done = upto


def _links(rows: _Rows, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs that no earlier list finds."""
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    pool = np.ascontiguousarray(rows.pool.T)
    reach = int(WIDTH * 64)
    for i, j in _pairs(rows, lists):
        hits = np.zeros(len(i), np.int16)
        for c in range(POOL):
            hits += np.abs(pool[c][i] - pool[c][j]) <= reach
            if c + 1 in (POOL // 2, 2 * POOL // 3, POOL):  # what cannot reach the count any more goes
                keep = hits >= lists.least - (POOL - 1 - c)
                i, j, hits = i[keep], j[keep], hits[keep]
        t_of = rows.list[i]
        for t in range(int(t_of.max()) if len(i) else 0):
            seen = (t < t_of) & (rows.cells[i, t] == rows.cells[j, t])
            if seen.any():
                seen[seen] = lists.near(rows.pool, t, i[seen], j[seen])
                i, j, t_of = i[~seen], j[~seen], t_of[~seen]
        ok = cosines(rows.raw[i], rows.raw[j]) >= lists.threshold
        out_i.append(i[ok])
        out_j.append(j[ok])
    return np.concatenate(out_i), np.concatenate(out_j)


def _sums(rows: _Rows, lists: Lists) -> pa.RecordBatch:
    """Per node of complete blocks: the sizes of the nodes linked with it, and one node of its part of the forest."""
    i, j = _links(rows, lists)
    names, node = np.unique(rows.names, return_inverse=True)
    a, b = node[i], node[j]
    total = np.bincount(a, rows.size[j], len(names)) + np.bincount(b, rows.size[i], len(names))
    label = _forest(a, b, len(names))
    on = np.flatnonzero(total > 0)
    return pa.RecordBatch.from_arrays([pa.array(names[on].tolist(), pa.binary()), pa.array(total[on].astype(np.int64)), pa.array(names[label[on]].tolist(), pa.binary())], ["node", "links", "label"])


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the vectors' length changes."""
    for batch in batches:
        size = np.array([len(x) for x in batch.column("vec").to_pylist()])
        lo = 0
        for hi in [*(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]:
            if hi > lo:
                yield batch.slice(lo, hi - lo)
            lo = hi


def _spread(nodes: DataFrame, lists: Lists, dtype: np.dtype, light: bool) -> DataFrame:
    """Each node once for each list: ``block, list, lead`` and, unless ``light``, ``node, size, vec``."""
    shared = nodes.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conf = shared.value
        count = len(conf.picks)
        for batch in batches:
            raw = batch.column(2).to_pylist()
            for size in sorted({len(x) for x in raw}):
                at = np.array([k for k, x in enumerate(raw) if len(x) == size])
                pool = conf.project(unit(matrix([raw[k] for k in at], dtype)))
                cells = signed(conf.cells(pool, size // dtype.itemsize))
                columns = [pa.array(cells.ravel()), pa.array(np.tile(np.arange(count, dtype=np.int32), len(at)))]
                names = ["block", "list"]
                if not light:
                    rows = pa.array(np.repeat(at, count))
                    columns += [pa.array(pool[:, conf.picks[:, -1]].ravel()), *(batch.column(c).take(rows) for c in (0, 1, 2))]
                    names += ["lead", "node", "size", "vec"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "block long, list int" + ("" if light else ", lead int, node binary, size long, vec binary")
    return nodes.select("node", "size", "vec").mapInArrow(run, schema)


def near_duplicates(df: DataFrame, *, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``."""
    spark, dtype = df.sparkSession, element_type(df, vector)
    scratch = Scratch(spark, "vector-dedup")
    base = scratch.table(as_bytes(df, vec_id, vector), "vectors")
    nodes = base.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first"), F.any_value("vec").alias("vec"))
    nodes = scratch.table(nodes, "nodes")
    n, longest = nodes.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    lists = calibrate(n, threshold, recall=recall, dimension=(longest or 8) // dtype.itemsize)
    hot = _spread(nodes, lists, dtype, True).groupBy("block").count().where(F.col("count") > CHUNK).select("block", F.ceil(F.col("count") / CHUNK).alias("chunks"))
    hot = scratch.table(hot, "hot")
    rows = _spread(nodes, lists, dtype, False).join(broadcast_if_small(hot, hot.count(), 200_000), "block", "left")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int"))
    # chunk pairs (a, b) are blocks of their own: members of a, asked by the rows of b; (a, a) are its members alone
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.coalesce("chunks", F.lit(1)) - 1).cast("int"))))
    block = F.when(F.col("chunks").isNull(), F.col("block")).otherwise(F.xxhash64("block", F.least("chunk", "other"), F.greatest("chunk", "other")))
    rows = rows.select(block.alias("block"), (F.col("other") < F.col("chunk")).alias("query"), (F.col("other") != F.col("chunk")).alias("cross"), "list", "node", "size", "vec", F.length("vec").alias("bytes"))
    dealt = rows.repartition("block").sortWithinPartitions("bytes", "block").drop("bytes")
    shared = spark.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conf, held = shared.value, None
        for batch in _by_length(batches):
            rows = _Rows.of(batch, conf, dtype)
            if held is not None and held.raw.shape[1] == rows.raw.shape[1]:
                rows = held.join(rows)
            elif held is not None:
                yield _sums(held, conf)
            last = int(np.flatnonzero(rows.block != rows.block[-1]).max(initial=-1)) + 1  # the last block may go on
            if last:
                yield _sums(rows.slice(0, last), conf)
            held = rows.slice(last, len(rows.block))
        if held is not None:
            yield _sums(held, conf)

    found = scratch.table(dealt.mapInArrow(run, "node binary, links long, label binary"), "links")
    parts = connected_components(found.select("node", "label"), "node", "label").withColumnRenamed("node", "member")
    named = nodes.select("node", "size", "first").join(parts, F.col("node") == F.col("member"), "left").select("node", "size", "first", F.coalesce("component", "node").alias("component"))
    named = named.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), "component_id")
    out = base.select("vec_id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
