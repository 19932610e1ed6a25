"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample: the graph of each vector's nearest neighbours is cut into balanced parts with few edges across, and
a small classifier (one hidden layer) learns which parts a vector's neighbours lie in. How many parts a query must look
into is measured on queries that were held out of the graph.

Indexing: every vector of the table is put into its most probable part. Searching: a query goes to its several most probable
parts; there, blocks of bounded size are scored, and the best are ranked by their exact cosine.

Equal vectors are one entry with its smallest ids, of which a result can need no more than it has ranks (and one for
the query itself), so a very common vector costs one row.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no part; vectors of
different lengths are not compared; with fewer candidates than ranks all are returned; ties go to smaller ids; rows that repeat an id are one candidate for each different vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._vectors import as_bytes, cosines, element_type, matrix, unit
from tessera.plans.scratch import Scratch, broadcast_if_small

#: Distinct vectors the index is fitted on at most, and those of them that measure recall.
SAMPLE, HELD = 12_000, 400
#: Vectors per part aimed at, and bounds on the number of parts.
PER_PART, LEAST_PARTS, MOST_PARTS = 2_048, 8, 256
#: Neighbours in the graph, sweeps of its refinement, and how far a part may exceed its share.
DEGREE, SWEEPS, SLACK = 10, 6, 1.05
#: Hidden units, passes over the sample.
HIDDEN, EPOCHS = 128, 25
#: Recall on held-out queries that decides how many parts are looked into.
AIM = 0.96
#: Entries of a block at most, queries scored at once, and exact cosines taken at once.
BLOCK, AT_ONCE, PAIRS = 8_192, 256, 16_384


@dataclass
class Router:
    """The classifier, and how many of its most probable parts a query looks into."""

    parts: int = 1
    probes: int = 1
    layers: list[np.ndarray] = field(default_factory=list)

    def scores(self, units: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(units), 1))
        w1, b1, w2, b2 = self.layers
        return np.maximum(units @ w1 + b1, 0) @ w2 + b2

    def route(self, units: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of each vector, best first."""
        return np.argsort(-self.scores(units), axis=1, kind="stable")[:, :probes]


def neighbours(units: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of ``units`` to each row of ``of`` (unordered)."""
    out = np.empty((len(of), k), np.int32)
    base = units.astype(np.float32)
    for lo in range(0, len(of), 512):
        near = of[lo : lo + 512].astype(np.float32) @ base.T
        out[lo : lo + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _halves(units: np.ndarray, at: np.ndarray, parts: int, first: int, out: np.ndarray, rng: np.random.Generator) -> None:
    """Split rows by the median along a direction of wide spread, recursively, into equal shares."""
    if parts == 1:
        out[at] = first
        return
    left = parts // 2
    x = units[at]
    direction = rng.standard_normal(x.shape[1])
    centred = x - x.mean(0)
    for _ in range(6):  # towards the principal direction
        direction = centred.T @ (centred @ direction)
        direction /= np.linalg.norm(direction) + 1e-12
    order = at[np.argsort(centred @ direction, kind="stable")]
    cut = len(at) * left // parts
    _halves(units, order[:cut], left, first, out, rng)
    _halves(units, order[cut:], parts - left, first + left, out, rng)


def balanced_partition(units: np.ndarray, graph: np.ndarray, parts: int, *, slack: float = SLACK, sweeps: int = SWEEPS, seed: int = 5) -> np.ndarray:
    """Part of each node: equal shares at first, then moves to where most neighbours are, within ``slack`` of a share."""
    n = len(units)
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    _halves(units, np.arange(n), parts, 0, part, rng)
    most = int(np.ceil(slack * n / parts))
    # edges count in both directions
    src = np.repeat(np.arange(n), graph.shape[1])
    both = np.concatenate([np.stack([src, graph.ravel()]), np.stack([graph.ravel(), src])], 1)
    both = both[:, np.argsort(both[0], kind="stable")]
    start = np.searchsorted(both[0], np.arange(n + 1))
    size = np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(n).tolist():
            here = np.bincount(part[both[1, start[v] : start[v + 1]]], minlength=parts)
            own = part[v]
            here[size >= most] = -1
            here[own] = max(here[own], 0)
            best = int(here.argmax())
            if best != own and here[best] > np.count_nonzero(part[both[1, start[v] : start[v + 1]]] == own):
                size[own] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def _learn(units: np.ndarray, target: np.ndarray, *, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 3) -> list[np.ndarray]:
    """A one-hidden-layer softmax classifier of target distributions, by Adam."""
    rng = np.random.default_rng(seed)
    n, d = units.shape
    parts = target.shape[1]
    layers = [rng.standard_normal((d, hidden)) * np.sqrt(2.0), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0002
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            x, y = units[order[lo : lo + 256]], target[order[lo : lo + 256]]
            z = x @ layers[0] + layers[1]
            h = np.maximum(z, 0)
            s = h @ layers[2] + layers[3]
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - y) / len(x)
            gh = (g @ layers[2].T) * (z > 0)
            t += 1
            for k, grad in enumerate((x.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                layers[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit(units: np.ndarray, parts: int, k: int, *, aim: float = AIM, held: int = HELD, seed: int = 1) -> Router:
    """Fit on sampled unit vectors (rows)."""
    if parts == 1 or len(units) < 4 * parts:
        return Router()
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(units))
    held = min(held, len(units) // 5)
    queries, base = units[order[:held]], units[order[held:]]
    degree = min(DEGREE, len(base) - 1)
    graph = neighbours(base, base, degree + 1)
    part = balanced_partition(base, graph, parts)
    target = np.zeros((len(base), parts))
    np.add.at(target, (np.repeat(np.arange(len(base)), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    router = Router(parts, parts, _learn(base, target))
    near = neighbours(base, queries, min(k, len(base)))
    home = router.route(base, 1)[:, 0]
    ranked = router.route(queries, parts)
    place = np.argsort(ranked, axis=1)  # place[q, p]: how many parts come before p
    needed = np.sort(place[np.arange(held)[:, None], home[near]].ravel())
    router.probes = min(parts, int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) + 1)
    return router


def search(df: DataFrame, is_query: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", aim: float = AIM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found to each row that ``is_query`` (a condition on ``vec_id``) selects.

    Candidates are all rows but the query's own id.
    """
    spark, dtype = df.sparkSession, element_type(df, vector)
    kind = df.schema[vec_id].dataType.simpleString()
    scratch = Scratch(spark, "ann")
    base = scratch.table(as_bytes(df, vec_id, vector).where("node is not null"), "vectors")
    # the least ids of each distinct vector; the rank limit is applied before rows are shuffled
    ranked = base.select("node", "vec_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = ranked.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = base.groupBy("node").agg(F.any_value("vec").alias("vec")).join(ids, "node")
    entries = scratch.table(entries, "entries")
    n, sizes = entries.agg(F.count(F.lit(1)), F.collect_set(F.length("vec"))).first()
    # one router for each length of vectors
    routers: dict[int, Router] = {}
    for size in sizes:
        of = entries.where(F.length("vec") == size)
        m = n if len(sizes) == 1 else of.count()
        draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
        sample = sorted(bytes(r[0]) for r in of.where(draw < min(1.0, SAMPLE / m)).select("vec").collect())
        routers[size] = fit(unit(matrix(sample, dtype)), int(min(MOST_PARTS, max(LEAST_PARTS, round(m / PER_PART)))), k, aim=aim)
    shared = spark.sparkContext.broadcast(routers)

    def routed(probing: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column("vec").to_pylist()
                for size in sorted({len(x) for x in raw}):
                    at = np.array([i for i, x in enumerate(raw) if len(x) == size])
                    router = shared.value[size]
                    parts = router.route(unit(matrix([raw[i] for i in at], dtype)), router.probes if probing else 1)
                    rows = pa.array(np.repeat(at, parts.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(size * 1000 + parts.ravel()), *(c.take(rows) for c in batch.columns)], ["part", *batch.schema.names])

        return run

    index = scratch.table(entries.mapInArrow(routed(False), f"part long, node binary, vec binary, ids array<{kind}>"), "index")
    blocks = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # as many rows as parts
    asked = base.where(is_query).select("vec_id", "node").distinct()
    asked = scratch.table(asked, "asked")
    questions = entries.join(asked.select("node").distinct(), "node", "left_semi").select("node", "vec").mapInArrow(routed(True), "part long, node binary, vec binary")
    no_ids = F.lit(None).cast(f"array<{kind}>")
    members = index.join(F.broadcast(blocks), "part").select("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("query"), "node", "vec", "ids")
    askers = questions.join(F.broadcast(blocks), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("query"), "node", "vec", no_ids.alias("ids"))
    dealt = members.unionByName(askers).repartition("part", "block").sortWithinPartitions("part", "block", "query", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, raws, owners = None, [], []
        block = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            vecs, node_col, ids_col = batch.column(4).to_pylist(), batch.column(3).to_pylist(), batch.column(5)
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo][:2] != current:
                    current, raws, owners, block = keys[lo][:2], [], [], None
                if not keys[lo][2]:
                    raws += vecs[lo:hi]
                    owners += ids_col.slice(lo, hi - lo).to_pylist()
                elif raws:
                    if block is None:
                        block = matrix(raws, dtype)
                    for a in range(lo, hi, AT_ONCE):
                        b = min(hi, a + AT_ONCE)
                        yield _best(node_col[a:b], matrix(vecs[a:b], dtype), block, owners, k + 1, batch.schema.field("ids").type.value_type)
                lo = hi

    found = dealt.mapInArrow(run, f"node binary, vec_id {kind}, score double")
    nearest = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    found = scratch.table(found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).select("node", "vec_id", "score"), "found")
    pairs = asked.withColumnRenamed("vec_id", "query_id").join(broadcast_if_small(found, asked.count() * (k + 1), 200_000), "node").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(nodes: list[bytes], queries: np.ndarray, block: np.ndarray, owners: list[list], k: int, id_type: pa.DataType) -> pa.RecordBatch:
    """The k best ids of a block for each query, by exact cosine and id; all that may reach the k-th best score are scored."""
    near = unit(queries) @ unit(block).T
    m = min(len(block), k)
    least = np.partition(near, len(block) - m, axis=1)[:, len(block) - m]
    # rough and exact cosines differ by rounding only, so nothing below the margin can be among the k best
    margin = 4 * (block.shape[1] + 16) * np.finfo(np.float64).eps
    of, at = np.nonzero(near >= (least - margin)[:, None])
    score = np.concatenate([np.zeros(0), *(cosines(queries[of[a : a + PAIRS]], block[at[a : a + PAIRS]]) for a in range(0, len(of), PAIRS))])
    first = np.searchsorted(of, np.arange(len(queries) + 1))
    out_node, out_id, out_score = [], [], []
    for node, lo, hi in zip(nodes, first[:-1].tolist(), first[1:].tolist(), strict=True):
        s = score[lo:hi]
        enough = np.flatnonzero(s >= np.partition(s, len(s) - m)[len(s) - m])
        rows = sorted((-x, i) for j, x in zip(at[lo:hi][enough].tolist(), s[enough].tolist(), strict=True) for i in owners[j])[:k]
        out_node += [node] * len(rows)
        out_id += [i for _, i in rows]
        out_score += [-x for x, _ in rows]
    return pa.RecordBatch.from_arrays([pa.array(out_node, pa.binary()), pa.array(out_id, id_type), pa.array(out_score, pa.float64())], ["node", "vec_id", "score"])
