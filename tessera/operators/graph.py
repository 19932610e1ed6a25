"""Graphs as tables: ``nodes(id, features array<double>)`` and ``edges(src, dst, weight)``.

Message passing is a join on the source and an aggregate per target; both pre-aggregate and shuffle by node, so hubs are sums, not lists.
Dense layers multiply a node's vector by a small matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.draws import index, uniform
from tessera.plans.ordered import row_numbers
from tessera.plans.scratch import Scratch


@dataclass(frozen=True)
class Graph:
    """``nodes(id, features, ...)`` and ``edges(src, dst, weight)``."""

    nodes: DataFrame
    edges: DataFrame


def from_edge_list(spark: SparkSession, edges: Sequence[tuple[int, int]], num_nodes: int) -> Graph:
    """A graph with nodes 0 to ``num_nodes - 1`` and unit weights."""
    table = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in edges], "src long, dst long, weight double")
    return Graph(spark.range(num_nodes), table)


def from_adjacency_matrix(matrix: DataFrame, *, id_col: str = "id", row: str = "row") -> Graph:
    """A graph from rows of a dense matrix; each non-zero entry is an edge with that weight."""
    edges = matrix.select(F.col(id_col).cast("long").alias("src"), F.posexplode(F.col(row)).alias("dst", "weight"))
    return Graph(matrix.select(F.col(id_col).cast("long").alias("id")), edges.where("weight <> 0").select("src", F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")))


def degrees(graph: Graph) -> DataFrame:
    """``id, in_degree, out_degree`` of every node."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return graph.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


#: Edges that one task joins, about, and components up to which vectors are added as columns.
EDGES, COLUMNS = 500_000, 64


def _size(nodes: DataFrame, features: str) -> int:
    """Components of a node's vector; 1 without nodes."""
    one = nodes.where(F.col(features).isNotNull()).select(F.size(features)).first()
    return one[0] if one else 1


def _sum_vectors(rows: DataFrame, key: str, vector: Column, average: bool = False, size: int | None = None) -> DataFrame:
    """Per key the component-wise sum (or mean) of vectors. If they are known to have a small ``size``, a key is one row of sums throughout."""
    fold = F.avg if average else F.sum
    if size is not None and 0 < size <= COLUMNS:
        whole = F.when(F.size("m") == size, F.col("m")).otherwise(F.raise_error(F.lit("vectors must have the same, positive length")))
        one = rows.select(key, vector.alias("m")).where("m IS NOT NULL").select(key, whole.alias("m")).groupBy(key).agg(*(fold(F.col("m")[d]).alias(f"x{d}") for d in range(size)))
        return one.select(key, F.array(*(f"x{d}" for d in range(size))).alias("v"))
    parts = rows.select(key, F.posexplode(vector).alias("d", "x")).groupBy(key, "d").agg(fold("x").alias("x"))
    return parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("s")).select(key, F.col("s.x").alias("v"))


def _scaled(v: Column, w: Column) -> Column:
    return F.transform(v, lambda x: x * w)


def _normalised(graph: Graph, parts: int | None = None) -> DataFrame:
    """``src, dst, weight`` of edges and loops (of weight 1), over the roots of both ends' degrees; ``parts`` tasks join them, if said.

    Joins are merged: degrees grow with the graph, and Spark would judge by compressed files that they can be broadcast.
    """
    loops = graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    edges = graph.edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight")).where("src <> dst").unionByName(loops)
    degree = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("deg"))
    scale = degree.select("id", F.when(F.col("deg") > 0, 1 / F.sqrt("deg")).otherwise(0.0).alias("s"))
    one, two = (scale.select(F.col("id").alias(end), F.col("s").alias(f"{end}_s")).hint("merge") for end in ("src", "dst"))
    dealt = lambda d, end: d.repartition(parts, end) if parts else d
    return dealt(dealt(edges, "src").join(one, "src"), "dst").join(two, "dst").select("src", "dst", (F.col("weight") * F.col("src_s") * F.col("dst_s")).alias("weight"))


def _propagated(edges: DataFrame, nodes: DataFrame, features: str, size: int, parts: int | None = None) -> DataFrame:
    """``id, v``: per target the sum of its sources' vectors times the edges' weights; ``parts`` tasks join them, if said."""
    x = nodes.select(F.col("id").alias("src"), F.col(features).alias("x")).where("x IS NOT NULL")
    rows = (edges.repartition(parts, "src") if parts else edges).join(x.hint("merge"), "src")
    return _sum_vectors(rows, "dst", _scaled(F.col("x"), F.col("weight")), size=size).withColumnRenamed("dst", "id")


def gcn_propagate(graph: Graph, features: str = "features") -> DataFrame:
    """``id, v``: symmetric normalised sum over neighbours and the node itself (weights count; self weight 1)."""
    return _propagated(_normalised(graph), graph.nodes, features, _size(graph.nodes, features))


def sage_propagate(graph: Graph, features: str = "features") -> DataFrame:
    """``id, own, v``: a node's vector and the mean of its in-neighbours' (zeros without any)."""
    sent = graph.nodes.select(F.col("id").alias("src"), F.col(features).alias("x"))
    mean = _sum_vectors(graph.edges.join(sent, "src"), "dst", F.col("x"), True, _size(graph.nodes, features)).withColumnRenamed("dst", "id")
    own = graph.nodes.select("id", F.col(features).alias("own"))
    return own.join(mean, "id", "left").select("id", "own", F.coalesce("v", F.transform("own", lambda x: x * 0.0)).alias("v"))


def gat_propagate(graph: Graph, attention: Sequence[float], slope: float = 0.2, features: str = "features") -> DataFrame:
    """``id, v``: attention-weighted sum over in-neighbours and the node itself.

    An edge's score is ``attention . leaky_relu(x_src + x_dst)``; scores become weights by a softmax per target, from two
    aggregates (greatest score, then sums), so a hub's edges are never in one list.
    """
    loops = graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    x = graph.nodes.select("id", F.col(features).alias("x"))
    edges = graph.edges.select("src", "dst").where("src <> dst").unionByName(loops)
    rows = edges.join(x.withColumnRenamed("id", "src"), "src").join(x.select(F.col("id").alias("dst"), F.col("x").alias("y")), "dst")
    a = F.array(*(F.lit(float(w)) for w in attention))
    score = V.dot(a, F.zip_with("x", "y", lambda p, q: F.when(p + q > 0, p + q).otherwise(slope * (p + q))))
    rows = rows.withColumn("e", score)
    top = rows.groupBy("dst").agg(F.max("e").alias("top"))
    rows = rows.join(top, "dst").withColumn("w", F.exp(F.col("e") - F.col("top")))
    total = rows.groupBy("dst").agg(F.sum("w").alias("t"))
    out = _sum_vectors(rows.select("dst", _scaled(F.col("x"), F.col("w")).alias("m")), "dst", F.col("m"), size=_size(graph.nodes, features)).join(total, "dst")
    return out.select(F.col("dst").alias("id"), _scaled(F.col("v"), 1 / F.col("t")).alias("v"))


def dense(vector: Column, weights: np.ndarray, bias: np.ndarray | None = None, activation: str = "none") -> Column:
    """A small dense layer on a vector column."""
    rows = [F.array(*(F.lit(float(x)) for x in w)) for w in np.asarray(weights, float).T]
    out = F.array(*(V.dot(vector, r) + float(bias[i] if bias is not None else 0.0) for i, r in enumerate(rows)))
    if activation == "relu":
        return F.transform(out, lambda x: F.greatest(x, F.lit(0.0)))
    if activation == "elu":
        return F.transform(out, lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1))
    return out


def gcn(graph: Graph, layers: Sequence[tuple[np.ndarray, np.ndarray | None]], features: str = "features") -> DataFrame:
    """``id, v``: inference of stacked GCN layers with ReLU between them.

    Edges are scaled once and written; a layer joins them by bounded parts with its vectors and adds up one row of sums for each target.
    """
    scratch = Scratch(graph.edges.sparkSession, "gcn")
    now = scratch.table(graph.nodes.select("id", F.col(features).alias("features")), "nodes")
    n = now.count()
    parts = max(1, -(-(graph.edges.count() + n) // EDGES))
    edges = scratch.table(_normalised(Graph(now, graph.edges), parts), "edges")
    for k, (w, b) in enumerate(layers):
        moved = _propagated(edges, now, "features", len(w), parts)
        now = scratch.table(moved.select("id", dense(F.col("v"), w, b, "relu" if k + 1 < len(layers) else "none").alias("features")), f"layer{k}")
        if k + 1 < len(layers) and now.count() != n:  # targets that were no nodes have become some, with loops
            edges, n = scratch.table(_normalised(Graph(now, graph.edges), parts), f"edges{k}"), now.count()
    return now.select("id", F.col("features").alias("v"))


def graph_sage(graph: Graph, layers: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray | None]], features: str = "features") -> DataFrame:
    """``id, v``: inference of GraphSAGE layers (own weights, neighbour weights, bias) with ReLU between them."""
    scratch = Scratch(graph.edges.sparkSession, "sage")
    now = graph.nodes.select("id", F.col(features).alias("features"))
    for k, (own, around, b) in enumerate(layers):
        p = sage_propagate(Graph(now, graph.edges))
        v = F.zip_with(dense(F.col("own"), own), dense(F.col("v"), around, b), lambda x, y: x + y)
        now = scratch.table(p.select("id", (F.transform(v, lambda x: F.greatest(x, F.lit(0.0))) if k + 1 < len(layers) else v).alias("features")), f"layer{k}")
    return now.select("id", F.col("features").alias("v"))


def _numbered(graph: Graph, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``src, dst, k``: out-edges numbered from 0 by dst, and ``src, deg``.

    Numbers come from running counts over ranges of (src, dst), so the edges of a hub are numbered in many tasks. Both carry a
    hint to be merged: they grow with the graph, and Spark would judge by their compressed files that they can be broadcast.
    """
    placed = scratch.table(row_numbers(graph.edges.select("src", "dst"), [F.col("src"), F.col("dst")]), "placed")
    sizes = scratch.table(placed.groupBy("src").agg(F.count(F.lit(1)).alias("deg"), F.min("rn").alias("first")), "sizes")
    out = scratch.table(placed.join(sizes.hint("merge"), "src").select("src", "dst", (F.col("rn") - F.col("first")).alias("k")), "out")
    return out.hint("merge"), sizes.select("src", "deg").hint("merge")


def random_walks(graph: Graph, *, walk_length: int = 80, num_walks: int = 10, seed: int = 0) -> DataFrame:
    """``id, walk, path``: uniform walks from every node; a walk ends early where no edge leaves.

    Each step joins the walks' ends with numbered out-edges on (node, drawn number), so no adjacency list is gathered. Repeated
    edges are drawn in proportion.
    """
    scratch = Scratch(graph.edges.sparkSession, "walks")
    out, sizes = _numbered(graph, scratch)
    now = graph.nodes.select("id").withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1)))).select("id", "walk", F.col("id").alias("at"), F.array("id").alias("path"))
    for step in range(1, walk_length):
        drawn = now.join(sizes, F.col("at") == F.col("src"), "left").withColumn("pick", index(F.col("deg"), seed, f"walk{step}", F.col("id"), F.col("walk"))).drop("src")
        moved = drawn.join(out, (F.col("at") == out.src) & (F.col("pick") == out.k), "left")
        now = moved.select("id", "walk", F.col("dst").alias("at"), F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"))
        if step % 8 == 0:
            now = scratch.table(now, f"step{step}")
    return now.select("id", "walk", "path")


#: Proposals that one round makes for each walk, and after how many the step is drawn from all edges instead.
PROPOSALS, PATIENCE = 4, 16


def biased_walks(graph: Graph, *, walk_length: int = 20, num_walks: int = 5, p: float = 1.0, q: float = 1.0, seed: int = 0, proposals: int = PROPOSALS, patience: int = PATIENCE) -> DataFrame:
    """``id, walk, path``: second-order walks. An edge from the present node weighs 1/p if it leads back to the node before, 1 if
    that node has an edge to where it leads, else 1/q; a walk ends early where no edge leaves.

    A step is drawn by rejection: an edge is proposed uniformly, by a join on (node, drawn number), and accepted in proportion to its
    weight, which a join on (node before, proposed node) tells. Walks advance on their own, a few proposals each round; what is not
    accepted in ``patience`` proposals is drawn exactly: of all edges of the node, that with the least ``-ln(u) / weight``, a minimum
    that is taken map-side. No adjacency list is gathered or sent around, and repeated edges are drawn in proportion. The node's
    return edge is looked up first, as without one its great weight would only delay acceptance.
    """
    if p <= 0 or q <= 0:
        raise ValueError("p and q must be positive")
    if walk_length < 1 or num_walks < 1:
        raise ValueError("walks need a length and a number")
    spark = graph.edges.sparkSession
    scratch = Scratch(spark, "biased-walks")
    out, sizes = _numbered(graph, scratch)
    known = scratch.table(graph.edges.select(F.col("src").alias("ks"), F.col("dst").alias("kd")).where("ks IS NOT NULL AND kd IS NOT NULL").distinct(), "known").hint("merge")
    starts = graph.nodes.select("id").withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
    kind = graph.edges.schema["dst"].dataType
    now = starts.select("id", "walk", F.lit(0).alias("pos"), F.lit(None).cast(kind).alias("prev"), F.col("id").cast(kind).alias("at"), F.lit(0).alias("tries"), F.lit(False).alias("back"))
    state, rounds = ["id", "walk", "pos", "prev", "at", "tries", "back"], 0
    back, near, away = 1 / p, 1.0, 1 / q

    def weighed(edges: DataFrame) -> DataFrame:
        """With ``w``, the weight of the step from ``at`` to ``dst``."""
        marked = edges.join(known, (F.col("prev") == F.col("ks")) & (F.col("dst") == F.col("kd")), "left")
        w = F.when(F.col("prev").isNull(), 1.0).when(F.col("dst") == F.col("prev"), back).when(F.col("kd").isNotNull(), near).otherwise(away)
        return marked.withColumn("w", w).drop("ks", "kd")

    while walk_length > 1:
        rounds += 1
        at = now.join(sizes, F.col("at") == F.col("src")).drop("src")
        tried = at.where(F.col("tries") < patience).withColumn("t", F.explode(F.sequence(F.col("tries"), F.least(F.col("tries") + proposals, F.lit(patience)) - 1)))
        tried = tried.withColumn("pick", index(F.col("deg"), seed, "propose", F.col("id"), F.col("walk"), F.col("pos"), F.col("t")))
        proposed = weighed(tried.join(out, (F.col("at") == F.col("src")) & (F.col("pick") == F.col("k"))))
        top = F.when(F.col("prev").isNull(), 1.0).when(F.col("back"), max(back, near, away)).otherwise(max(near, away))
        accepted = uniform(seed, "accept", F.col("id"), F.col("walk"), F.col("pos"), F.col("t")) * top < F.col("w")
        drawn = proposed.groupBy(*state).agg(F.min(F.when(accepted, F.struct("t", "dst")))["dst"].alias("next"))
        # the rest: all edges race
        every = weighed(at.where(F.col("tries") >= patience).join(out, F.col("at") == F.col("src")))
        u = F.greatest(uniform(seed, "race", F.col("id"), F.col("walk"), F.col("pos"), F.col("k")), F.lit(1e-12))
        raced = every.groupBy(*state).agg(F.min(F.struct((-F.ln(u) / F.col("w")).alias("key"), "dst"))["dst"].alias("next"))
        moved = scratch.table(drawn.unionByName(raced), f"round{rounds:05d}")
        ahead = moved.where(F.col("next").isNotNull() & (F.col("pos") + 2 < walk_length)).select("id", "walk", (F.col("pos") + 1).alias("pos"), F.col("at").alias("prev"), F.col("next").alias("at"), F.lit(0).alias("tries"))
        ahead = ahead.join(known, (F.col("at") == F.col("ks")) & (F.col("prev") == F.col("kd")), "left").withColumn("back", F.col("ks").isNotNull()).drop("ks", "kd")
        waiting = moved.where(F.col("next").isNull()).drop("next").withColumn("tries", F.col("tries") + proposals)
        now = scratch.table(ahead.unionByName(waiting), f"now{rounds:05d}")
        if now.isEmpty():
            break
    steps = starts.select("id", "walk", F.lit(0).alias("pos"), F.col("id").cast(kind).alias("node"))
    if rounds:
        made = spark.read.parquet(*(f"{scratch.path}/round{r:05d}" for r in range(1, rounds + 1)))
        steps = steps.unionByName(made.where(F.col("next").isNotNull()).select("id", "walk", (F.col("pos") + 1).alias("pos"), F.col("next").alias("node")))
    # a walk has walk_length nodes at most
    return steps.groupBy("id", "walk").agg(F.sort_array(F.collect_list(F.struct("pos", "node")))["node"].alias("path"))


def node2vec(graph: Graph, *, dim: int = 128, walk_length: int = 80, num_walks: int = 10, p: float = 1.0, q: float = 1.0, window: int = 10, epochs: int = 1, seed: int = 0) -> DataFrame:
    """``id, v``: skip-gram vectors over biased walks."""
    return walk_embeddings(biased_walks(graph, walk_length=walk_length, num_walks=num_walks, p=p, q=q, seed=seed), dim=dim, window=window, epochs=epochs, seed=seed)


def walk_embeddings(walks: DataFrame, *, dim: int = 128, window: int = 5, epochs: int = 1, seed: int = 0) -> DataFrame:
    """``id, v``: skip-gram vectors of nodes that meet in walks."""
    from pyspark.ml.feature import Word2Vec

    words = walks.select(F.transform("path", lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=dim, windowSize=window, maxIter=epochs, minCount=0, seed=seed, inputCol="words", outputCol="v").fit(words)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("v"))


def deepwalk(graph: Graph, *, walk_length: int = 80, num_walks: int = 10, dim: int = 128, seed: int = 0) -> DataFrame:
    return walk_embeddings(random_walks(graph, walk_length=walk_length, num_walks=num_walks, seed=seed), dim=dim, window=max(1, walk_length // 5), seed=seed)


def link_scores(embeddings: DataFrame, candidates: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``src, dst, score, predicted``: sigmoid of the dot product of the two ends' vectors."""
    a = embeddings.select(F.col("id").alias("src"), F.col("v").alias("a"))
    b = embeddings.select(F.col("id").alias("dst"), F.col("v").alias("b"))
    score = 1 / (1 + F.exp(-V.dot(F.col("a"), F.col("b"))))
    return candidates.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", score.alias("score"), (score >= threshold).alias("predicted"))


def mean_pool(node_vectors: DataFrame, graph_id: str = "graph_id") -> DataFrame:
    """``graph_id, v``: mean vector of each graph's nodes."""
    return _sum_vectors(node_vectors, graph_id, F.col("v"), True)


def dominant_scores(graph: Graph, *, hidden: int = 16, epochs: int = 100, rate: float = 0.01, percentile: float = 95, seed: int = 0, features: str = "features", most: int = 5_000) -> DataFrame:
    """``id, score, is_outlier``: reconstruction error of a two-layer graph autoencoder that decodes structure and attributes by z z'.

    Half of a node's score is how badly z z' gives its edges, half how badly it gives its attribute products. Training works on the whole
    dense graph in one task, so more than ``most`` nodes raise. Without features, degree over n is the only one.
    """
    spark = graph.edges.sparkSession
    n = graph.nodes.count()
    if not n:
        raise ValueError("the graph has no nodes")
    if n > most:
        raise ValueError(f"{n} nodes; the dense autoencoder is limited to {most}")
    nodes = graph.nodes.orderBy("id").toPandas()
    at = {x: i for i, x in enumerate(nodes["id"])}
    a = np.zeros((n, n))
    for s, d in graph.edges.select("src", "dst").collect():
        a[at[s], at[d]] = 1.0
    x = np.stack([np.asarray(v, float) for v in nodes[features]]) if features in nodes else a.sum(1, keepdims=True) / n
    norm = a + np.eye(n)
    scale = 1 / np.sqrt(norm.sum(1))
    s = norm * scale[:, None] * scale[None, :]
    rng = np.random.default_rng(seed)
    w1 = rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1])
    w2 = rng.standard_normal((hidden, hidden)) * np.sqrt(1 / hidden)
    target = x @ x.T
    for _ in range(epochs):
        sx = s @ x
        h = np.maximum(sx @ w1, 0)
        sh = s @ h
        z = sh @ w2
        g = z @ z.T
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        dg = 0.5 * (p - a) / (n * n) + 0.5 * 2 * (g - target) / (n * n)
        dz = (dg + dg.T) @ z
        d2 = sh.T @ dz
        d1 = sx.T @ ((s.T @ (dz @ w2.T)) * (h > 0))
        for w, d in ((w1, d1), (w2, d2)):
            w -= rate * d / max(1.0, float(np.linalg.norm(d)))
    g = s @ np.maximum(s @ x @ w1, 0) @ w2
    g = g @ g.T
    p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    structure = -(a * np.log(p + 1e-12) + (1 - a) * np.log(1 - p + 1e-12)).mean(1)
    score = 0.5 * structure + 0.5 * ((g - target) ** 2).mean(1)
    cut = float(np.percentile(score, percentile))
    return spark.createDataFrame([(int(i), float(v), bool(v > cut)) for i, v in zip(nodes["id"], score, strict=True)], "id long, score double, is_outlier boolean")
