"""Trained graph models on graphs small enough to know the answer."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tessera.operators import graph, graph_models as gm

NODE = "id long, features array<double>"


@pytest.fixture(scope="module")
def clubs(spark):
    """Two cliques of six with one bridge."""
    rng = np.random.default_rng(0)
    edges = [(a, b) for lo in (0, 6) for a in range(lo, lo + 6) for b in range(lo, lo + 6) if a != b] + [(5, 6), (6, 5)]
    nodes = spark.createDataFrame([(i, [float(i < 6), *map(float, rng.standard_normal(3) * 0.3)]) for i in range(12)], NODE)
    return graph.Graph(nodes, graph.from_edge_list(spark, edges, 12).edges)


def test_derivatives_are_right():
    rng = np.random.default_rng(1)
    a, b, x = rng.standard_normal((4, 3)), rng.standard_normal((3, 2)), rng.standard_normal((5, 4))
    src, dst = np.array([0, 1, 2, 4, 3]), np.array([1, 1, 0, 3, 2])

    def loss(w):
        va, vb = gm.Value(w[:12].reshape(4, 3)), gm.Value(w[12:].reshape(3, 2))
        z = gm.spread((gm.Value(x) @ va).tanh(), src, dst, np.arange(1.0, 6.0), 5) @ vb
        return va, vb, gm.cross_entropy(z, np.array([0, 1, 1, 0, 1])) + (z.sigmoid() * z.relu()).mean()

    w = np.concatenate([a.ravel(), b.ravel()])
    va, vb, out = loss(w)
    out.backward()
    got = np.concatenate([va.grad.ravel(), vb.grad.ravel()])
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(w + step)[2].data - loss(w - step)[2].data) / 2e-6, abs=1e-6)


def test_node_classifier_and_explanation(spark, clubs):
    labels = spark.createDataFrame([(i, int(i >= 6)) for i in (0, 1, 10, 11)], "id long, label int")
    model = gm.train_node_classifier(clubs, labels, 2)
    got = {r.id: r.predicted for r in gm.classify_nodes(model, clubs).collect()}
    assert sum(got[i] == int(i >= 6) for i in range(12)) >= 11
    why = gm.explain_nodes(model, clubs, spark.createDataFrame([(0,), (11,)], "id long")).collect()
    assert {r.id: r.predicted for r in why} == {0: got[0], 11: got[11]} and all(len(r.feature_mask) == 4 for r in why)
    with pytest.raises(ValueError):
        gm.explain_nodes(model, clubs, spark.createDataFrame([(99,)], "id long"))


def test_link_predictor(spark, clubs):
    model = gm.train_link_predictor(clubs, epochs=150)
    pairs = spark.createDataFrame([(0, 3), (7, 10), (0, 9), (2, 11)], "src long, dst long")
    s = {(r.src, r.dst): r.score for r in gm.predict_links(model, clubs, pairs).collect()}
    assert min(s[0, 3], s[7, 10]) > max(s[0, 9], s[2, 11])


def test_graph_classifier(spark):
    nodes, edges, labels = [], [], []
    for g in range(12):
        n = 5
        ring = [(i, (i + 1) % n) for i in range(n)]
        star = [(0, i) for i in range(1, n)]
        for a, b in ring if g % 2 else star:
            edges += [(g, a, b), (g, b, a)]
        nodes += [(g, i, [1.0]) for i in range(n)]
        labels.append((g, g % 2))
    n, e = spark.createDataFrame(nodes, "graph_id long, id long, features array<double>"), spark.createDataFrame(edges, "graph_id long, src long, dst long")
    model = gm.train_gin(n, e, spark.createDataFrame(labels[:8], "graph_id long, label int"), 2, layers=2)
    got = {r.graph_id: (r.predicted, sum(r.probabilities)) for r in gm.classify_graphs(model, n, e).collect()}
    assert all(got[g][0] == g % 2 and got[g][1] == pytest.approx(1) for g in range(12))


def test_anomaly_models(clubs):
    for f in (gm.cola, gm.card):
        rows = f(clubs, epochs=30).collect()
        assert len(rows) == 12 and sum(r.is_outlier for r in rows) == 1


def test_hetero_and_temporal(spark, clubs):
    nodes = spark.createDataFrame([("user", i, [float(i == 1), 1.0]) for i in range(3)] + [("host", i, [1.0]) for i in range(2)], "type string, id long, features array<double>")
    edges = spark.createDataFrame([("user", "connects", "host", 0, 0), ("user", "connects", "host", 1, 1), ("user", "connects", "host", 2, 0), ("host", "serves", "user", 0, 0), ("host", "serves", "user", 1, 1), ("host", "serves", "user", 0, 2)], "src_type string, rel string, dst_type string, src long, dst long")
    model = gm.train_hetero(nodes, edges, spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "id long, label int"), "user", 2)
    assert model.predicted == [0, 1, 0]
    targets = spark.createDataFrame([(i, float(i >= 6)) for i in range(12)], "id long, value double")
    got = {r.id: r.predicted for r in gm.train_temporal([(1, clubs), (2, clubs)], targets).collect()}
    assert max(got[i] for i in range(5)) < min(got[i] for i in range(7, 12))


def test_biased_walks(spark):
    lone = graph.from_edge_list(spark, [(0, 1)], 3)
    got = {(r.id, r.walk): r.path for r in graph.biased_walks(lone, walk_length=4, num_walks=1).collect()}
    assert got == {(0, 0): [0, 1], (1, 0): [1], (2, 0): [2]}
    line = graph.from_edge_list(spark, [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)], 4)
    back = [r.path for r in graph.biased_walks(line, walk_length=8, num_walks=20, p=1e-6).collect()]
    assert sum(p[i] == p[i + 2] for p in back for i in range(6)) >= 0.95 * 6 * len(back)
    assert sorted(r.path for r in graph.biased_walks(line, walk_length=1, num_walks=1).collect()) == [[0], [1], [2], [3]]
    for bad in ({"p": 0}, {"q": -1}, {"walk_length": 0}):
        with pytest.raises(ValueError):
            graph.biased_walks(line, **bad)


@pytest.mark.parametrize(("proposals", "patience"), [(4, 16), (2, 0)])
def test_transitions_of_biased_walks(spark, proposals, patience):
    """Second-order transition frequencies against the definition, by proposals and by the race of all edges alone."""
    edges = [(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1), (1, 3), (3, 1), (1, 4), (4, 1), (1, 4), (3, 4), (4, 2)]
    p, q = 0.3, 3.0
    paths = [r.path for r in graph.biased_walks(graph.from_edge_list(spark, edges, 5), walk_length=5, num_walks=1500, p=p, q=q, proposals=proposals, patience=patience).collect()]
    seen = Counter((a, b, c) for path in paths for a, b, c in zip(path, path[1:], path[2:], strict=False))
    total = Counter()
    for (a, b, _), n in seen.items():
        total[a, b] += n
    for (a, b), n in total.items():
        weight = Counter()
        for s, d in edges:
            if s == b:
                weight[d] += 1 / p if d == a else 1 if (a, d) in edges else 1 / q
        for c, w in weight.items():
            share = w / sum(weight.values())
            assert abs(seen[a, b, c] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-9, (a, b, c)
    assert len({tuple(x) for x in paths}) > 50


def test_walks_repeat_with_their_seed(spark):
    g = graph.from_edge_list(spark, [(i, (i * 7 + j) % 20) for i in range(20) for j in range(4)], 20)
    one, two, other = (sorted(map(str, graph.biased_walks(graph.Graph(g.nodes, g.edges.repartition(n)), walk_length=5, num_walks=2, q=0.2, seed=s).collect())) for n, s in ((1, 3), (5, 3), (1, 4)))
    assert one == two != other


def test_walks_broadcast_no_part_of_the_graph(spark, monkeypatch):
    """Tables that grow with the graph are merged, however small their compressed files are."""
    from tessera.plans.scratch import Scratch

    plans, table = [], Scratch.table
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, *a, **k: (plans.append((name, plan(df))), table(self, df, name, *a, **k))[1])
    g = graph.from_edge_list(spark, [(0, 1), (1, 0), (1, 2), (2, 0)], 3)
    graph.biased_walks(g, walk_length=3, num_walks=1).collect()
    plans.append(("walks", plan(graph.random_walks(g, walk_length=3, num_walks=1))))
    seen = [(name, p) for name, p in plans if name[:3] in ("out", "now", "rou", "wal")]
    assert len(seen) >= 4 and not [name for name, p in seen if "BroadcastHashJoin" in p]


def test_gcn_scales_edges_once_and_adds_vectors_by_columns(spark, monkeypatch):
    """No component is a row of its own, nothing is broadcast by its file size, and targets that are no nodes count as before."""
    from tessera.plans.scratch import Scratch

    plans, table = [], Scratch.table
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, *a, **k: (plans.append((name, plan(df))), table(self, df, name, *a, **k))[1])
    monkeypatch.setattr(graph, "EDGES", 2)
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, None), (2, 0, 1.0), (1, 9, 3.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, -1.0]), (2, [3.0, 1.0])], "id long, features array<double>")
    w, z = np.array([[1.0, -2.0, 0.5], [0.5, 1.0, 1.0]]), np.array([[1.0], [2.0], [-1.0]])
    got = {r.id: r.v for r in graph.gcn(graph.Graph(nodes, edges), [(w, np.array([0.1, 0.0, 0.2])), (z, None)]).collect()}
    x, known = {0: [1.0, 2.0], 1: [0.0, -1.0], 2: [3.0, 1.0]}, [0, 1, 2]
    for weights, bias, last in ((w, np.array([0.1, 0.0, 0.2]), False), (z, 0, True)):
        every = [(0, 1, 2.0), (1, 2, 1.0), (2, 0, 1.0), (1, 9, 3.0)] + [(i, i, 1.0) for i in known]
        deg = {i: sum(v for _, d, v in every if d == i) for i in (0, 1, 2, 9)}
        x = {i: sum(v / np.sqrt(deg[s] * deg[d]) * np.array(x[s]) for s, d, v in every if d == i) @ weights + bias for i in (0, 1, 2, 9)}
        x, known = {i: v if last else np.maximum(v, 0) for i, v in x.items()}, [0, 1, 2, 9]
    assert got.keys() == x.keys() and all(got[i] == pytest.approx(list(x[i])) for i in x)
    layers = [p for name, p in plans if name.startswith("layer")]
    assert len(layers) == 2 and not any("Generate" in p or "Broadcast" in p for p in layers)
