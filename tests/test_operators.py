"""Operators on small samples with values worked out from their formulas."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.functions import vectors as V
from tessera.operators import anomaly, clustering, evaluation, graph, pairs, ranking, sampling, stats, testing, text_metrics
from tessera.operators.components import connected_components


def column(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, x double")


def two(spark, a, b):
    return spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, x double")


def test_describe(spark):
    r = stats.describe(column(spark, [2, 4, 4, 4, 5, 5, 7, 9]), "x").first()
    assert (r.n, r.mean, r.median, r.q25, r.q75, r.minimum, r.maximum) == (8, 5, 4.5, 4.0, 5.5, 2, 9)
    assert r.variance == pytest.approx(32 / 7) and r.skewness == pytest.approx(0.669922, abs=1e-6) and r.kurtosis == pytest.approx(-0.428271, abs=1e-6)
    one = stats.describe(column(spark, [42]), "x").first()
    assert (one.variance, one.std, one.skewness, one.kurtosis) == (0, 0, 0, 0)
    assert stats.describe(column(spark, [1, 2, 3, 4, 5]), "x").first().skewness == pytest.approx(0)
    with pytest.raises(Exception, match="no values"):
        stats.describe(column(spark, []), "x").collect()


def test_small_statistics(spark):
    x = column(spark, [1, 2, 4, 8])
    assert stats.geometric_mean(x, "x").first()[0] == pytest.approx(64**0.25)
    assert stats.harmonic_mean(x, "x").first()[0] == pytest.approx(4 / 1.875)
    assert stats.trim_mean(column(spark, range(10)), "x", proportion=0.2).first()[0] == pytest.approx(4.5)
    assert [r.z for r in stats.z_scores(column(spark, [3, 3, 3]), "x").collect()] == [0, 0, 0]
    with pytest.raises(Exception, match="positive"):
        stats.geometric_mean(column(spark, [1, 0]), "x").collect()
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "k string")
    assert stats.entropy(keys, "k").first()[0] == pytest.approx(math.log(2))
    with pytest.raises(ValueError):
        stats.quantile(x, "x", 1.5)


@pytest.mark.parametrize(
    ("fn", "a", "b", "want"),
    [
        (V.cosine, [0, 0], [1, 2], 0), (V.pearson, [1, 2, 3, 4], [2, 4, 6, 8], 1), (V.manhattan, [1, 2], [4, 6], 7), (V.chebyshev, [1, 2, 3], [4, 0, 3], 3),
        (V.hamming, [1, 1, 0, 0], [1, 0, 1, 0], 0.5), (V.canberra, [0, 1], [0, 2], 1 / 3), (V.jaccard, [0, 0], [0, 0], 1), (V.overlap_coefficient, [0, 0], [1, 0], 0), (V.euclidean, [0, 0], [3, 4], 5),
    ],
)
def test_measures(spark, fn, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    assert df.select(fn(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_vectors_of_different_length_raise(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="same, positive length"):
        df.select(V.cosine(F.col("a"), F.col("b"))).collect()


def test_matrices_and_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 4))
    x[3] = 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    a = {(r.i, r.j): r.value for r in pairs.similarity_matrix(df).collect()}
    b = {(r.i, r.j): r.value for r in pairs.cosine_matrix_blocks(df).collect()}
    assert a.keys() == b.keys() and len(a) == 900
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a) and a[3, 3] == 0
    near = pairs.nearest(df, 3).where("i = 0").orderBy("r").collect()
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    assert [r.j for r in near] == [int(j) for j in np.argsort(d, kind="stable")[1:4]]


def test_block_products_equal_pair_by_pair_values(spark, monkeypatch):
    """Copies, close and far vectors, zero rows, ties, null ids and vectors, string ids, tables of one block and of none."""
    monkeypatch.setattr(pairs, "BLOCK", 6)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((24, 5)) * 100
    x[5], x[6], x[7], x[8] = x[4], x[4] + 1e-7, 0, x[4] * 1e6
    rows = [(f"n{i:02d}", [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, v array<double>, g long")
    noisy = df.unionByName(spark.createDataFrame([("z", None, 0), (None, [1.0] * 5, 0)], df.schema))
    got = {(r.i, r.j): r.value for r in pairs.distance_matrix(noisy).collect()}
    assert len(got) == 25 * 25 and got["n00", "z"] is None and got["z", "z"] == 0 and got["n04", "n05"] == 0
    for i, a in enumerate(x):
        for j, b in enumerate(x):
            assert got[f"n{i:02d}", f"n{j:02d}"] == pytest.approx(float(np.sqrt(((a - b) ** 2).sum())), rel=1e-9)
    cos = {(r.i, r.j): r.value for r in pairs.similarity_matrix(df).collect()}
    slow = {(r.i, r.j): r.value for r in pairs.similarity_matrix(df, lambda a, b: V.cosine(a, b)).collect()}
    assert cos.keys() == slow.keys() and all(cos[k] == pytest.approx(slow[k], abs=1e-12) for k in cos)
    for k in (1, 4, 30):
        fast = [tuple(r) for r in pairs.nearest(noisy, k).select("i", "r", "j").orderBy("i", "r").collect()]
        slow = [tuple(r) for r in pairs.nearest(df, k, lambda a, b: V.euclidean(a, b)).select("i", "r", "j").orderBy("i", "r").collect()]
        assert fast == slow and len(fast) == 24 * min(k, 23)
    sums = {(r.i, r.lj): (r.total, r.n) for r in pairs.label_distances(df, "g").groupBy("i", "lj").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    for i, a in enumerate(x):
        for g in range(3):
            others = [float(np.sqrt(((a - b) ** 2).sum())) for j, b in enumerate(x) if j % 3 == g and j != i]
            assert sums[f"n{i:02d}", g] == (pytest.approx(sum(others)), len(others))
    assert pairs.similarity_matrix(df.limit(0)).count() == 0 and pairs.nearest(df.limit(0), 2).count() == 0
    with pytest.raises(Exception, match="same, positive length"):
        pairs.similarity_matrix(df.unionByName(spark.createDataFrame([("y", [1.0], 0)], df.schema))).collect()


def test_special_functions(spark):
    one = spark.range(1)
    for z in (-4.0, -0.3, 0.0, 1.96):
        assert one.select(special.normal_cdf(z)).first()[0] == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-9)
    for x in (0.5, 1.0, 7.3, 120.0):
        assert one.select(special.lgamma(x)).first()[0] == pytest.approx(math.lgamma(x), abs=1e-9)
    assert one.select(special.t_two_tailed(F.lit(2.228), F.lit(10.0))).first()[0] == pytest.approx(0.05, abs=1e-4)
    assert one.select(special.chi2_tail(F.lit(5.991), F.lit(2.0))).first()[0] == pytest.approx(0.05, abs=1e-4)


def test_tests(spark):
    w = testing.welch_t_test(two(spark, [5.0, 5.1, 4.9, 5.0, 5.05], [1.0, 1.1, 0.9, 1.0, 1.05]), "x", "g", "a", "b").first()
    assert w.statistic > 50 and w.p_value < 1e-6 and w.effect_size > 10
    flat = testing.welch_t_test(two(spark, [1, 1], [2, 2]), "x", "g", "a", "b").first()
    assert (flat.statistic, flat.p_value) == (0, 1)
    u = testing.mann_whitney(two(spark, range(1, 6), range(6, 11)), "x", "g", "a", "b").first()
    assert u.statistic == 0 and u.effect_size == 1 and u.p_value < 0.02
    k = testing.ks_test(two(spark, [1, 2, 3, 4, 5, 1.5, 2.5, 3.5], [6, 7, 8, 9, 10, 6.5, 7.5, 8.5]), "x", "g", "a", "b").first()
    assert k.statistic == 1 and k.p_value < 0.01
    one = testing.one_sample_t_test(column(spark, [4.9, 5.0, 5.1, 4.95, 5.05, 5.0]), "x", 5.0).first()
    assert one.p_value == pytest.approx(1, abs=1e-6)
    df = two(spark, range(1, 6), range(6, 11)).withColumn("id", F.monotonically_increasing_id())
    fixed = spark.createDataFrame(df.collect(), df.schema)
    p = testing.permutation_test(fixed, "x", "g", "a", "b", id_col="id", n_permutations=200).first()
    q = testing.permutation_test(fixed, "x", "g", "a", "b", id_col="id", n_permutations=200, statistic=lambda a, b: sum(a) / len(a) - sum(b) / len(b)).first()
    assert p.p_value == q.p_value < 0.05


def test_corrections(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.001), (3, 0.2)], "i int, p double")
    get = lambda d: [round(r.adjusted_p, 6) for r in d.orderBy("i").collect()]
    assert get(testing.holm(df, "p", id_col="i")) == [0.03, 0.08, 0.004, 0.2]
    assert get(testing.benjamini_hochberg(df, "p", id_col="i")) == [0.02, 0.053333, 0.004, 0.2]
    assert get(testing.bonferroni(df, "p")) == [0.04, 0.16, 0.004, 0.8]


def test_evaluation(spark):
    rows = list(zip([1, 0, 1, 1, 0, 0, 1, 0], [1, 0, 0, 1, 1, 0, 1, 0], strict=True))
    c = evaluation.confusion_matrix(spark.createDataFrame(rows, "y int, p int"), "y", "p").first()
    assert (c.tp, c.fp, c.fn, c.tn, c.precision, c.recall, c.f1, c.accuracy) == (3, 1, 1, 3, 0.75, 0.75, 0.75, 0.75)
    m = spark.createDataFrame(list(zip([0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 0, 2], strict=True)), "y int, p int")
    assert evaluation.classification_report(m, "y", "p").first().accuracy == 0.5
    assert [r.support for r in evaluation.per_class(m, "y", "p").collect()] == [2, 2, 2]
    roc = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.4), (2, 1, 0.35), (3, 1, 0.8)], "id int, y int, s double")
    assert evaluation.roc_auc(roc, "y", "s").first()[0] == 0.75
    points = sorted((-r.threshold, r.fpr, r.tpr) for r in evaluation.roc_curve(roc, "y", "s").collect())
    assert points[0][1:] == (0, 0) and points[-1][1:] == (1, 1)
    half = spark.createDataFrame([(i % 2, 0.5) for i in range(100)], "y int, p double")
    assert evaluation.expected_calibration_error(half, "y", "p").first()[0] == 0
    reg = evaluation.regression_metrics(spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "t double, p double"), "t", "p").first()
    assert (reg.mae, reg.mse) == (0.5, 0.375)


def test_ranking(spark):
    docs = spark.createDataFrame([(0, "the cat sat on the mat"), (1, "the dog sat on the log"), (2, "cats and dogs"), (3, None)], "doc_id long, text string")
    for f in (ranking.tfidf_score, ranking.bm25_score):
        s = {r.doc_id: r.score for r in f(docs, "cat").collect()}
        assert max(s, key=s.get) == 0 and s[2] == 0 and s[3] == 0
        assert all(r.score == 0 for r in f(docs, "").collect())
    hello = spark.createDataFrame([(0, "hello world")], "doc_id long, text string")
    assert ranking.tfidf_score(hello, "hello").first().score == pytest.approx(1 / math.sqrt(2))
    ranked = spark.createDataFrame([("q", i, d) for i, d in enumerate([0, 1, 2])] + [("r", i, d) for i, d in enumerate([0, 1])], "query_id string, pos int, doc_id long")
    relevant = spark.createDataFrame([("q", 0), ("r", 1)], "query_id string, doc_id long")
    assert ranking.mean_reciprocal_rank(ranked, relevant).first()[0] == 0.75
    assert {r.query: r.recall for r in ranking.recall_at_k(ranked, relevant, 1).collect()} == {"q": 1.0, "r": 0.0}
    gains = spark.createDataFrame([("q", i, g) for i, g in enumerate([3, 2, 1, 0])] + [("z", 0, 0)], "q string, pos int, rel int")
    assert {r.query: r.ndcg for r in ranking.ndcg(gains, query="q", position="pos", relevance="rel").collect()} == {"q": 1.0, "z": 0.0}


def test_text_metrics(spark):
    rows = [("kitten", "sitting"), ("", "abc"), ("ab", "ba"), ("martha", "marhta"), ("", ""), ("a", ""), ("ca", "abc")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(text_metrics.levenshtein(a, b), text_metrics.damerau_levenshtein(a, b), text_metrics.jaro(a, b), text_metrics.normalized_levenshtein(a, b)).collect()
    assert [r[0] for r in got] == [3, 3, 2, 2, 0, 1, 3] and [r[1] for r in got] == [3, 3, 1, 1, 0, 1, 2]
    assert got[3][2] == pytest.approx(0.944444, abs=1e-6) and got[4][2] == 1 and got[5][2] == 0 and got[4][3] == 1
    s = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("the cat", "a dog"), ("Hello World", "hello world"), ("one", None)], "r string, h string")
    r, h = F.col("r"), F.col("h")
    m = s.select(text_metrics.jaccard_token(r, h), text_metrics.ngram_overlap(r, h), text_metrics.rouge_l(r, h), text_metrics.bleu(F.array(r), h), text_metrics.rouge_s(r, h)).collect()
    assert m[0][0] == m[0][1] == 1 and m[0][2].f1 == pytest.approx(1) and m[0][3].score == pytest.approx(1) and m[0][4].f1 == pytest.approx(1)
    assert m[1][3].score == 0 and m[1][3].bp == 0 and m[2][0] == 1 and m[3][0] is None


def test_lcs_against_a_table():
    rng = random.Random(1)
    for _ in range(100):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(12))], [rng.choice("abc") for _ in range(rng.randrange(12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert text_metrics._lcs(a, b) == t[-1][-1]


def test_sampling(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    split = Counter(r.split for r in sampling.train_test_split(df, "k", seed=1).collect())
    assert split == {"test": 21, "train": 82}
    assert sorted(Counter(r.fold for r in sampling.kfold(df, "k", 5, seed=1).collect()).values()) == [20, 20, 21, 21, 21]
    strat = sampling.stratified_kfold(df.withColumn("y", F.col("k") % 2), "k", "y", 5).collect()
    assert Counter((r.y, r.fold) for r in strat)[0, 0] == 11
    assert sampling.reservoir_sample(df, "k", 10, seed=2).count() == 10
    b = sampling.bootstrap(df.withColumn("x", F.col("k").cast("double")), "x", "k", n_resamples=100, seed=3).first()
    c = sampling.bootstrap(df.withColumn("x", F.col("k").cast("double")), "x", "k", lambda v: sum(v) / len(v), n_resamples=100, seed=3).first()
    assert b.ci_lower < b.statistic < b.ci_upper and b.mean == pytest.approx(c.mean)


def test_anomalies(spark):
    x = column(spark, [2.0 + 0.01 * (i % 5 - 2) for i in range(20)] + [100.0])
    for f in (anomaly.zscore_detector, anomaly.iqr_detector, anomaly.mad_detector):
        assert [r.id for r in f(x, "x").where("is_outlier").collect()] == [20]
    points = spark.createDataFrame([(i, [1 + 0.1 * (i % 4), 1 + 0.1 * (i // 4)]) for i in range(12)] + [(12, [50.0, 50.0])], "id long, v array<double>")
    assert [r.id for r in anomaly.lof(points, k=3).where("is_outlier").collect()] == [12]
    iso = anomaly.isolation_score(column(spark, [*range(50), 1000]), "x", "id").orderBy(F.desc("score")).first()
    assert iso.id == 50 and iso.is_outlier


def test_isolation_trees_draw_from_the_whole_table(spark):
    """Values differ only outside the 4,096 rows of least md5 key: trees that see only those rows could not part any."""
    n = 6_000
    least = set(sorted(range(n), key=lambda i: hashlib.md5(f"0|isolation|{i}".encode()).hexdigest())[:4096])
    rows = [(i, 1.0 if i in least else 2.0 + i) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(7)
    score = {r.id: r.score for r in anomaly.isolation_score(df, "x", "id").collect()}
    assert len(score) == n and score[max(set(range(n)) - least)] > score[min(least)] + 0.05
    # each tree's rows are those of least key, whatever the partitions and batches
    h = np.array([int(hashlib.md5(f"3|isolation|{i}".encode()).hexdigest()[:16], 16) for i in range(n)], np.uint64)
    ids = spark.range(n).select("id", F.col("id").cast("double").alias("x"))
    got = anomaly._tree_samples(ids.repartition(3), 20, 50, 3)
    for t, sample in enumerate(got):
        salt = anomaly._mix(np.array([t + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert sample.tolist() == sorted(np.argsort(anomaly._mix(h ^ salt) >> np.uint64(1), kind="stable")[:50].tolist())
    assert len(np.unique(np.concatenate(got))) > 900


BLOBS = [(i, [1 + 0.1 * (i % 2), 1 + 0.1 * (i // 2)]) for i in range(4)] + [(4 + i, [9 + 0.1 * (i % 2), 9 + 0.1 * (i // 2)]) for i in range(4)]


def test_clustering(spark):
    df = spark.createDataFrame([*BLOBS, (8, [50.0, 50.0])], "id long, v array<double>")
    blobs = df.where("id < 8")
    for labels in (clustering.kmeans(blobs, 2, n_init=2)[0], clustering.agglomerative(blobs, 2), clustering.agglomerative(blobs, 2, linkage="single"), clustering.agglomerative(blobs, 2, linkage="complete")):
        by = {r.id: r.label for r in labels.collect()}
        assert len({by[i] for i in range(4)}) == len({by[i] for i in range(4, 8)}) == 1 and by[0] != by[4]
    d = {r.id: r.label for r in clustering.dbscan(df, eps=0.5, min_samples=3).collect()}
    assert d == {**{i: 0 for i in range(4)}, **{i: 1 for i in range(4, 8)}, 8: -1}
    labelled = blobs.withColumn("y", (F.col("id") >= 4).cast("int"))
    assert clustering.silhouette_score(labelled, "y").first()[0] > 0.95
    assert clustering.davies_bouldin_index(labelled, "y").first()[0] < 0.05
    assert clustering.silhouette_score(labelled.withColumn("y", F.lit(0)), "y").first()[0] == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: root(n) for n in parent}


def test_graphs(spark):
    g = graph.from_edge_list(spark, [(0, 1), (1, 2), (2, 0)], 3)
    nodes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, features array<double>")
    g = graph.Graph(nodes, g.edges)
    gcn = {r.id: r.v for r in graph.gcn_propagate(g).collect()}
    assert gcn[1] == pytest.approx([0.5, 0.5])
    sage = {r.id: r.v for r in graph.sage_propagate(g).collect()}
    assert sage[2] == pytest.approx([0.0, 1.0])
    lone = graph.from_edge_list(spark, [(0, 1)], 3)
    walks = {(r.id, r.walk): r.path for r in graph.random_walks(lone, walk_length=4, num_walks=2).collect()}
    assert walks[2, 0] == [2] and walks[0, 1] == [0, 1]
    matrix = spark.createDataFrame([(0, [0.0, 2.0]), (1, [0.0, 0.0])], "id long, row array<double>")
    assert [tuple(r) for r in graph.from_adjacency_matrix(matrix).edges.collect()] == [(0, 1, 2.0)]
    vecs = graph.walk_embeddings(graph.random_walks(g, walk_length=6, num_walks=4), dim=4)
    assert vecs.count() == 3
    scores = graph.link_scores(vecs, g.edges).collect()
    assert len(scores) == 3 and all(0 < r.score < 1 for r in scores)


def test_step_wise_corrections_of_whole_tables_and_groups(spark):
    """Range-partitioned and grouped families give what the definitions give, ties included."""
    rng = np.random.default_rng(3)
    p = np.round(rng.random(120) ** 3, 2)
    df = spark.createDataFrame([(i, i % 2, float(x)) for i, x in enumerate(p)], "id long, g long, p double").repartition(5)

    def expected(ids, up):
        order = sorted(ids, key=lambda i: (p[i], i))
        m = len(order)
        if up:
            raw = [min(1.0, min(p[j] * m / (s + 1) for s, j in list(enumerate(order))[r:])) for r in range(m)]
        else:
            raw = [max(min(1.0, p[j] * (m - s)) for s, j in list(enumerate(order))[: r + 1]) for r in range(m)]
        return dict(zip(order, raw, strict=True))

    for fn, up in ((testing.benjamini_hochberg, True), (testing.holm, False)):
        whole = {r.id: r.adjusted_p for r in fn(df, "p", id_col="id").collect()}
        assert whole == pytest.approx(expected(range(120), up))
        grouped = {r.id: r.adjusted_p for r in fn(df, "p", ["g"], id_col="id").collect()}
        assert grouped == pytest.approx({**expected(range(0, 120, 2), up), **expected(range(1, 120, 2), up)})


def _merged(points, n_clusters, linkage):
    """By the definition: the closest pair, the first in a tie, becomes the last cluster of the list."""
    groups = [[i] for i in range(len(points))]
    fold = {"single": min, "complete": max, "average": lambda d: sum(d) / len(d)}[linkage]
    while len(groups) > n_clusters:
        gaps = [(round(fold([math.dist(points[x], points[y]) for x in a for y in b]), 9), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(gaps)
        groups = [g for x, g in enumerate(groups) if x not in (i, j)] + [groups[i] + groups[j]]
    return {i: label for label, g in enumerate(groups) for i in g}


@pytest.mark.parametrize(("linkage", "matrix"), [("average", 10_000), ("average", 0), ("single", 0), ("complete", 0)])
def test_agglomerative_with_copies(spark, linkage, matrix):
    """Copies merge first and are counted, not compared; labels are those of merging every point, by a matrix and row by row."""
    rng = random.Random(5)
    base = [(rng.random() * 9, rng.random() * 9) for _ in range(9)]
    points = [base[rng.choice((0, 0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 8))] for _ in range(36)]
    rows = [(g, i, list(p)) for g, n in (("a", 36), ("b", 13), (None, 4)) for i, p in enumerate(points[:n])] + [("few", i, [float(i % 2), 0.0]) for i in range(11)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>").repartition(3)
    got = clustering.agglomerative(df, 4, linkage=linkage, by=["g"], matrix=matrix).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None, "few"):
        want = _merged([p for h, _, p in rows if h == g], 4, linkage)
        assert {r.id: r.label for r in got if r.g == g} == want


@pytest.mark.parametrize("linkage", ["average", "single", "complete"])
def test_agglomerative_beyond_the_matrix_compares_what_is_near(spark, linkage, monkeypatch):
    """Labels are those of the matrix; by mean and largest distances few more pairs are measured than the last clusters' matrix asks for."""
    rng = np.random.default_rng(4)
    x = np.unique(np.c_[rng.integers(0, 9_000, 1_400) / 1_000, rng.integers(0, 4, 1_400)], axis=0)
    measured, gaps = [], clustering._gaps
    monkeypatch.setattr(clustering, "_gaps", lambda a, b: (measured.append(len(a) * len(b)), gaps(a, b))[1])
    monkeypatch.setattr(clustering, "FEW", 60)
    weight = rng.integers(1, 4, len(x))
    labels = [clustering._merged(x, weight, linkage, matrix, 3).tolist() for matrix in (len(x), len(x) - 1)]
    assert labels[0] == labels[1]
    assert linkage == "single" or sum(measured) < 1.5 * len(x) ** 2


def test_agglomerative_has_no_limit_of_points(spark):
    df = spark.range(6_000).select("id", F.array((F.col("id") % 40).cast("double") ** 2).alias("v"))
    got = clustering.agglomerative(df, 3, id_col="id")
    assert got.count() == 6_000 and got.select("label").distinct().count() == 3


def test_dbscan_joins_distinct_points_only(spark, monkeypatch):
    """Copies count, but are no pairs."""
    joined = []
    monkeypatch.setattr(clustering, "within", lambda d, eps: (joined.append(d.count()), pairs.within(d, eps))[1])
    rows = [(i, [float(i % 3) * 10, -0.0 if i % 2 else 0.0]) for i in range(90)] + [(100, [0.4, 0.0]), (101, [55.0, 0.0]), (102, [55.0, 0.0]), (103, [float("nan"), 0.0])]
    got = {r.id: (r.label, r.core) for r in clustering.dbscan(spark.createDataFrame(rows, "id long, v array<double>"), eps=0.5, min_samples=4).collect()}
    assert joined == [5]
    assert got == {**{i: (i % 3, True) for i in range(90)}, 100: (0, True), 101: (-1, False), 102: (-1, False), 103: (-1, False)}


def _clustered(x, eps, min_samples):
    """By the definition; points are numbered by their place."""
    near = np.sqrt(sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(x.shape[1]))) <= eps
    core, label, clusters = near.sum(1) >= min_samples, {}, 0
    for start in np.flatnonzero(core):
        todo = [] if start in label else [start]
        clusters += len(todo)
        while todo:
            at = todo.pop()
            if at not in label:
                label[at] = clusters - 1
                todo += np.flatnonzero(near[at] & core).tolist()
    return {i: (label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1), bool(core[i])) for i in range(len(x))}


def test_dbscan_lets_dense_cells_stand_for_their_points(spark, monkeypatch):
    """Points of dense cells are no pairs, and clusters are those of the definition: ties at eps, borders, noise, cells apart or hardly in reach."""
    joined = []
    monkeypatch.setattr(clustering, "within", lambda d, eps: (joined.append(d.count()), pairs.within(d, eps))[1])
    monkeypatch.setattr(clustering, "PART", 7)
    rng = np.random.default_rng(2)
    line = np.c_[rng.integers(0, 300, 500) / 100, rng.integers(0, 3, 500) * 4.0]
    blobs = np.r_[rng.normal(size=(250, 2)) * 0.05, rng.random((250, 2)) * 4 - 2]
    for x, eps, min_samples, most in ((line, 0.05, 4, 500), (blobs, 0.2, 5, 300), (rng.random((400, 2)), 0.3, 12, 200)):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
        assert {r.id: (r.label, r.core) for r in clustering.dbscan(df, eps=eps, min_samples=min_samples).collect()} == _clustered(x, eps, min_samples)
        assert joined.pop() < most
    with pytest.raises(ValueError, match="same, positive length"):
        clustering.dbscan(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"))
    assert clustering.dbscan(spark.createDataFrame([(1, None)], "id long, v array<double>")).count() == 0


def test_pairs_at_just_the_distance_are_those_of_the_differences(spark):
    x = np.arange(200) / 10
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "id long, v array<double>")
    assert {tuple(r) for r in pairs.within(df, 0.1).collect()} == {(i, j) for i in range(200) for j in range(200) if abs(x[i] - x[j]) <= 0.1}


def test_kmeans_shuffles_one_row_for_each_task_and_sum(spark):
    rows = spark.range(4_000).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("v")).repartition(2)
    cs = [(0, np.array([1.0, 1.0])), (0, np.array([5.0, 3.0])), (1, np.array([3.0, 2.0]))]
    sums = clustering._sums(rows, cs).collect()
    assert len(sums) <= 2 * 3 * 3
    want = {(r.run, r.label): (r.n, r.x, r.d2) for r in clustering._assign(rows, cs).groupBy("run", "label").agg(F.count("*").alias("n"), F.sum(F.col("v")[0]).alias("x"), F.sum("d2").alias("d2")).collect()}
    for key, (n, x, d2) in want.items():
        of = lambda d: [r for r in sums if (r.run, r.label, r.d) == (*key, d)]  # noqa: B023, E731
        assert sum(r.n for r in of(0)) == n and sum(r.s for r in of(0)) == x and sum(r.s for r in of(-1)) == pytest.approx(d2)


def test_points_of_one_file_are_dealt_to_tasks(spark):
    points = spark.range(1000, numPartitions=1).select("id", F.array(F.col("id").cast("double")).alias("v"))
    dealt = clustering._dealt(points, 100)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000
    assert clustering._dealt(points.limit(0)).rdd.getNumPartitions() == 1
