"""Exact quantiles and exact neighbours without gathering a group or comparing all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import metric_join, pairs, stats
from tessera.plans import selection

PS = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]


def groups(spark):
    """Ties, one value, NaN, infinities, negative zero, a null key, a group without values, and a skewed large group."""
    rng = np.random.default_rng(1)
    rows = [("ties", float(v)) for v in rng.integers(0, 5, 3000)] + [("one", 7.0), ("none", None), ("odd", float("nan")), ("odd", float("inf")), ("odd", 1.0), ("odd", float("-inf")), ("odd", None)]
    rows += [(None, float(v)) for v in range(11)] + [("zero", 0.0), ("zero", -0.0)] + [("large", float(v)) for v in np.exp(rng.normal(size=5000) * 9)]
    return spark.createDataFrame(rows, "k string, x double").repartition(5)


@pytest.mark.parametrize("small", [0, 100, 10_000])
def test_selection_equals_the_aggregate(spark, small):
    df = groups(spark)
    want = {r.k: r.q for r in df.where("x IS NOT NULL").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, PS))).alias("q")).collect()}
    got = {r.k: r.q for r in selection.quantiles(df, PS, ["k"], small=small).collect()}
    assert got.keys() == want.keys()
    for k, q in want.items():
        np.testing.assert_allclose(got[k], q, rtol=1e-14, equal_nan=True)


def test_selection_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1001)], "x double")
    assert selection.quantiles(df, [0.5, 0.1234], small=0).first()[0] == [500.0, pytest.approx(123.4)]
    assert selection.quantiles(df.where("x < 0"), [0.5], small=0).count() == 0 == selection.quantiles(df.where("x < 0"), [0.5]).count()
    assert stats.quantile(df.where("x < 0"), "x", 0.5).first()[0] is None
    with pytest.raises(ValueError):
        selection.quantiles(df, [1.5])


def test_a_bracket_that_fails_is_replaced(spark, monkeypatch):
    """Without any reach, and with a sketch of two steps, ranks fall out of their brackets; the result stays."""
    monkeypatch.setattr(selection, "STEPS", 2)
    monkeypatch.setattr(selection, "REACH", -1)
    df = spark.createDataFrame([("a", float((v * 37) % 1000)) for v in range(1000)], "k string, x double")
    got = selection.quantiles(df, [0.3, 0.7], ["k"], small=0).first().q
    assert got == [pytest.approx(299.7), pytest.approx(699.3)]


def test_one_group_of_many_distinct_values(spark):
    """Two million distinct values in one group; what is shuffled is a small part of them."""
    n = 2_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    assert selection.quantiles(df, [0.5, 0.999], small=0).first()[0] == [(n - 1) / 2, pytest.approx((n - 1) * 0.999)]


def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(150, 6)) * 0.1 + rng.normal(size=6) * 10 for _ in range(10)] + [np.repeat(rng.normal(size=(3, 6)), 30, axis=0), np.zeros((5, 6))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [0.0] * 6), (9_000, None)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("k", [1, 4, 40])
def test_neighbours_by_cells(spark, k):
    df = blobs(spark)
    cells = metric_join.Cells(df, id_col="id", vector="v", block=64)
    best = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    got = metric_join.nearest_by_cells(df, k, cells=cells).withColumn("r", best).where(F.col("r") <= k)
    want = pairs.nearest(df, k)
    assert {(r.i, r.r): r.j for r in got.collect()} == {(r.i, r.r): r.j for r in want.collect()}
    visited = cells.scratch.read("visits").join(cells.blocks, ["cell", "ring"]).agg(F.sum("n")).first()[0] or 0
    compared = visited + cells.blocks.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    assert compared < (0.2 if k < 40 else 0.3) * cells.n**2


def test_nearest_changes_its_way_not_its_result(spark):
    df = blobs(spark)
    a, b = (pairs.nearest(df, 3, all_pairs=n).select("i", "j", "r").collect() for n in (0, 10_000))
    assert set(a) == set(b) and len(a) == len(b) == 3 * df.where("id IS NOT NULL AND v IS NOT NULL").count()
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    assert sorted((r.i, r.j) for r in pairs.nearest(few, 5, all_pairs=0).collect()) == [(1, 2), (2, 1)]
    odd = few.unionByName(spark.createDataFrame([(3, [float("nan")])], "id long, v array<double>"))
    assert {(r.i, r.j, r.r) for r in pairs.nearest(odd, 2, all_pairs=0).collect()} == {(r.i, r.j, r.r) for r in pairs.nearest(odd, 2).collect()}
    assert pairs.nearest(few.limit(0), 2, all_pairs=0).count() == 0


@pytest.mark.parametrize("eps", [0.0, 0.25, 3.0])
def test_within(spark, eps):
    df = blobs(spark)
    x = {r.id: np.array(r.v) for r in df.collect() if r.id is not None and r.v is not None}
    ids, m = list(x), np.array(list(x.values()))
    d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(2))
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(d <= eps), strict=True)}
    got = [tuple(r) for r in pairs.within(df, eps).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    odd = spark.createDataFrame([(1, [math.nan]), (2, [math.inf]), (3, [1.0])], "id long, v array<double>")
    assert [tuple(r) for r in pairs.within(odd, eps).collect()] == [(3, 3)]


def test_pairs_of_wide_blocks(spark, monkeypatch):
    """Rows are copied once for each block, whose number does not follow that of rows; neighbours and sums stay those of all pairs."""
    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(pairs, "WIDE", 3)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 5)) * 8) / 8  # exact sums
    x[40:90] = x[3]  # copies: ties go to smaller ids
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "id long, v array<double>, y int").repartition(3)
    assert pairs._sides(df, "id", "v", wide=True)[0].count() == sum(r.b * (3 - r.bi) for r in pairs._sides(df, "id", "v", wide=True)[0].where("bi = bj").groupBy("bi").agg(F.count("*").alias("b")).collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    best = Window.partitionBy("i").orderBy("d", "j")
    for k in (1, 6):
        got = pairs.nearest_by_blocks(df, k)
        assert got.count() <= 150 * k * 4
        rows = got.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).collect()
        want = {(i, r + 1): j for i in range(150) for r, j in enumerate(sorted((j for j in range(150) if j != i), key=lambda j: (round(d[i, j], 12), j))[:k])}
        assert {(r.i, r.r): r.j for r in rows} == want
    sums = {(r.i, r.lj): (r.t, r.n) for r in pairs.label_distances(df, "y").groupBy("i", "lj").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).collect()}
    for i in range(150):
        for y in range(3):
            others = [j for j in range(150) if j % 3 == y and j != i]
            assert sums[i, y] == (pytest.approx(d[i, others].sum()), len(others))


@pytest.mark.parametrize("offset, scale", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e-25), (3.0, 1e30)])
def test_nearest_by_wide_blocks_is_exact_where_single_precision_is_not(spark, offset, scale):
    """Rough products may only rule out what is surely farther: far from the origin, very small and very large vectors, and ties."""
    rng = np.random.default_rng(7)
    x = (rng.integers(0, 40, (1500, 3)) / 8 + offset) * scale
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    best = Window.partitionBy("i").orderBy("d", "j")
    got = pairs.nearest_by_blocks(df, 4).withColumn("r", F.row_number().over(best)).where("r <= 4").toPandas().sort_values(["i", "r"])
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (got["j"].to_numpy().reshape(-1, 4) == order).all()
    assert (got["d"].to_numpy().reshape(-1, 4) == np.take_along_axis(d, order, 1)).all()


def test_wide_blocks_copy_single_precision_vectors_as_they_are(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0])], "id long, v array<float>")
    wide, narrow = (dict(pairs._sides(df, "id", "v", wide=w)[0].dtypes)["a"] for w in (True, False))
    assert (wide, narrow) == ("array<float>", "array<double>")


def test_blocks_meet_without_copies_in_a_shuffle(spark, monkeypatch):
    """Matrices and neighbours of all pairs shuffle vectors once, to write their blocks; nothing else of a matrix is shuffled."""
    for name, value in (("BLOCK", 16), ("WIDE", 3), ("TILE", 8), ("BATCH", 50)):
        monkeypatch.setattr(pairs, name, value)
    x = np.random.default_rng(9).normal(size=(130, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    for matrix, want in ((pairs.distance_matrix, d), (pairs.similarity_matrix, unit @ unit.T), (pairs.cosine_matrix_blocks, unit @ unit.T)):
        found = matrix(df)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        cells = [tuple(r) for r in found.collect()]
        assert len(cells) == len({c[:2] for c in cells}) == 130 * 130
        assert all(v == pytest.approx(want[i, j], abs=1e-9) for i, j, v in cells)
    assert "Exchange" not in pairs.nearest_by_blocks(df, 3)._jdf.queryExecution().executedPlan().toString()


def test_matrices_leave_in_order_of_value(spark, monkeypatch):
    """Within a pair of blocks equal values follow one another, each cell beside its mirror image, so that files hold runs; no cell is lost."""
    monkeypatch.setattr(pairs, "BATCH", 1_000)
    x = np.random.default_rng(6).normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    for blocks in (1, 50):
        monkeypatch.setattr(pairs, "SQUARE", 2_048 if blocks == 1 else 50)
        for matrix in (pairs.distance_matrix, pairs.similarity_matrix, pairs.cosine_matrix_blocks):
            rows = matrix(df).collect()
            assert {(r.i, r.j) for r in rows} == {(i, j) for i in range(200) for j in range(200)} and len(rows) == 200 * 200
            falls = sum(a.value > b.value + 1e-12 for a, b in zip(rows, rows[1:], strict=False) if a.i != a.j and b.i != b.j)
            assert falls <= (0 if blocks == 1 else 9)


def test_many_rows_are_rounded_as_few(spark):
    values = [0.0078125, -0.0078125, 0.0234375, -0.0, 1e300, float("inf"), None, 0.1234564999, 2.0**53 + 2, -0.4999999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    few, many = ([r.v for r in rounded(df).collect()] for rounded in (queries._r, queries._r_many))
    assert few == many
    assert str(many[3]) == "0.0" and np.isnan(queries._r_many(df.select(F.lit(float("nan")).alias("v"))).first().v)


def test_few_cells_of_a_wide_block_are_measured_exactly(spark, monkeypatch):
    """Limits are set anew whenever the tiles double, so a row holds about k cells for each doubling, not k for each tile."""
    rng, k, n, cells = np.random.default_rng(8), 10, 12 * pairs.TILE, []
    x, y = rng.normal(size=(n, 16)), rng.normal(size=(n, 16))
    found, add = {}, pairs._Best.add
    monkeypatch.setattr(pairs, "_by_block", lambda df, work, schema, **more: found.update(work=work))
    monkeypatch.setattr(pairs._Best, "add", lambda self, at, to, d2: (cells.append(len(at)), add(self, at, to, d2))[1])
    pairs.nearest_by_blocks(spark.createDataFrame([], "id long, v array<double>"), k)
    side = lambda v, first, names: pa.table([pa.array(np.arange(first, first + n)), pa.array(list(v))], names=names)
    t = found["work"](side(x, 0, ["i", "a"]), side(y, n, ["j", "c"]), False)
    i, j, d = (t[c].to_numpy() for c in ("i", "j", "d"))
    assert len(i) == 2 * n * k
    far = np.sqrt(((x[:40, None] - y[None]) ** 2).sum(2))
    for row in range(40):
        at = np.flatnonzero(i == row)
        assert sorted(j[at] - n) == sorted(far[row].argsort()[:k])
        assert np.allclose(np.sort(d[at]), np.sort(far[row])[:k])
    assert sum(cells) < 2 * n * k * 6
