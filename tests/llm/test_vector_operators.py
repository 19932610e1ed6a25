"""Vector search and near-duplicates against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, vector_dedup


def vectors():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 16))
    out = [list(map(float, x)) for x in base]
    for k in range(120):
        out.append(list(map(float, base[k % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2]))))
    out += [out[3]] * 9 + [[0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, None, [], [1.0, 2.0], [2.0, 4.0], [float("inf")] + [0.0] * 15]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def rows():
    return vectors()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id string").repartition(3)


def usable(rows, size=16):
    return [(i, np.array(v)) for i, v in rows if v and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def exact(rows, threshold):
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for size in (16, 2):
        good = usable(rows, size)
        for a, (i, x) in enumerate(good):
            for j, y in good[:a]:
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    lo, hi = sorted((root(i), root(j)))
                    parent[hi] = lo
    return {i: (links[i], root(i)) for i, _ in rows}


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_duplicates(table, rows, monkeypatch, chunk):
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    want = exact(rows, 0.9)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(table).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_calibrated_lists_find_pairs_at_the_threshold():
    lists = vector_dedup.calibrate(50_000, 0.9)
    assert lists.least > 0 and len(lists.picks) < 200


def test_search_recall_and_order(table, rows):
    got = ann.search(table, F.col("vec_id") % 5 == 0).collect()
    good = usable(rows)
    unit = {i: x / np.linalg.norm(x) for i, x in good}
    hits = total = 0
    for q, x in unit.items():
        if q % 5:
            continue
        best = sorted((-float(x @ y), i) for i, y in unit.items() if i != q)[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert all(abs(s - float(x @ unit[v])) < 1e-12 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {i for _, i in best})
        total += 5
    assert hits >= 0.9 * total


def test_ties_at_the_last_rank_go_to_smaller_ids():
    """40 different vectors with one cosine; the smallest ids come last in the block."""
    block = np.vstack([2 * np.eye(40), -np.eye(40)[:5]])
    owners = [[39 - i] for i in range(40)] + [[100 + i] for i in range(5)]
    for k in (3, 6, 20):
        got = ann._best([b"q"], np.ones((1, 40)), block, owners, k, pa.int64()).to_pydict()
        assert got["vec_id"] == list(range(k)) and set(got["node"]) == {b"q"}
        assert np.allclose(got["score"], 40**-0.5)


def test_odd_tables(spark, table):
    empty = table.limit(0)
    assert ann.search(empty, F.col("vec_id") % 5 == 0).count() == 0
    assert vector_dedup.near_duplicates(empty).count() == 0
    two = spark.createDataFrame([(5, [1.0, 0.0]), (7, [1.0, 0.0]), (9, None)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(two, F.col("vec_id") % 5 == 0).collect()] == [(5, 1, 7, 1.0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(two).collect()}
    assert got == {5: (1, 5, True), 7: (1, 5, False), 9: (0, 9, True)}


def test_partition_is_balanced():
    rng = np.random.default_rng(3)
    x = vector_dedup.unit(rng.standard_normal((800, 8)))
    part = ann.balanced_partition(x, ann.neighbours(x, x, 6), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(ann.SLACK * 100)
