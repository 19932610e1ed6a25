"""The inverted index against scores of every document."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.operators.inverted_index import InvertedIndex
from tessera.plans.versions import Versions

DOCS = "doc_id long, text string"


def corpus(n=700):
    """Common words everywhere, rare words in few documents, copies, an empty and a null text."""
    docs = []
    for i in range(n):
        words = ["the", "of"] * (1 + i % 9) + [f"w{(i * j) % 53}" for j in range(1, 4 + i % 40)] + [f"rare{i // 60}"] * (i % 60 == 0)
        docs.append((i, " ".join(words)))
    return [*docs, (n, docs[7][1]), (n + 1, docs[7][1]), (n + 2, ""), (n + 3, None), (n + 4, "The THE the")]


def brute(docs, query, k, score):
    split = {i: Counter((t or "").lower().split()) for i, t in docs}
    n, size = len(split), {i: sum(c.values()) for i, c in split.items()}
    df = Counter(t for c in split.values() for t in c)
    mean = sum(size.values()) / n
    q = Counter(query.lower().split())
    idf = {t: math.log((n + 1) / (df[t] + 1)) + 1 for t in df}
    out = []
    for i, c in split.items():
        if score == "bm25":
            s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[i] / mean)) * m for t, m in q.items() if c[t])
        else:
            w = {t: m / size[i] * idf[t] for t, m in c.items()}
            u = {t: m / sum(m for t, m in q.items() if t in idf or True) * idf[t] for t, m in q.items() if t in idf}
            norms = math.sqrt(sum(x * x for x in w.values()) * sum(x * x for x in u.values()))
            s = sum(w.get(t, 0) * x for t, x in u.items()) / norms if norms else 0.0
        out.append((round(s, 10), i))
    out.sort(key=lambda x: (-x[0], x[1]))
    return [i for _, i in out[:k]], [s for s, _ in out[:k]]


QUERIES = [(1, "the rare3 w5"), (2, "rare9"), (3, "the of the"), (4, "unknown words"), (5, ""), (6, None), (7, "W1 w2 w3 w4 w5 w6 the"), (8, "rare0 rare1 rare2 rare3")]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('index')}"
    InvertedIndex.build(spark.createDataFrame(corpus(), DOCS), where, block=16)
    return where


@pytest.mark.parametrize(("score", "k"), [("bm25", 1), ("bm25", 900), ("tfidf", 7)])
def test_top_k_is_that_of_all_scores(spark, path, score, k):
    docs, index = corpus(), InvertedIndex(spark, path)
    rows = index.top_k(spark.createDataFrame(QUERIES, "query_id long, text string"), k, score=score).orderBy("query_id", "rank").collect()
    for q, text in QUERIES:
        ids, scores = brute(docs, text or "", k, score)
        got = [r for r in rows if r.query_id == q]
        assert [r["rank"] for r in got] == list(range(1, len(ids) + 1))
        assert [r.score for r in got] == pytest.approx(scores, abs=1e-9)
        assert [r.doc_id for r in got] == ids
    if k == 1:
        assert index.opened[0] < index.opened[1] / 2  # bounds leave most blocks closed


def test_one_query_agrees_with_the_scan(spark, path):
    docs, index = spark.createDataFrame(corpus(), DOCS), InvertedIndex(spark, path)
    for score, scan in (("bm25", ranking.bm25_score), ("tfidf", ranking.tfidf_score)):
        want = {r.doc_id: r.score for r in scan(docs, "the rare3 w5").collect()}
        got = index.top_k(spark.createDataFrame([(1, "the rare3 w5")], "query_id long, text string"), 20, score=score).collect()
        assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) for r in got)


def test_readers_see_whole_indexes(spark, tmp_path):
    path = f"file://{tmp_path}"
    with pytest.raises(ValueError, match="no index"):
        InvertedIndex(spark, path)
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], DOCS)
    InvertedIndex.build(docs, path)
    Versions(spark, path).write(docs, Versions(spark, path).folder(), "postings")  # a build that died
    ask = spark.createDataFrame([(1, "b")], "query_id long, text string")
    assert sorted(r.doc_id for r in InvertedIndex(spark, path).top_k(ask, 5).collect()) == [1, 2]
    InvertedIndex.build(docs.where("doc_id = 1"), path)
    assert [r.doc_id for r in InvertedIndex(spark, path).top_k(ask, 5).collect()] == [1]


def test_refusals(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "b")], DOCS)
    with pytest.raises(ValueError, match="unique"):
        InvertedIndex.build(docs, f"file://{tmp_path}/x")
    index = InvertedIndex.build(docs.limit(0), f"file://{tmp_path}/y")
    ask = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert index.top_k(ask, 3).count() == 0
    for bad in (lambda: index.top_k(ask, 0), lambda: index.top_k(ask, 1, score="x"), lambda: index.top_k(ask.union(ask), 1)):
        with pytest.raises(ValueError):
            bad()


def test_postings_are_counted_where_documents_are_read(spark):
    docs = [(1, "b a b"), (2, None), (3, ""), (4, "A a")]
    counted = ranking.counted_terms(spark.createDataFrame(docs, DOCS), "doc_id", "text")
    rows = {r.doc_id: (r.len, dict(zip(r.terms, r.counts, strict=True))) for r in counted.collect()}
    assert rows == {1: (3, {"a": 1, "b": 2}), 2: (0, {}), 3: (0, {}), 4: (2, {"a": 2})}
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("frequent", [1, 3, 20, 10**6])
def test_only_rare_terms_move_to_their_weights(spark, frequent):
    docs = spark.createDataFrame(corpus(), DOCS)
    want = {i: s for s, i in zip(*brute(corpus(), "the rare3 w5", 10**6, "tfidf")[::-1], strict=True)}
    got = {r.doc_id: r.score for r in ranking.tfidf_score(docs, "the rare3 w5", frequent=frequent).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_bounds_are_those_of_the_postings(spark, path):
    index = InvertedIndex(spark, path)
    sums = index.postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("bm25").alias("bm25"), F.max("tfidf").alias("tfidf"))
    want = {(r.term, r.block): (r.n, r.bm25, r.tfidf) for r in sums.collect()}
    assert {(r.term, r.block): (r.n, r.bm25, r.tfidf) for r in index.bounds.collect()} == want


def test_rounds_move_postings_once(spark, tmp_path, monkeypatch):
    """Postings of the queries' terms are dealt by block before the first round; later rounds sum them without another shuffle."""
    from tessera.plans.scratch import Scratch

    plans, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, *a, **k: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), table(self, df, name, *a, **k))[1])
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 3 + i % 9))) for i in range(400)], "doc_id long, text string")
    InvertedIndex.build(docs, str(tmp_path / "i"), block=8)
    queries = spark.createDataFrame([(0, "w1 w2 w3"), (1, "w5"), (2, "w16 w4 w4")], "query_id long, text string")
    got = InvertedIndex(spark, str(tmp_path / "i")).top_k(queries, 40, score="tfidf")
    assert got.count() == 120
    rounds = [p for name, p in plans if name.startswith("best")]
    assert rounds and all("InMemoryRelation" in p and "RepartitionByExpression [block" not in p.split("InMemoryRelation")[0] for p in rounds)
