"""Hash trees that tell what changed, and spans of runs."""

from __future__ import annotations

import json
import random

import pytest

from tessera.study import contracts, durable, merkle, runner, tracing
from tests.test_study import plan


def corpus(spark, units, relations=(), metadata=None, parts=3):
    c = contracts.Corpus.of(spark, units, relations, metadata or {})
    return contracts.Corpus(c.units.repartition(parts), c.relations.repartition(parts), c.metadata)


def example(n=3000):
    units = [(f"u{i:05d}", f"text {i}", json.dumps({"n": i}), None) for i in range(n)]
    relations = [(f"u{i:05d}", f"u{(i * 7) % n:05d}", "rel", None) for i in range(n // 2)] + [("u00000", "u00001", "twice", None)] * 2 + [("u00000", "u00001", "twice", '{"a": 1}')]
    return units, relations


def test_the_root_follows_content_only(spark):
    units, relations = example()
    root, nodes = merkle.corpus_tree(corpus(spark, units, relations, {"m": 1}))
    mixed = random.Random(0).sample(units, len(units)), random.Random(1).sample(relations, len(relations))
    assert merkle.corpus_tree(corpus(spark, *mixed, {"m": 1}, parts=7))[0] == root
    others = [
        (units, relations, {"m": 2}), (units[:-1] + [("u02999", "other", '{"n": 2999}', None)], relations, {"m": 1}), (units, relations[:-1], {"m": 1}),
        (units, relations + [("u00000", "u00001", "twice", None)], {"m": 1}), (units, relations[1:], {"m": 1}), (units + [("v", "", None, None)], relations, {"m": 1}),
    ]
    roots = {merkle.corpus_tree(corpus(spark, *o))[0] for o in others}
    assert len(roots) == len(others) and root not in roots
    assert nodes.where("level = 0 AND part = 'units'").count() == 3000 and nodes.agg({"level": "max"}).first()[0] >= 1
    # equal relations are one leaf with a count, unequal ones under one key are two
    assert sorted(r.leaves for r in nodes.where("level = 0 AND first = '[\"u00000\",\"u00001\",\"twice\"]'").collect()) == [1, 2]
    empty = merkle.corpus_tree(corpus(spark, []))
    assert empty[1].count() == 0 and len(empty[0]) == 64


def test_what_changed_is_found_by_descent(spark):
    units, relations = example()
    old = merkle.corpus_tree(corpus(spark, units, relations))[1]
    new_units = [u for u in units if u[0] != "u00123"] + [("u99999", "new", None, None)]
    new_units[1500] = (new_units[1500][0], "changed text", new_units[1500][2], None)
    keep = [r for r in relations if "u00123" not in r[:2]]
    new = merkle.corpus_tree(corpus(spark, new_units, keep))[1]
    got = {(r.part, r.key, r.change) for r in merkle.changed(old, new).collect()}
    want = {("units", '["u00123"]', "removed"), ("units", '["u99999"]', "added"), ("units", json.dumps([new_units[1500][0]]), "changed")}
    want |= {("relations", json.dumps(list(r[:3]), separators=(",", ":")), "removed") for r in relations if r not in keep}
    assert got == want
    assert merkle.changed(old, old).count() == 0


def test_run_study_knows_its_corpus_by_the_tree(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self, *a, **k):
        raise AssertionError("rows pass through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    store = durable.RunStore(spark, f"file://{tmp_path}/runs")
    spans = tracing.TableTracer(spark, f"file://{tmp_path}/spans")
    result = runner.run_study(spark, plan(spark), store=store, run_id="one", spans=spans)
    tree = store.load("one")[2]["tree"]
    assert result.corpus.fingerprint == result.baseline.fingerprint == merkle.corpus_tree(result.corpus)[0]
    assert merkle.changed(tree, tree).count() == 0
    rows = {r.name: r for r in spans.table().collect()}
    assert set(rows) == {"ingest", "baseline", "discovery", "preregistration", "confirm", "adjudication", "adjudicate", "report"} and {r.run_id for r in rows.values()} == {"one"}
    assert all(r.status == "ok" and r.seconds >= 0 for r in rows.values())
    assert rows["ingest"].row_counts["units"] == 6 and rows["ingest"].row_counts["relations"] == 3 and rows["ingest"].jobs > 0
    drifted = runner.run_study(spark, plan(spark, prior_fingerprint="0" * 64))
    assert drifted.drift.drifted


def test_a_failed_phase_is_a_failed_span(spark, tmp_path):
    spans = tracing.TableTracer(spark, f"file://{tmp_path}/spans")
    with pytest.raises(ZeroDivisionError):
        runner.run_study(spark, plan(spark, build_baseline=lambda c, guard: 1 / 0), spans=spans, run_id="bad")
    rows = {r.name: r for r in spans.table().collect()}
    assert rows["ingest"].status == "ok" and rows["baseline"].status == "failed" and "ZeroDivisionError" in rows["baseline"].error and len(rows) == 2


def test_spans_nest_and_count(spark, tmp_path):
    t = tracing.bootstrap_tracing(spark, f"file://{tmp_path}/spans")
    try:
        with tracing.run_trace_context("r"), tracing.bootstrap_tracing().span("outer", kind="x") as outer, t.span("inner") as inner:
            inner.observe(spark.range(11), "eleven").write.format("noop").mode("overwrite").save()
        rows = {r.name: r for r in t.table().collect()}
        assert rows["inner"].parent_id == outer.span_id == rows["outer"].span_id and rows["outer"].parent_id is None
        assert rows["inner"].row_counts == {"eleven": 11} and rows["outer"].attributes == '{"kind": "x"}' and rows["outer"].jobs >= rows["inner"].jobs == 1
    finally:
        assert isinstance(tracing.bootstrap_tracing(spark), tracing.UnconfiguredTracer)
