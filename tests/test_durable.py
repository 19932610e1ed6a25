"""Commits, resumable runs, and the vector store: what survives a process, a crash, and another writer."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap

import pytest

from tessera.plans.versions import Conflict, Versions
from tessera.sources import stores
from tessera.study import contracts, durable, governance, methodology, provenance, runner
from tests.test_study import AUTHORITY, hypothesis, plan

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/a b")
    assert v.latest() is None and v.history() == []
    folder = v.folder()
    at = v.write(spark.range(3), folder, "t")
    v.commit(0, {"tables": {"t": at}})
    with pytest.raises(Conflict):
        v.commit(0, {"tables": {}})
    assert v.latest() == (0, {"tables": {"t": at}}) and v.table(at).count() == 3
    # a writer that died: a folder without a marker, and a marker that is not whole
    v.write(spark.range(9), v.folder(), "t")
    (tmp_path / "a b/_commits/000000000001.json").write_text("cut o")
    assert v.latest()[0] == 0 and v.numbers() == [0, 1]
    v.commit(2, {"tables": {"t": at}})
    assert v.latest()[0] == 2 and len(v.sweep()) == 1 and v.table(at).count() == 3


def gate(name="check"):
    return governance.Gate(name, governance.Phase.DISCOVERY, governance.Phase.PREREGISTER, frozenset([contracts.StudyMode.DISCOVERY]))


def example(spark, store, calls, trail):
    """Count, park, count on: each phase notes that it ran."""

    def first(state):
        calls.append("first")
        return {"rows": spark.range(state["n"]), "seen": 1}

    def last(state):
        calls.append("last")
        return {"total": state.tables["rows"].count() + state["seen"]}

    def build(b):
        b.phase("first", first, "check")
        b.phase("check", durable.make_gate_node(gate(), lambda s: {"rows": s.tables["rows"].count()}, recorder=trail.as_recorder()), lambda s: "last" if s.decision("check").approved else "first")
        b.phase("last", last)

    return durable.compile_graph(build, store=store, requires_store=True)


@pytest.mark.parametrize("kind", ["memory", "folder"])
def test_a_run_parks_and_is_resumed(spark, tmp_path, kind):
    store = durable.get_store(spark, f"file://{tmp_path}/runs", use_memory=kind == "memory")
    calls, trail = [], provenance.ProvenanceTrail()
    graph = example(spark, store, calls, trail)
    out = durable.run(graph, {"n": 4}, run_id="r1")
    assert out.parked == durable.Parked("check", {"rows": 4}) and not out.finished
    assert durable.run(graph, {"n": 99}, run_id="r1").parked == out.parked and calls == ["first"]
    for answer, what in (({"gate": "other", "approved": True}, "waits at"), ({"gate": "check", "approved": "yes"}, "approved true or false")):
        bad = durable.resume(graph, run_id="r1", **answer)
        assert what in bad.parked.error and not trail.entries
    # refused: back to the first phase, and asked again
    again = durable.resume(graph, run_id="r1", gate="check", approved=False, reason="too few")
    assert again.parked and calls == ["first", "first"] and [e.payload["approved"] for e in trail.entries] == [False]
    done = durable.resume(example(spark, store, calls, trail), run_id="r1", gate="check", approved=True)
    assert done.finished and done.state["total"] == 5 and calls == ["first", "first", "last"]
    assert durable.run(graph, run_id="r1").finished and len(calls) == 3
    with pytest.raises(governance.GateError, match="not parked"):
        durable.resume(graph, run_id="r1", gate="check", approved=True)
    with pytest.raises(KeyError):
        durable.resume(graph, run_id="none", gate="check", approved=True)


def test_a_gate_that_is_refused_for_ever_ends(spark):
    calls, trail = [], provenance.ProvenanceTrail()
    graph = example(spark, durable.MemoryStore(), calls, trail)
    durable.run(graph, {"n": 1}, run_id="r", limit=5)
    with pytest.raises(durable.StepLimitError):
        for _ in range(9):
            durable.resume(graph, run_id="r", gate="check", approved=False, limit=5)


def test_an_unrecorded_decision_does_not_count(spark):
    def broken(*a):
        raise OSError("disk")

    node = durable.make_gate_node(gate(), lambda s: {}, recorder=broken)
    graph = durable.compile_graph(lambda b: b.phase("check", node), store=durable.MemoryStore())
    durable.run(graph, run_id="r")
    with pytest.raises(governance.GateError, match="recorded"):
        durable.resume(graph, run_id="r", gate="check", approved=True)
    assert durable.run(graph, run_id="r").parked
    with pytest.warns(UserWarning, match="trail"):
        durable.make_gate_node(gate(), lambda s: {})
    with pytest.raises(ValueError, match="store"):
        durable.compile_graph(lambda b: b.phase("check", node), requires_store=True)
    with pytest.raises(ValueError, match="no such"):
        durable.compile_graph(lambda b: b.phase("a", node, "nowhere"))


def test_a_crash_before_the_marker_costs_one_phase(spark, tmp_path):
    store = durable.RunStore(spark, f"file://{tmp_path}/runs")
    calls, fail = [], [True]

    def first(state):
        calls.append("first")
        return {"rows": spark.range(5)}

    def second(state):
        calls.append("second")
        return {"more": state.tables["rows"].selectExpr("id * 2 AS id")}

    graph = durable.compile_graph(lambda b: b.phase("first", first, "second").phase("second", second), store=store)
    real = Versions.commit

    def dies(self, number, body):
        if number == 1 and fail:
            fail.clear()
            raise KeyboardInterrupt  # the tables of the second phase are written, its marker is not
        real(self, number, body)

    Versions.commit = dies
    try:
        with pytest.raises(KeyboardInterrupt):
            durable.run(graph, run_id="r")
    finally:
        Versions.commit = real
    out = durable.run(graph, run_id="r")
    assert calls == ["first", "second", "second"] and out.finished and out.state.tables["more"].count() == 5
    rows = [(r.run_id, r.number, r.phase, r.next, r.parked, r.tables) for r in store.commits().orderBy("number").collect()]
    assert rows == [("r", 0, "first", "second", None, '["rows"]'), ("r", 1, "second", None, None, '["more"]')]


def test_two_processes_cannot_both_take_a_step(spark, tmp_path):
    store = durable.RunStore(spark, f"file://{tmp_path}/runs")
    inner = durable.compile_graph(lambda b: b.phase("only", lambda s: {"by": "inner"}), store=store)

    def slow(state):
        durable.run(inner, run_id="r")  # another process is faster
        return {"by": "outer"}

    with pytest.raises(Conflict):
        durable.run(durable.compile_graph(lambda b: b.phase("only", slow), store=store), run_id="r")
    assert durable.run(inner, run_id="r").state["by"] == "inner"
    with pytest.raises(ValueError):
        durable.run(inner, run_id="../r")


def test_run_study_is_resumed_without_redoing_phases(spark, tmp_path):
    store = durable.RunStore(spark, f"file://{tmp_path}/runs")
    built = []

    def baseline(c, guard):
        built.append(c.units.count())
        return contracts.build_baseline_artifact(c, {"n": c.units.groupBy().count()})

    p = plan(spark, build_baseline=baseline)
    asked = []

    def ask(review):
        asked.append(review.gate)
        return governance.GateDecision(True, review.gate) if review.gate == "preregistration" else None

    secret = b"k" * 16
    first = runner.run_study(spark, p, store=store, run_id="s", gate_handler=ask, trail=provenance.ProvenanceTrail(secret=secret))
    assert first.parked.gate == "adjudication" and len(first.verdicts) == 1 and first.scorecard is None and built == [6]
    with pytest.raises(provenance.ProvenanceError):  # the trail goes on under its key only
        runner.run_study(spark, p, store=store, run_id="s", trail=provenance.ProvenanceTrail())
    with pytest.raises(governance.GateError, match="refused"):
        runner.run_study(spark, p, store=store, run_id="s", gate_handler=runner.answering({"adjudication": {"approved": False, "reason": "no"}}), trail=provenance.ProvenanceTrail(secret=secret))
    done = runner.run_study(spark, p, store=store, run_id="s", gate_handler=runner.answering({"adjudication": {"approved": True}}), trail=provenance.ProvenanceTrail(secret=secret))
    assert done.parked is None and built == [6] and asked == ["preregistration", "adjudication"]
    whole = runner.run_study(spark, plan(spark))
    assert [(v.hypothesis_id, v.label) for v in done.verdicts] == [(v.hypothesis_id, v.label) for v in whole.verdicts] and done.scorecard == whole.scorecard
    assert done.trail.verify() and [e.kind for e in done.trail.entries] == [e.kind for e in whole.trail.entries]
    assert done.baseline.contents["n"].first()[0] == 6


def test_a_gate_checks_its_precondition(spark):
    loose = plan(spark, discover=lambda c: [hypothesis()])  # never locked
    with pytest.raises(methodology.PreRegistrationError):
        runner.run_study(spark, loose)


def test_resumed_in_another_process(spark, tmp_path):
    """The first process ends at the gate; a second one, with its own session, finishes the run."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        from tessera.study import contracts, durable, governance
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        P, M = governance.Phase, contracts.StudyMode
        gate = governance.Gate("check", P.DISCOVERY, P.PREREGISTER, frozenset([M.DISCOVERY]))
        def first(state):
            print("RAN first", flush=True)
            return {{"rows": spark.range(7)}}
        def build(b):
            b.phase("first", first, "check")
            b.phase("check", durable.make_gate_node(gate, lambda s: {{}}, recorder=lambda *a: None), "last")
            b.phase("last", lambda s: {{"total": s.tables["rows"].count()}})
        graph = durable.compile_graph(build, store=durable.RunStore(spark, "file://{tmp_path}/runs"))
        out = durable.run(graph, run_id="x") if sys.argv[1] == "run" else durable.resume(graph, run_id="x", gate="check", approved=True)
        print("PARKED" if out.parked else f"TOTAL {{out.state['total']}}", flush=True)
    """)
    said = [subprocess.run([sys.executable, "-c", code, what], capture_output=True, text=True, timeout=300).stdout for what in ("run", "resume")]
    assert "RAN first" in said[0] and "PARKED" in said[0]
    assert "RAN first" not in said[1] and "TOTAL 7" in said[1]


def test_locks_are_final_and_proofs_attest_their_digest():
    h = methodology.lock_hypothesis(hypothesis(), authority=AUTHORITY)
    from dataclasses import replace

    for changed in (h, replace(h, statement="other"), replace(h, locked_at=None), replace(h, timestamp_proof=None)):
        with pytest.raises(methodology.PreRegistrationError, match="locked already"):
            methodology.lock_hypothesis(changed, authority=AUTHORITY)

    class Careless:
        def verify(self, digest, proof):
            return methodology.VerifiedTimestamp(h.locked_at, "careless", "0" * 64)

    with pytest.raises(methodology.PreRegistrationError, match="another hypothesis"):
        methodology.verify_preregistration(h, authority=Careless())
    other = methodology.LocalHmacAuthority(b"fedcba9876543210")
    for proof in ("", "{}", "[1]", '{"digest": 1, "micros": 1e400, "mac": ""}', other.stamp(methodology.canonical_hypothesis_digest(h)), h.timestamp_proof.replace("micros", "nanos")):
        with pytest.raises(methodology.PreRegistrationError):
            AUTHORITY.verify(methodology.canonical_hypothesis_digest(h), proof)


def test_records_of_hypotheses_and_verdicts():
    h = methodology.lock_hypothesis(hypothesis(alpha=0.01, predicted_direction="less", params=(("k", 3),)), authority=AUTHORITY)
    assert methodology.hypothesis_of(methodology.record_of(h)) == h
    v = methodology.verdict_from_pvalue(h, 0.001)
    assert methodology.verdict_of(methodology.record_of(v)) == v


def test_trail_payloads_survive_a_file():
    trail = provenance.ProvenanceTrail()
    for bad in ({"s": {1}}, {"d": {1: "x"}}, {"x": float("nan")}, {"b": b"x"}):
        with pytest.raises(provenance.ProvenanceError):
            trail.record("k", "s", bad)
    trail.record("k", "s", {"t": (1, 2), "u": None})
    more = provenance.ProvenanceTrail()
    more.restore(trail.to_records())
    more.record("k", "s")
    assert more.verify() and len(more.entries) == 2
    with pytest.raises(provenance.ProvenanceError, match="of its own"):
        more.restore(trail.to_records())


def vectors(spark, *rows):
    return spark.createDataFrame(list(rows), "ref string, v array<double>")


def test_vector_store(spark, tmp_path):
    t = stores.VectorTable(spark, f"file://{tmp_path}/v", 2)
    with pytest.raises(ValueError, match="empty"):
        t.query([1.0, 0.0], 1)
    t.upsert(vectors(spark, ("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])))
    assert sorted((r.ref, r.v) for r in t.rows().collect()) == [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])]
    for bad in ((None, [1.0, 1.0]), ("c", None), ("c", [1.0]), ("c", [1.0, float("nan")]), ("c", [None, 1.0]), ("c", [float("inf"), 1.0])):
        with pytest.raises(ValueError, match="finite"):
            t.upsert(vectors(spark, ("ok", [1.0, 1.0]), bad))
    assert t.rows().count() == 3
    # an unfinished generation beside good ones is not read
    os.makedirs(tmp_path / "v/data-dead/rows/_temporary")
    t.upsert(vectors(spark, ("b", [1.0, 1.0]), ("c", [-1.0, 0.0])))
    assert [(r.ref, round(r.score, 3)) for r in t.query([1.0, 0.0], 9).collect()] == [("a", 1.0), ("b", 0.707), ("z", 0.0), ("c", -1.0)]
    before = t.query([1.0, 0.0], 9).collect()
    t.compact()
    assert t.query([1.0, 0.0], 9).collect() == before
    with pytest.raises(ValueError, match="components"):
        stores.VectorTable(spark, f"file://{tmp_path}/v", 3).rows()
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id long, v array<double>")
    got = sorted((r.query_id, r["r"], r.ref, round(r.score, 3)) for r in t.query_many(asked, 2).collect())
    assert got == [(1, 1, "a", 1.0), (1, 2, "b", 0.707), (2, 1, "b", 0.707), (2, 2, "a", 0.0)]


def test_two_writers_of_vectors_both_count(spark, tmp_path):
    t, other = (stores.VectorTable(spark, f"file://{tmp_path}/v", 1) for _ in range(2))
    real, once = t._versions.commit, [True]

    def slow(number, body):
        if once:
            once.clear()
            other.upsert(vectors(spark, ("x", [2.0]), ("y", [2.0])))
        real(number, body)

    t._versions.commit = slow
    t.upsert(vectors(spark, ("x", [1.0])))
    assert sorted((r.ref, r.v[0]) for r in t.rows().collect()) == [("x", 1.0), ("y", 2.0)]
