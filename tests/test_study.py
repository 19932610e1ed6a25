"""Contracts, firewalls, verdicts, provenance and the runner."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.sources import guards, reasoning, stores
from tessera.sources.corpora import TableParser
from tessera.streaming import windowed_stats
from tessera.study import contracts, governance, methodology, provenance, runner
from tessera.study.canonical import hash_value, stable_seed

AUTHORITY = methodology.LocalHmacAuthority(b"0123456789abcdef")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "unit_id string")


def corpus(spark, n=6):
    return contracts.Corpus.of(spark, [(f"u{i}", f"text {i}", "{}", None) for i in range(n)], [("u0", "u1", "rel", None), ("u4", "u5", "rel", None), ("u0", "u5", "rel", None)])


def hypothesis(**kw):
    base = dict(hypothesis_id="h1", statement="s", kind=methodology.HypothesisKind.UNIT_LEVEL, origin=methodology.HypothesisOrigin.DISCOVERY, test_name="t", decision_rule="r")
    return methodology.Hypothesis(**{**base, **kw})


def test_fingerprint_is_pinned(spark):
    c = contracts.Corpus.of(spark, [("u2", "beta", None, None), ("u1", "alpha", '{"n": 1}', None)], [("u1", "u2", "rel", None)], {"src": "fixed"})
    assert contracts.corpus_fingerprint(c) == "d4a4b7123ba6248e56e6287aa35774d81db8996de9f1ce630e2fa3bff75f9566"
    again = contracts.Corpus(c.units.repartition(3), c.relations, c.metadata)
    assert contracts.corpus_tree_fingerprint(c) == contracts.corpus_tree_fingerprint(again)


def test_canonical_values():
    assert hash_value({1: "a"}) != hash_value({"1": "a"}) and hash_value((1, 2)) == hash_value([1, 2]) and hash_value({1, 2}) == hash_value({2, 1})
    with pytest.raises(TypeError):
        hash_value(object())
    assert stable_seed("a", "b") == stable_seed("a", "b") != stable_seed("ab")


def test_corpus_checks(spark):
    with pytest.raises(ValueError, match="duplicate"):
        contracts.Corpus.of(spark, [("a", "", None, None), ("a", "", None, None)])
    with pytest.raises(ValueError, match="unknown"):
        contracts.Corpus.of(spark, [("a", "", None, None)], [("a", "b", "r", None)])
    sub = contracts.subset_corpus(corpus(spark), ids(spark, "u0", "u1", "u5"))
    assert sub.units.count() == 3 and sub.relations.count() == 2
    with pytest.raises(ValueError, match="finite"):
        contracts.FeatureMatrix(spark.createDataFrame([("a", float("nan"))], "unit_id string, f double"))


def test_firewalls(spark):
    split = methodology.DiscoverConfirmSplit(ids(spark, "u0"), ids(spark, "u1", "u2"))
    split.assert_confirm_only(ids(spark, "u1"))
    for bad, what in ((ids(spark), "no units"), (ids(spark, "u0"), "discovery"), (ids(spark, "x"), "unknown")):
        with pytest.raises(methodology.FirewallViolation, match=what):
            split.assert_confirm_only(bad)
    with pytest.raises(methodology.FirewallViolation):
        methodology.DiscoverConfirmSplit(ids(spark, "u0"), ids(spark, "u0"))
    guard = methodology.ClaimBlindGuard([contracts.ClaimRecord("c", "s", ())])
    with guard.sealed(), pytest.raises(methodology.FirewallViolation):
        guard.release()
    assert len(guard.release()) == 1
    with pytest.raises(methodology.FirewallViolation):
        methodology.Measurement([methodology.Interpretation(1, "", "me")], "p", "h")


def test_preregistration():
    early = datetime(2024, 1, 1, tzinfo=UTC)
    h = methodology.lock_hypothesis(hypothesis(), authority=AUTHORITY, instant=early)
    methodology.require_preregistered(h, authority=AUTHORITY, not_after=early + timedelta(seconds=1))
    with pytest.raises(methodology.PreRegistrationError):
        methodology.require_preregistered(h, authority=AUTHORITY, not_after=early)
    with pytest.raises(methodology.PreRegistrationError):
        methodology.verify_preregistration(replace(h, statement="other"), authority=AUTHORITY)
    with pytest.raises(methodology.PreRegistrationError):
        methodology.verify_preregistration(hypothesis(), authority=AUTHORITY)
    with pytest.raises(ValueError):
        hypothesis(alpha=0.7)


CASES = [
    (10.0, [0.0] * 100, [10.0] * 20, "greater", 0.05, "supported"),
    (0.0, [10.0] * 100, [0.0] * 20, "greater", 0.05, "contradicted"),
    (10.0, [0.0] * 100, [], "greater", 0.05, "indeterminate"),
    (10.0, [0.0] * 100, [-1.0] * 20, "greater", 0.05, "indeterminate"),
    (5.0, [float(i) for i in range(100)], [5.0] * 20, "less", 0.01, "indeterminate"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_whole_corpus_verdicts(spark, case):
    observed, null, resamples, direction, alpha, want = CASES[case]
    h = methodology.lock_hypothesis(hypothesis(kind=methodology.HypothesisKind.WHOLE_CORPUS, predicted_direction=direction, alpha=alpha), authority=AUTHORITY)
    one = methodology.confirm_whole_corpus(h, observed, null, resamples or None, authority=AUTHORITY)
    assert one.label.value == want
    table = methodology.whole_corpus_table(
        spark.createDataFrame([("h1", observed, direction)], "hypothesis_id string, value double, direction string"),
        spark.createDataFrame([("h1", x) for x in null], "hypothesis_id string, value double"),
        spark.createDataFrame([("h1", x) for x in resamples], "hypothesis_id string, value double"),
        alpha=alpha,
    ).first()
    assert table.label == want and table.p_value == pytest.approx(one.evidence["p_value"])
    assert table.stability == one.evidence["stability"]


def test_scores(spark):
    rows = spark.createDataFrame([("a", "supported"), ("a", "contradicted"), ("a", "supported"), ("b", "indeterminate")], "source string, label string")
    got = {r.source: (r.n_supported, r.n_contradicted, r.n_indeterminate, r.alignment_rate) for r in methodology.score_table(rows).collect()}
    assert got["a"] == (2, 1, 0, pytest.approx(2 / 3)) and got["b"] == (0, 0, 1, None)


def test_provenance(spark):
    trail = provenance.ProvenanceTrail(secret=b"s" * 16)
    for i in range(4):
        trail.record("step", f"step {i}", {"i": i})
    assert trail.verify() and provenance.from_records(trail.to_records(), secret=b"s" * 16).head == trail.head
    assert not provenance.verify_records(trail.to_records())
    bad = trail.to_records()
    bad[2]["summary"] = "other"
    assert not provenance.verify_records(bad, secret=b"s" * 16)
    table = trail.to_table(spark).withColumn("trail", F.lit("t"))
    assert provenance.broken_links(table, secret=b"s" * 16).count() == 0
    assert [r.seq for r in provenance.broken_links(table.withColumn("summary", F.when(F.col("seq") == 1, "x").otherwise(F.col("summary"))), secret=b"s" * 16).collect()] == [1]
    with pytest.raises(provenance.ProvenanceError):
        trail.record("x", "y", {"s": {1}})


def test_governance():
    P, M = governance.Phase, contracts.StudyMode
    assert governance.required_phases([M.DISCOVERY]) == (P.INGEST, P.BASELINE, P.DISCOVERY, P.PREREGISTER, P.CONFIRM, P.REPORT)
    assert governance.legal_transition(P.BASELINE, P.ADJUDICATE, [M.ADJUDICATE_EXTERNAL_CLAIMS]) and not governance.legal_transition(P.INGEST, P.REPORT, [M.DISCOVERY])
    gate = governance.Gate("g", P.DISCOVERY, P.PREREGISTER, frozenset([M.DISCOVERY]))
    with pytest.raises(governance.GateError):
        gate.evaluate({}, governance.GateDecision(True, "g"))
    assert gate.evaluate({}, governance.apply_gate_decision(gate, {"approved": True}), lambda *a: None).approved
    governance.clear_registry()
    governance.register_study("a", lambda: 1)
    assert governance.get_study("a") == 1 and governance.registered_studies() == ("a",)


class Parser:
    def parse(self, spark, path):
        return corpus(spark)

    def source_fingerprint(self, spark, path):
        return "source"


class Claims:
    def claims(self):
        return [contracts.ClaimRecord("c1", "u0", ("u1",)), contracts.ClaimRecord("c2", "u1", ())]

    def claim_fingerprint(self):
        return contracts.claim_set_fingerprint(self.claims())


def plan(spark, **kw):
    both = frozenset(contracts.StudyMode)
    study = contracts.StudyDefinition("study", both, Parser(), claims_source=Claims())

    def stated(c):
        h = hypothesis(hypothesis_id=f"h-{c.claim_id}", origin=methodology.HypothesisOrigin.EXTERNAL_CLAIM, source_claim_id=c.claim_id)
        return methodology.lock_hypothesis(h, authority=AUTHORITY, instant=datetime(2024, 1, 1, tzinfo=UTC))

    base = dict(
        study=study, source="x", authority=AUTHORITY,
        build_baseline=lambda c, guard: contracts.build_baseline_artifact(c, {"n": c.units.groupBy().count()}),
        split=lambda c: methodology.DiscoverConfirmSplit(ids(spark, "u0", "u1", "u2"), ids(spark, "u3", "u4", "u5")),
        discover=lambda c: [methodology.lock_hypothesis(hypothesis(), authority=AUTHORITY, instant=datetime(2024, 1, 1, tzinfo=UTC))],
        confirm=lambda h, c: methodology.verdict_from_pvalue(h, 0.2),
        hypothesis_for=stated,
        confirm_claim=lambda h, baseline, c: methodology.verdict_from_pvalue(h, 0.01, favourable=c.claim_id == "c1"),
    )
    return runner.StudyPlan(**{**base, **kw})


def test_claims_are_locked_before_the_baseline(spark):
    """A hypothesis that is locked when the baseline exists is refused before it is judged; so is one that states no claim."""
    asked = []

    def late(c):
        return methodology.lock_hypothesis(hypothesis(hypothesis_id=f"h-{c.claim_id}", origin=methodology.HypothesisOrigin.EXTERNAL_CLAIM, source_claim_id=c.claim_id), authority=AUTHORITY)

    def surfaced(c):
        return methodology.lock_hypothesis(hypothesis(hypothesis_id=f"h-{c.claim_id}"), authority=AUTHORITY, instant=datetime(2024, 1, 1, tzinfo=UTC))

    for bad, what in ((late, methodology.PreRegistrationError), (surfaced, methodology.FirewallViolation)):
        with pytest.raises(what):
            runner.run_study(spark, plan(spark, hypothesis_for=bad, confirm_claim=lambda h, baseline, c: asked.append(h)))
    with pytest.raises(methodology.FirewallViolation, match="no verdict"):
        runner.run_study(spark, plan(spark, confirm_claim=lambda h, baseline, c: None))
    assert not asked


def test_run_study(spark, tmp_path):
    result = runner.run_study(spark, plan(spark))
    assert [v.label.value for v in result.verdicts] == ["indeterminate", "supported", "contradicted"]
    assert result.scorecard.alignment_rate == 0.5 and result.trail.verify()
    result.persist_trail(str(tmp_path / "trail.json"))
    assert runner.verdict_table(spark, result.verdicts).count() == 3


def test_run_study_keeps_its_lines(spark):
    peeking = plan(spark, build_baseline=lambda c, guard: guard.release())
    trail = provenance.ProvenanceTrail()
    with pytest.raises(methodology.FirewallViolation):
        runner.run_study(spark, peeking, trail=trail)
    assert trail.entries[-1].kind == "run_failed"
    with pytest.raises(governance.GateError):
        runner.run_study(spark, plan(spark), gate_handler=lambda r: governance.GateDecision(False, r.gate, "no"))


def test_stores(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("hello")
    v = stores.LocalDataVersioner(str(tmp_path / "store"))
    assert v.put(str(f)) == v.put(str(f)) == v.fingerprint(str(f))
    with pytest.raises(ValueError):
        v.path_for("../x")
    assert stores.fingerprint_files(spark, str(f)).first().sha256 == v.fingerprint(str(f))
    t = stores.VectorTable(spark, f"file://{tmp_path}/vectors", 2)
    t.upsert(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "ref string, v array<double>"))
    t.upsert(spark.createDataFrame([("b", [1.0, 1.0])], "ref string, v array<double>"))
    assert [(r.ref, round(r.score, 3)) for r in t.query([1.0, 1.0], 2).collect()] == [("b", 1.0), ("a", 0.707)]
    e = stores.ExperimentTable(spark, f"file://{tmp_path}/runs")
    run = e.start_run("x", {"a": 1})
    e.log(run, {"m": 0.5})
    e.end_run(run)
    assert e.table().count() == 5


def test_parser_guards_and_seam(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "unit_id string, text string, n int").write.parquet(path)
    p = TableParser(attributes=("n",))
    assert p.parse(spark, path).units.orderBy("unit_id").first().attributes == '{"n":1}' and len(p.source_fingerprint(spark, path)) == 64
    guards.require_loopback_url("http://127.0.0.1:80/x")
    remote = (
        "http://example.com", "postgresql://u:p@10.0.0.1/db", "host=evil.example dbname=x", "hostaddr = '8.8.8.8'", "host=localhost,evil.example", "host=/tmp,evil.example",
        "service=elsewhere", "postgresql://localhost/db?host=evil.example", "postgresql://localhost/db?service=x", "postgresql://localhost,evil.example/db", "postgresql://u@evil.example:1@localhost/db",
        "postgresql://@/db", "postgresql:", "http://localhost\\@evil.example/", "\\\\evil\\share", "//evil/share", "/\\evil/share", "http://[::1/x",
    )
    for bad in remote:
        with pytest.raises(guards.NonLocalEndpointError):
            guards.require_local_uri(bad)
    for good in ("/data/x", "file:///data/x", "sqlite:///x.db", "runs/part=1/x", "host=localhost dbname=x", "host='/var/run/db' user=u", "postgresql://u:p@127.0.0.1:5432,[::1]:5432/db?host=/tmp", "C:\\data"):
        assert guards.require_local_uri(good) == good
    assert "secret" not in guards.redact_credentials("postgresql://u:secret@h/db password=secret")
    assert reasoning.extract_json('so {"a": [1, "}"]} end') == {"a": [1, "}"]}
    assert reasoning.first_balanced_json('x {not json} then [1,2]') == "{not json}" and reasoning.first_balanced_json('["a\\"]", [1]] x') == '["a\\"]", [1]]'
    assert reasoning.first_balanced_json("none") is None and reasoning.first_balanced_json('{"open') is None and reasoning.first_balanced_json("{" * 50_000) is None
    for bad in ("x {not json} then [1,2]", "none", '{"cut'):
        with pytest.raises(reasoning.ReasoningError):
            reasoning.extract_json(bad)
    answers = iter(["no", '{"x": 1}'])
    seam = reasoning.ReasoningSeam({reasoning.StakesTier.BULK: lambda r: next(answers)}, sleep=lambda s: None)
    assert seam.run_json(reasoning.ReasoningRequest("p")) == {"x": 1}
    with pytest.raises(reasoning.PermanentReasoningError):
        reasoning.UnconfiguredReasoningSeam().run(reasoning.ReasoningRequest("p"))


def test_windowed_stats(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert windowed_stats(events).agg(F.sum("n")).first()[0] == events.count()
