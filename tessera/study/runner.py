"""The governed run: ingest, blind baseline, discovery and confirmation, adjudication, report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.scratch import Scratch
from tessera.study import durable
from tessera.study.contracts import (
    BaselineArtifact,
    BaselineDriftReport,
    ClaimRecord,
    Corpus,
    DeterminismRecord,
    FeatureMatrix,
    StudyDefinition,
    StudyMode,
    claim_set_fingerprint,
    diff_baseline_fingerprints,
)
from tessera.study.durable import Graph, GraphBuilder, MemoryStore, Parked, RunState, RunStore, compile_graph, make_gate_node
from tessera.study.governance import Gate, GateDecision, GateError, Phase, required_phases
from tessera.study.merkle import corpus_tree
from tessera.study.methodology import (
    ClaimBlindGuard,
    DiscoverConfirmSplit,
    FirewallViolation,
    Hypothesis,
    SourceScorecard,
    TimestampAuthority,
    Verdict,
    adjudicate_with_baseline,
    confirm_hypotheses,
    discover_hypotheses,
    hypothesis_of,
    record_of,
    verdict_of,
    verify_preregistration,
)
from tessera.study.provenance import ProvenanceTrail
from tessera.study.tracing import Tracer, bootstrap_tracing, run_trace_context


class IngestionError(RuntimeError):
    """The source did not parse into a corpus."""


@dataclass(frozen=True)
class GateReview:
    """What a gate handler sees."""

    gate: str
    payload: tuple[tuple[str, Any], ...] = ()

    def payload_dict(self) -> dict[str, Any]:
        return dict(self.payload)


def auto_approve(review: GateReview) -> GateDecision:
    return GateDecision(True, review.gate, "approved without review")


@dataclass(frozen=True)
class StudyPlan:
    """A study and the callables its modes need."""

    study: StudyDefinition
    source: str
    build_baseline: Callable[[Corpus, ClaimBlindGuard], BaselineArtifact]
    authority: TimestampAuthority
    split: Callable[[Corpus], DiscoverConfirmSplit] | None = None
    discover: Callable[[Corpus], Iterable[Hypothesis]] | None = None
    confirm: Callable[[Hypothesis, Corpus], Verdict] | None = None
    hypothesis_for: Callable[[ClaimRecord], Hypothesis] | None = None
    confirm_claim: Callable[[Hypothesis, BaselineArtifact, ClaimRecord], Verdict] | None = None
    prior_fingerprint: str | None = None

    def __post_init__(self) -> None:
        if StudyMode.DISCOVERY in self.study.modes and not (self.split and self.discover and self.confirm):
            raise ValueError("discovery needs split, discover and confirm")
        if StudyMode.ADJUDICATE_EXTERNAL_CLAIMS in self.study.modes and not (self.hypothesis_for and self.confirm_claim):
            raise ValueError("adjudication needs hypothesis_for and confirm_claim")


@dataclass
class StudyResult:
    """What a run has found so far; ``parked`` names the gate that it waits at, if it does."""

    corpus: Corpus
    baseline: BaselineArtifact | None
    trail: ProvenanceTrail
    features: list[FeatureMatrix] = field(default_factory=list)
    verdicts: list[Verdict] = field(default_factory=list)
    scorecard: SourceScorecard | None = None
    drift: BaselineDriftReport | None = None
    parked: Parked | None = None
    run_id: str = ""

    def persist_trail(self, path: str) -> None:
        """Write the trail as a JSON file."""
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.trail.to_records(), f, sort_keys=True, indent=1)


def answering(decisions: Mapping[str, Mapping[str, Any]]) -> Callable[[GateReview], GateDecision | None]:
    """A gate handler of decisions that are known already, each like ``{"approved": True, "reason": "..."}``; other gates park."""

    def handler(review: GateReview) -> GateDecision | None:
        said = decisions.get(review.gate)
        return None if said is None else GateDecision(said["approved"], review.gate, str(said.get("reason", "")), dict(said.get("evidence", {})))

    return handler


class _Study:
    """The phases of one call of ``run_study``, each from the state that the phases before it have left."""

    def __init__(self, spark: SparkSession, plan: StudyPlan, trail: ProvenanceTrail, guard: ClaimBlindGuard):
        self.spark, self.plan, self.study, self.trail, self.guard = spark, plan, plan.study, trail, guard
        self.discovers = bool(plan.split) and StudyMode.DISCOVERY in plan.study.modes
        self.adjudicates = StudyMode.ADJUDICATE_EXTERNAL_CLAIMS in plan.study.modes
        self._corpus: Corpus | None = None

    def enter(self, phase: Phase, state: Mapping[str, Any], **payload: Any) -> dict[str, Any]:
        self.trail.record(phase.name.lower(), f"{self.study.name}: {phase.name.lower()}", payload)
        return {"seen": [*state.get("seen", []), phase.name]}

    def corpus(self, state: RunState) -> Corpus:
        """The corpus as it was committed, checked once in a process."""
        if self._corpus is None:
            self._corpus = Corpus(state.tables["units"], state.tables["relations"], state["metadata"], state["fingerprint"])
        return self._corpus

    def baseline(self, state: RunState) -> BaselineArtifact:
        b = state["baseline"]
        pairs = {k: tuple((x, y) for x, y in b[k]) for k in ("input_hashes", "versions")}
        contents = {name: state.tables[f"baseline-{i}"] for i, name in enumerate(b["contents"])}
        return BaselineArtifact(b["fingerprint"], contents, DeterminismRecord(b["seed"], **pairs))

    def split(self, state: RunState) -> DiscoverConfirmSplit:
        return DiscoverConfirmSplit(state.tables["discovery_ids"], state.tables["confirm_ids"])

    def drift(self, state: Mapping[str, Any]) -> BaselineDriftReport | None:
        prior = self.plan.prior_fingerprint
        return diff_baseline_fingerprints(prior, state["fingerprint"], warn=False) if prior else None

    # the phases

    def ingest(self, state: RunState) -> dict[str, Any]:
        plan, study = self.plan, self.study
        corpus = study.parser.parse(self.spark, plan.source)
        if not isinstance(corpus, Corpus):
            raise IngestionError("the parser gave no corpus")
        scratch = Scratch(self.spark, "ingest")  # parsed once
        corpus = Corpus(scratch.table(corpus.units, "units"), scratch.table(corpus.relations, "relations"), corpus.metadata)
        fingerprint, tree = corpus_tree(corpus)
        units = corpus.units.count()
        found: dict[str, Any] = {"units": corpus.units, "relations": corpus.relations, "metadata": corpus.metadata, "fingerprint": fingerprint, "tree": tree}
        if self.discovers:
            split = plan.split(corpus)
            both = split.discovery.select("unit_id").unionByName(split.confirm.select("unit_id"))
            if not both.join(corpus.unit_ids(), "unit_id", "left_anti").isEmpty():
                raise FirewallViolation("the split names units that the corpus lacks")
            found |= {"discovery_ids": split.discovery.select("unit_id"), "confirm_ids": split.confirm.select("unit_id")}
        features = [b(corpus) for b in study.feature_builders]
        for f in features:
            if not f.table.select("unit_id").join(corpus.unit_ids(), "unit_id", "left_anti").isEmpty():
                raise FirewallViolation("features name units that the corpus lacks")
        found |= {f"features-{i}": f.table for i, f in enumerate(features)} | {"features": len(features)}
        return found | self.enter(Phase.INGEST, state, fingerprint=fingerprint, units=units, source=study.parser.source_fingerprint(self.spark, plan.source))

    def build_baseline(self, state: RunState) -> dict[str, Any]:
        not_after = datetime.now(UTC)  # hypotheses must be older than what they are judged with
        scratch = Scratch(self.spark, "baseline")
        with self.guard.sealed():
            made = self.plan.build_baseline(self.corpus(state), self.guard)
            # written here, as a lazy plan would be evaluated outside the seal
            tables = {f"baseline-{i}": scratch.table(t, str(i)) for i, t in enumerate(made.contents.values())}
        if made.fingerprint != state["fingerprint"]:
            raise FirewallViolation("the baseline is of another corpus")
        d = made.determinism
        said = {"fingerprint": made.fingerprint, "seed": d.seed, "input_hashes": d.input_hashes, "versions": d.versions, "contents": list(made.contents)}
        return {**tables, "baseline": said, "not_after": not_after.isoformat()} | self.enter(Phase.BASELINE, state, fingerprint=made.fingerprint, seed=d.seed)

    def discover(self, state: RunState) -> dict[str, Any]:
        found = discover_hypotheses(self.corpus(state), self.split(state), discover=self.plan.discover)
        seen = self.enter(Phase.DISCOVERY, state)
        return {"hypotheses": [record_of(h) for h in found]} | self.enter(Phase.PREREGISTER, seen, hypotheses=[h.hypothesis_id for h in found])

    def confirm(self, state: RunState) -> dict[str, Any]:
        found = [hypothesis_of(r) for r in state["hypotheses"]]
        verdicts = confirm_hypotheses(self.corpus(state), self.split(state), found, confirm=self.plan.confirm, authority=self.plan.authority)
        return {"verdicts": [record_of(v) for v in verdicts]} | self.enter(Phase.CONFIRM, state, verdicts={v.hypothesis_id: v.label.value for v in verdicts})

    def adjudicate(self, state: RunState) -> dict[str, Any]:
        plan, study = self.plan, self.study
        claims = self.guard.release()
        if claim_set_fingerprint(claims) != study.claims_source.claim_fingerprint():
            raise FirewallViolation("the claims are not those that the source vouches for")
        seen = self.enter(Phase.ADJUDICATE, state, claims=len(claims))

        def step(h: Hypothesis, v: Verdict) -> None:
            self.trail.record("verdict", f"{v.hypothesis_id}: {v.label.value}", {"claim": h.source_claim_id, "rule": v.decision_rule})

        card, verdicts = adjudicate_with_baseline(
            self.baseline(state), claims, hypothesis_for=plan.hypothesis_for, confirm=plan.confirm_claim, authority=plan.authority,
            not_after=datetime.fromisoformat(state["not_after"]), source=study.name, on_step=step,
        )
        numbers = {"supported": card.n_supported, "contradicted": card.n_contradicted, "indeterminate": card.n_indeterminate}
        return {"verdicts": [*state.get("verdicts", []), *(record_of(v) for v in verdicts)], "scorecard": numbers} | self.enter(Phase.SCORE, seen, **numbers)

    def report(self, state: RunState) -> dict[str, Any]:
        seen = self.enter(Phase.REPORT, state, not_after=state["not_after"])
        if tuple(seen["seen"]) != tuple(p.name for p in required_phases(self.study.modes)):
            raise GateError("phases ran out of order")
        if not self.trail.verify():
            raise FirewallViolation("the trail does not hold together")
        self.trail.record("run_end", self.study.name, {"verdicts": len(state.get("verdicts", []))})
        return seen

    # the gates

    def gates(self) -> dict[str, tuple[Gate, Callable[[RunState], dict[str, Any]]]]:
        modes = self.study.modes

        def registered(state: Mapping[str, Any]) -> bool:
            for r in state["hypotheses"]:
                verify_preregistration(hypothesis_of(r), authority=self.plan.authority)
            return bool(state["hypotheses"])

        before = Phase.CONFIRM if StudyMode.DISCOVERY in modes else Phase.BASELINE
        return {
            "preregistration": (Gate("preregistration", Phase.PREREGISTER, Phase.CONFIRM, modes, registered), lambda s: {"hypotheses": len(s["hypotheses"])}),
            "adjudication": (Gate("adjudication", before, Phase.ADJUDICATE, modes, lambda s: "baseline" in s), lambda s: {"baseline": s["baseline"]["fingerprint"]}),
        }

    def graph(self, store: MemoryStore | RunStore, tracer: Tracer) -> Graph:
        gates = self.gates()
        order: list[tuple[str, Any]] = [("ingest", self.ingest), ("baseline", self.build_baseline)]
        if self.discovers:
            order += [("discovery", self.discover), ("preregistration", None), ("confirm", self.confirm)]
        if self.adjudicates:
            order += [("adjudication", None), ("adjudicate", self.adjudicate)]
        order.append(("report", self.report))

        def kept(phase: Callable[[RunState], Mapping[str, Any]]) -> Callable[[RunState], Mapping[str, Any]]:
            return lambda state: {**phase(state), "trail": self.trail.to_records()}

        def passed(name: str, then: str) -> Callable[[RunState], str]:
            def after(state: RunState) -> str:
                d = state.decision(name)
                if d is None or not d.approved:
                    raise GateError(f"{name}: refused ({d.reason if d else 'no decision'})")
                return then

            return after

        def build(b: GraphBuilder) -> None:
            for i, (name, phase) in enumerate(order):
                then = order[i + 1][0] if i + 1 < len(order) else None
                if phase is None:
                    gate, propose = gates[name]
                    b.phase(name, kept(make_gate_node(gate, propose, recorder=self.trail.as_recorder())), passed(name, then))
                else:
                    b.phase(name, kept(phase), then)

        return compile_graph(build, store=store, tracer=tracer)


def run_study(
    spark: SparkSession,
    plan: StudyPlan,
    *,
    gate_handler: Callable[[GateReview], GateDecision | None] = auto_approve,
    trail: ProvenanceTrail | None = None,
    tracker: Any = None,
    store: MemoryStore | RunStore | None = None,
    run_id: str | None = None,
    spans: Tracer | None = None,
) -> StudyResult:
    """Run all phases that the study's modes need, in order; any failure is recorded before it is raised.

    Each phase is committed to ``store``. Called again with the same store and ``run_id``, here or in another process, the run
    goes on after its last commit, and its trail with it (a keyed trail needs its key again). A gate whose handler gives no
    decision parks the run; decisions pass ``Gate.check`` and go on record first. The corpus metadata must be plain JSON.

    The corpus is known by the root of its hash tree; the tree is kept with the run, so that ``merkle.changed`` of two runs' trees
    tells which units and relations drifted. Each phase is a span of ``spans``, by default of the process's tracer.
    """
    trail = trail or ProvenanceTrail()
    study = plan.study
    store, run_id = store or MemoryStore(), run_id or uuid.uuid4().hex
    claims = tuple(study.claims_source.claims()) if study.claims_source else None
    phases = _Study(spark, plan, trail, ClaimBlindGuard(claims))
    graph = phases.graph(store, spans or bootstrap_tracing())
    found = store.load(run_id)
    if found:
        trail.restore(found[1]["values"]["trail"])
    else:
        trail.record("run_start", study.name, {"modes": sorted(m.value for m in study.modes)})
    run = tracker.start_run(study.name, {"modes": ",".join(sorted(m.value for m in study.modes)), "run_id": run_id}) if tracker else None
    try:
        with run_trace_context(run_id):
            out = durable.run(graph, run_id=run_id)
            while out.parked:
                decision = gate_handler(GateReview(out.parked.gate, tuple(sorted(out.parked.proposal.items()))))
                if decision is None:
                    break
                if not isinstance(decision, GateDecision):
                    raise GateError(f"{out.parked.gate}: not a decision")
                out = durable.resume(graph, run_id=run_id, gate=decision.gate, approved=decision.approved, reason=decision.reason, evidence=decision.evidence)
                if out.parked and out.parked.error:
                    raise GateError(out.parked.error)
        if tracker:
            tracker.end_run(run, "FINISHED")
    except BaseException as error:
        trail.record("run_failed", f"{type(error).__name__}: {error}")
        if tracker:
            tracker.end_run(run, "FAILED")
        raise
    state = out.state
    card = state.get("scorecard")
    return StudyResult(
        phases.corpus(state), phases.baseline(state) if "baseline" in state else None, trail,
        [FeatureMatrix(state.tables[f"features-{i}"]) for i in range(state["features"])], [verdict_of(r) for r in state.get("verdicts", [])],
        SourceScorecard(study.name, card["supported"], card["contradicted"], card["indeterminate"]) if card else None, phases.drift(state), out.parked, run_id,
    )


def verdict_table(spark: SparkSession, verdicts: Iterable[Verdict]) -> DataFrame:
    """Verdicts as rows."""
    rows = [(v.hypothesis_id, v.label.value, v.decision_rule, v.statistic, v.threshold, json.dumps(dict(v.evidence), sort_keys=True, default=str), v.notes) for v in verdicts]
    return spark.createDataFrame(rows, "hypothesis_id string, label string, decision_rule string, statistic double, threshold double, evidence string, notes string")
