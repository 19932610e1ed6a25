"""Runs of several phases that survive the process: each phase's tables and values are committed before the next begins.

A graph has named phases. A phase takes the ``RunState`` and returns what it adds: DataFrames become Parquet tables of the
run, everything else must be plain JSON values. After each phase the state is committed through ``Versions``, so a run that is
started again under its id goes on after its last commit, and what a killed process left half written is never read.

A gate phase parks the run: the commit names the gate, ``run`` returns, and the process may end. ``resume`` brings a decision,
from any process that reads the same folder. A decision on another gate, or none that can be read, leaves the run parked
with the error; an approved gate is not asked again, a refused one goes where the graph's branch leads.

The driver holds names, values and one row for each commit; tables stay in the shared folder.
"""

from __future__ import annotations

import json
import os
import time
import warnings
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.versions import Conflict, Versions
from tessera.study.governance import Gate, GateDecision, GateError, apply_gate_decision
from tessera.study.tracing import Tracer, UnconfiguredTracer

#: Phases that one run may go through, so that a gate that is refused for ever ends loudly.
STEP_LIMIT = 50
COMMITS = "run_id string, number long, phase string, next string, parked string, seconds double, committed_at string, tables string"


class StepLimitError(RuntimeError):
    """The run did not end within its number of phases."""


@dataclass(frozen=True)
class Parked:
    """The gate that a run waits at, what it is asked to approve, and what was wrong with the last answer."""

    gate: str
    proposal: Mapping[str, Any]
    error: str | None = None


class _Park(Exception):
    def __init__(self, at: Parked):
        self.at = at


class RunState(Mapping[str, Any]):
    """What the phases so far have left: values by name, and tables as DataFrames."""

    def __init__(self, values: Mapping[str, Any], tables: Mapping[str, DataFrame], answer: Mapping[str, Any] | None = None):
        self.values_, self.tables, self.answer = dict(values), dict(tables), answer

    def __getitem__(self, name: str) -> Any:
        return self.tables[name] if name in self.tables else self.values_[name]

    def __iter__(self) -> Iterator[str]:
        return iter({**self.values_, **self.tables})

    def __len__(self) -> int:
        return len({**self.values_, **self.tables})

    def decision(self, gate: str) -> GateDecision | None:
        """The last decision on a gate."""
        for d in reversed(self.values_.get("gates", [])):
            if d["gate"] == gate:
                return GateDecision(d["approved"], gate, d["reason"], d["evidence"])
        return None


Phase = Callable[[RunState], Mapping[str, Any]]
Branch = Callable[[RunState], str | None]


class GraphBuilder:
    def __init__(self) -> None:
        self.phases: dict[str, Phase] = {}
        self.next: dict[str, str | None | Branch] = {}
        self.first: str | None = None

    def phase(self, name: str, run: Phase, then: str | None | Branch = None) -> GraphBuilder:
        """Add a phase; the first one added is the start. ``then`` names the next, or chooses it from the state."""
        if not name or name in self.phases:
            raise ValueError(f"{name!r} is no new phase name")
        self.phases[name], self.next[name] = run, then
        self.first = self.first or name
        return self


class MemoryStore:
    """States kept in this process: for tests, and for runs that nobody resumes elsewhere."""

    writes = False  # tables stay plans

    def __init__(self) -> None:
        self._runs: dict[str, list[tuple[dict[str, Any], dict[str, DataFrame]]]] = {}

    def load(self, run_id: str) -> tuple[int, dict[str, Any], dict[str, DataFrame]] | None:
        states = self._runs.get(run_id)
        return (len(states) - 1, *states[-1]) if states else None

    def save(self, run_id: str, number: int, body: dict[str, Any], old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        states = self._runs.setdefault(run_id, [])
        if number != len(states):
            raise Conflict(f"run {run_id} has a state {number} already")
        states.append((json.loads(json.dumps(body, allow_nan=False)), {**old, **new}))
        return states[-1][1]


class RunStore:
    """States in a shared folder, one ``Versions`` for each run."""

    writes = True

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _of(self, run_id: str) -> Versions:
        if not run_id or set(run_id) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._-") or run_id[0] in "._":
            raise ValueError(f"{run_id!r} is no run id")
        return Versions(self.spark, f"{self.path}/{run_id}")

    def load(self, run_id: str) -> tuple[int, dict[str, Any], dict[str, DataFrame]] | None:
        kept = self._of(run_id)
        found = kept.latest()
        if found is None:
            return None
        number, body = found
        return number, body, {name: kept.table(at) for name, at in body["tables"].items()}

    def save(self, run_id: str, number: int, body: dict[str, Any], old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        kept = self._of(run_id)
        before = kept.read(number - 1) if number else None
        names = dict(before["tables"]) if before else {}
        folder = kept.folder()
        names |= {name: kept.write(df, folder, name) for name, df in new.items()}
        kept.commit(number, {**body, "tables": names})
        return {**old, **{name: kept.table(names[name]) for name in new}}

    def runs(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []

    def commits(self, *run_ids: str) -> DataFrame:
        """One row for each commit of some runs, or of all (schema ``COMMITS``); ``tables`` is JSON of what the phase wrote."""
        rows = []
        for run_id in run_ids or self.runs():
            before: dict[str, str] = {}
            for number, b in self._of(run_id).history():
                new = sorted(k for k, v in b["tables"].items() if before.get(k) != v)
                rows.append((run_id, number, b["phase"], b["next"], (b["parked"] or {}).get("gate"), b["seconds"], b["committed_at"], json.dumps(new)))
                before = b["tables"]
        return self.spark.createDataFrame(rows, COMMITS)


def get_store(spark: SparkSession, path: str | None = None, *, use_memory: bool = False) -> MemoryStore | RunStore:
    """A store for run states: in ``path``, by default a folder ``runs`` in the cluster's shared folder, or in memory."""
    from tessera.plans.scratch import shared_root

    return MemoryStore() if use_memory else RunStore(spark, path or f"{shared_root(spark)}/runs")


def configured_store(spark: SparkSession, use_memory: bool | None = None) -> MemoryStore | RunStore:
    """The store that ``TESSERA_RUN_STORE`` names: ``memory``, or a folder; unset means the default folder."""
    said = os.environ.get("TESSERA_RUN_STORE", "")
    return get_store(spark, None if said in ("", "memory") else said, use_memory=said == "memory" if use_memory is None else use_memory)


@dataclass(frozen=True)
class Graph:
    phases: Mapping[str, Phase]
    next: Mapping[str, str | None | Branch]
    first: str
    store: MemoryStore | RunStore = field(default_factory=MemoryStore)
    tracer: Tracer = field(default_factory=UnconfiguredTracer)


def compile_graph(build: Callable[[GraphBuilder], Any], *, store: MemoryStore | RunStore | None = None, requires_store: bool = False, tracer: Tracer | None = None) -> Graph:
    """The graph that ``build`` adds phases to; each phase is a span of ``tracer``. ``requires_store`` refuses to go without a store, as a graph with gates should."""
    if requires_store and store is None:
        raise ValueError("a graph with gates needs a store, or a parked run is lost with its process")
    builder = GraphBuilder()
    build(builder)
    if builder.first is None:
        raise ValueError("the graph has no phase")
    if unknown := sorted({x for x in builder.next.values() if isinstance(x, str)} - set(builder.phases)):
        raise ValueError(f"no such phases: {unknown}")
    return Graph(builder.phases, builder.next, builder.first, store or MemoryStore(), tracer or UnconfiguredTracer())


def make_gate_node(gate: Gate, propose: Callable[[RunState], Mapping[str, Any]], *, recorder: Callable[[str, bool, str], None] | None = None) -> Phase:
    """A phase that parks until ``gate`` is decided; each decision goes through ``Gate.evaluate`` and is recorded first."""
    if recorder is None:
        warnings.warn(f"decisions on {gate.name!r} are kept in the run's state only; give a recorder that writes them to a trail", stacklevel=2)

    def decide(state: RunState) -> Mapping[str, Any]:
        earlier = state.decision(gate.name)
        if earlier is not None and earlier.approved:
            return {}
        proposal = dict(propose(state))
        if state.answer is None:
            raise _Park(Parked(gate.name, proposal))
        try:
            if state.answer.get("gate") != gate.name:
                raise GateError(f"the run waits at {gate.name!r}, not at {state.answer.get('gate')!r}")
            decision = apply_gate_decision(gate, state.answer)
            gate.check(state, decision)
        except GateError as e:
            raise _Park(Parked(gate.name, proposal, str(e))) from None
        if recorder is not None:
            try:
                recorder(gate.name, decision.approved, decision.reason)
            except Exception as e:  # the decision must not count if it is not on record
                raise GateError(f"{gate.name}: the decision could not be recorded ({type(e).__name__}: {e})") from e
        made = {"gate": gate.name, "approved": decision.approved, "reason": decision.reason, "evidence": dict(decision.evidence)}
        return {"gates": [*state.values_.get("gates", []), made]}

    return decide


@dataclass(frozen=True)
class Outcome:
    """Where a run stands: its state, and the gate that it is parked at, if any."""

    run_id: str
    state: RunState
    parked: Parked | None
    steps: int

    @property
    def finished(self) -> bool:
        return self.parked is None


def _go(graph: Graph, run_id: str, values: Mapping[str, Any], answer: Mapping[str, Any] | None, limit: int) -> Outcome:
    found = graph.store.load(run_id)
    if found is None:
        number, kept, tables, at, steps = -1, dict(values), {}, graph.first, 0
        kept, tables = _parted(kept)
        if tables:
            raise TypeError("a run starts from plain values; read tables in its first phase")
    else:
        number, body, tables = found
        kept, at, steps = body["values"], body["next"], body["steps"]
    while at is not None:
        if steps >= limit:
            raise StepLimitError(f"run {run_id} has not ended after {limit} phases")
        began = time.time()
        with graph.tracer.span(at, run_id=run_id, step=steps) as span:
            state, parked, new = RunState(kept, tables, answer), None, {}
            try:
                added, new = _parted(graph.phases[at](state))
                kept = {**kept, **added}
                answer = None  # a decision counts once
                after = graph.next[at]
                then = after(RunState(kept, {**tables, **new})) if callable(after) else after
                steps += 1
            except _Park as p:
                parked, then = p.at, at
            body = {
                "phase": at, "next": then, "values": kept, "steps": steps, "seconds": round(time.time() - began, 3), "committed_at": datetime.now(UTC).isoformat(),
                "parked": {"gate": parked.gate, "proposal": dict(parked.proposal), "error": parked.error} if parked else None,
            }
            number += 1
            if graph.store.writes:
                new = {name: span.observe(df, name) for name, df in new.items()}
            tables = graph.store.save(run_id, number, body, tables, new)
        if parked:
            return Outcome(run_id, RunState(kept, tables), parked, steps)
        at = then
    return Outcome(run_id, RunState(kept, tables), None, steps)


def _parted(found: Mapping[str, Any]) -> tuple[dict[str, Any], dict[str, DataFrame]]:
    tables = {k: v for k, v in found.items() if isinstance(v, DataFrame)}
    plain = {k: v for k, v in found.items() if k not in tables}
    return json.loads(json.dumps(plain, allow_nan=False)), tables


def run(graph: Graph, values: Mapping[str, Any] | None = None, *, run_id: str, limit: int = STEP_LIMIT) -> Outcome:
    """Start a run, or go on after its last commit; ``values`` count at the start only. A parked run stays parked."""
    found = graph.store.load(run_id)
    if found and found[1]["parked"]:
        p = found[1]["parked"]
        return Outcome(run_id, RunState(found[1]["values"], found[2]), Parked(p["gate"], p["proposal"], p["error"]), found[1]["steps"])
    return _go(graph, run_id, values or {}, None, limit)


def resume(graph: Graph, *, run_id: str, gate: str, approved: Any, reason: str = "", evidence: Mapping[str, Any] | None = None, limit: int = STEP_LIMIT) -> Outcome:
    """Bring a decision to a parked run. A wrong gate or an unreadable decision leaves it parked, with the error."""
    found = graph.store.load(run_id)
    if found is None:
        raise KeyError(f"there is no run {run_id!r}")
    if not found[1]["parked"]:
        raise GateError(f"run {run_id!r} is not parked at a gate")
    return _go(graph, run_id, {}, {"gate": gate, "approved": approved, "reason": reason, "evidence": dict(evidence or {})}, limit)
