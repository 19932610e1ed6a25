"""Phases and gates of a study, and the registry of studies."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from tessera.study.contracts import StudyMode


class Phase(Enum):
    INGEST = 0
    BASELINE = 1
    DISCOVERY = 2
    PREREGISTER = 3
    CONFIRM = 4
    ADJUDICATE = 5
    SCORE = 6
    REPORT = 7

    def can_advance_to(self, other: Phase) -> bool:
        return other.value == self.value + 1


#: Phases that only one mode needs.
_ONLY = {StudyMode.DISCOVERY: (Phase.DISCOVERY, Phase.PREREGISTER, Phase.CONFIRM), StudyMode.ADJUDICATE_EXTERNAL_CLAIMS: (Phase.ADJUDICATE, Phase.SCORE)}


def required_phases(modes: Iterable[StudyMode]) -> tuple[Phase, ...]:
    modes = frozenset(modes)
    if not modes:
        raise ValueError("a study needs a mode")
    left_out = {p for mode, phases in _ONLY.items() if mode not in modes for p in phases}
    return tuple(p for p in Phase if p not in left_out)


def legal_transition(frm: Phase, to: Phase, modes: Iterable[StudyMode]) -> bool:
    order = required_phases(modes)
    return (frm, to) in zip(order, order[1:], strict=False)


class GateError(RuntimeError):
    """A gate was passed out of order, or decided without a record."""


@dataclass(frozen=True)
class GateDecision:
    approved: bool
    gate: str
    reason: str = ""
    evidence: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Gate:
    """A step between two phases; a human gate needs a recorder."""

    name: str
    frm: Phase
    to: Phase
    modes: frozenset[StudyMode]
    precondition: Callable[[Mapping[str, Any]], bool] = lambda state: True
    human: bool = True

    def check(self, state: Mapping[str, Any], decision: GateDecision) -> None:
        """Raise unless the gate may be decided now, and this is a decision on it."""
        if not legal_transition(self.frm, self.to, self.modes):
            raise GateError(f"{self.name}: {self.frm.name} does not lead to {self.to.name}")
        if not self.precondition(state):
            raise GateError(f"{self.name}: the precondition does not hold")
        if not isinstance(decision, GateDecision) or decision.gate != self.name or not isinstance(decision.approved, bool):
            raise GateError(f"{self.name}: not a decision on this gate")

    def evaluate(self, state: Mapping[str, Any], decision: GateDecision, recorder: Callable[[str, bool, str], None] | None = None) -> GateDecision:
        self.check(state, decision)
        if self.human and recorder is None:
            raise GateError(f"{self.name}: a human decision must be recorded")
        if recorder:
            recorder(self.name, decision.approved, decision.reason)
        if not decision.approved:
            raise GateError(f"{self.name}: refused ({decision.reason})")
        return decision


def apply_gate_decision(gate: Gate, resumed: Any) -> GateDecision:
    """A decision from what a parked run was resumed with."""
    if not isinstance(resumed, Mapping) or not isinstance(resumed.get("approved"), bool):
        raise GateError(f"{gate.name}: resume with approved true or false")
    return GateDecision(resumed["approved"], gate.name, str(resumed.get("reason", "")), dict(resumed.get("evidence", {})))


def already_decided(state: Mapping[str, Any], gate_name: str) -> bool:
    """Approval is final; a refused gate may be asked again."""
    d = state.get("gates", {}).get(gate_name)
    return bool(d and d.approved)


_STUDIES: dict[str, Callable[[], Any]] = {}
_LOCK = threading.Lock()


def register_study(name: str, factory: Callable[[], Any]) -> None:
    with _LOCK:
        if name in _STUDIES:
            raise ValueError(f"{name!r} is registered already")
        _STUDIES[name] = factory


def get_study(name: str) -> Any:
    if name not in _STUDIES:
        raise KeyError(f"no study {name!r}; there are {sorted(_STUDIES)}")
    return _STUDIES[name]()


def registered_studies() -> tuple[str, ...]:
    return tuple(sorted(_STUDIES))


def clear_registry() -> None:
    with _LOCK:
        _STUDIES.clear()
