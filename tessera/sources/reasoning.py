"""The seam to an outside reasoner; off unless one is given."""

from __future__ import annotations

import json
import os
import re
import threading
import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any


class StakesTier(Enum):
    BULK = "bulk"
    HIGH = "high"


@dataclass(frozen=True)
class ReasoningRequest:
    prompt: str
    tier: StakesTier = StakesTier.BULK
    purpose: str = ""
    params: dict[str, Any] = field(default_factory=dict)


class ReasoningError(RuntimeError):
    """It may work if tried again."""


class PermanentReasoningError(ReasoningError):
    """It will not."""


class DeadlineError(PermanentReasoningError):
    """The time for a question ran out."""


class RateLimitError(ReasoningError):
    """Too many requests; has a budget of its own."""


#: A string literal, closed or cut off, or a bracket.
_PIECE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', re.DOTALL)


def first_balanced_json(text: str) -> str | None:
    """The span from the first opening bracket to the one that closes it, not counting brackets in strings; it need not parse."""
    first = re.search(r"[{\[]", text)
    if first is None:
        return None
    opens, closes = "{}" if first[0] == "{" else "[]"
    depth = 0
    for piece in _PIECE.finditer(text, first.start()):
        depth += (piece[0] == opens) - (piece[0] == closes)
        if not depth:
            return text[first.start() : piece.end()]
    return None


def extract_json(text: str) -> Any:
    """The value of the first balanced span; if there is none, or it does not parse, ``ReasoningError``."""
    span = first_balanced_json(text)
    if span is None:
        raise ReasoningError("no JSON in the answer")
    try:
        return json.loads(span)
    except ValueError as e:
        raise ReasoningError("malformed JSON in the answer") from e


class UnconfiguredReasoningSeam:
    """Fails loudly."""

    def run(self, request: ReasoningRequest) -> str:
        raise PermanentReasoningError("no reasoner is configured")


#: Words in the name of a variable that holds a secret, and starts and ends of names that redirect traffic or change whom to trust.
_SECRET = ("KEY", "TOKEN", "SECRET", "PASSWORD", "PASSWD", "CREDENTIAL")
_REDIRECT_START = ("AWS_", "AZURE_", "GOOGLE_", "GCP_")
_REDIRECT_END = ("_PROXY", "_BASE_URL", "_API_BASE", "_CA_BUNDLE", "_CA_CERTS", "_TLS_REJECT_UNAUTHORIZED", "SSL_CERT_FILE", "SSL_CERT_DIR")


def is_secret_variable(name: str) -> bool:
    """Whether an environment variable holds a credential, by the words of its name in any case."""
    return any(word in name.upper() for word in _SECRET)


def is_unsafe_variable(name: str) -> bool:
    """Whether a variable must not reach a reasoner's subprocess: credentials, cloud settings, proxies, other endpoints, other trust."""
    return is_secret_variable(name) or name.upper().startswith(_REDIRECT_START) or name.upper().endswith(_REDIRECT_END)


def scrubbed_env(env: Mapping[str, str] | None = None, *, keep: Iterable[str] = ()) -> dict[str, str]:
    """The environment for a subprocess: unsafe variables are emptied, not left out, as a caller may merge this over its own.

    ``keep`` names the ones that the reasoner needs, such as its own token.
    """
    kept = set(keep)
    return {k: "" if is_unsafe_variable(k) and k not in kept else v for k, v in (os.environ if env is None else env).items()}


class TimeLimit:
    """Calls that are given up after a time. A call that hangs keeps its thread, so when all are taken the next one is refused at once."""

    def __init__(self, threads: int = 8):
        self._pool = ThreadPoolExecutor(threads, thread_name_prefix="reasoner")
        self._free = threading.BoundedSemaphore(threads)

    def call(self, fn: Callable[[], str], seconds: float) -> str:
        if not self._free.acquire(blocking=False):
            raise ReasoningError("all threads wait for answers that have not come")
        future = self._pool.submit(fn)
        future.add_done_callback(lambda _: self._free.release())
        try:
            return future.result(max(0.0, seconds))
        except FutureTimeout:
            if future.done():  # the reasoner's own timeout, not ours
                raise
            raise ReasoningError(f"no answer within {seconds:g} s") from None


class ReasoningSeam:
    """Retries around one function for each tier."""

    def __init__(self, complete: dict[StakesTier, Callable[[ReasoningRequest], str]], *, retries: int = 2, rate_retries: int = 4, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep, timeout: float | None = None, deadline: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.complete, self.retries, self.rate_retries, self.pause, self.sleep = complete, retries, rate_retries, pause, sleep
        #: Seconds for one answer, and for one question with all its retries; None for no limit.
        self.timeout, self.deadline, self.clock = timeout, deadline, clock
        self._limit = TimeLimit()

    def _ask(self, request: ReasoningRequest, until: float | None) -> str:
        left = [x for x in (self.timeout, None if until is None else until - self.clock()) if x is not None]
        if until is not None and until <= self.clock():
            raise DeadlineError("the time for this question is over")
        complete = self.complete[request.tier]
        return self._limit.call(lambda: complete(request), min(left)) if left else complete(request)

    def is_available(self, tier: StakesTier) -> bool:
        return tier in self.complete

    def run(self, request: ReasoningRequest, *, until: float | None = None) -> str:
        """An answer, asked again after failures; ``until`` is an instant of ``clock`` after which nothing is asked any more."""
        if not self.is_available(request.tier):
            raise PermanentReasoningError(f"no reasoner for {request.tier.value}")
        until = until if until is not None or self.deadline is None else self.clock() + self.deadline
        left, rate = self.retries, self.rate_retries
        while True:
            try:
                return self._ask(request, until)
            except PermanentReasoningError:
                raise
            except RateLimitError:
                rate -= 1
                if rate < 0:
                    raise
            except ReasoningError:
                left -= 1
                if left < 0:
                    raise
            self.sleep(self.pause * (1 + self.retries - left + self.rate_retries - rate))

    def run_json(self, request: ReasoningRequest, *, rolls: int = 3) -> Any:
        """Parsed answer; what does not parse is asked again, a little warmer and with another seed."""
        until = None if self.deadline is None else self.clock() + self.deadline  # for all rolls together
        for k in range(rolls):
            try:
                return extract_json(self.run(until=until, request=replace(request, params={**request.params, "seed": k, "temperature": request.params.get("temperature", 0.0) + 0.2 * k})))
            except PermanentReasoningError:
                raise
            except ReasoningError:
                if k + 1 == rolls:
                    raise
        raise ReasoningError("no rolls")
