"""Spans of runs: what each phase took, what it wrote, how many Spark jobs it ran, and whether it failed.

A span tags the jobs that start within it, and counts the rows of tables that pass through ``observe`` while they are written,
without a job of its own. Finished spans, failed ones too, are appended to a table; parents are the spans around them.
"""

from __future__ import annotations

import contextlib
import contextvars
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SPANS = "run_id string, span_id string, parent_id string, name string, started_at string, seconds double, status string, error string, jobs long, row_counts map<string,long>, attributes string"
_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)
_SPAN: contextvars.ContextVar[str | None] = contextvars.ContextVar("span", default=None)


@dataclass
class Span:
    name: str
    span_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    attributes: dict[str, Any] = field(default_factory=dict)
    _seen: dict[str, Observation] = field(default_factory=dict)

    def observe(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, whose rows are counted by whatever first runs it."""
        self._seen[name] = Observation(f"{name}-{self.span_id}-{len(self._seen)}")
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("n"))

    def rows(self) -> dict[str, int]:
        return {name: int(o.get["n"]) for name, o in self._seen.items()}


class Tracer(Protocol):
    def span(self, name: str, **attributes: Any) -> contextlib.AbstractContextManager[Span]: ...


class UnconfiguredTracer:
    """Spans that nobody keeps."""

    @contextlib.contextmanager
    def span(self, name: str, **attributes: Any) -> Iterator[Span]:
        span = Span(name, attributes=attributes)
        span.observe = lambda df, name: df  # type: ignore[method-assign]
        yield span


class TableTracer:
    """Appends each finished span to a Parquet table (schema ``SPANS``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @contextlib.contextmanager
    def span(self, name: str, **attributes: Any) -> Iterator[Span]:
        sc = self.spark.sparkContext
        span, parent = Span(name, attributes=attributes), _SPAN.get()
        mine = _SPAN.set(span.span_id)
        sc.addJobTag(span.span_id)
        began, at, status, error = time.time(), datetime.now(UTC).isoformat(), "ok", None
        try:
            yield span
        except BaseException as e:
            status, error = "failed", f"{type(e).__name__}: {e}"[:2_000]
            raise
        finally:
            seconds = round(time.time() - began, 3)
            jobs = len(sc._jsc.sc().statusTracker().getJobIdsForTag(span.span_id))
            sc.removeJobTag(span.span_id)
            _SPAN.reset(mine)
            rows = span.rows() if status == "ok" else {}  # a failed plan may never say
            row = (_RUN.get(), span.span_id, parent, name, at, seconds, status, error, jobs, rows, json.dumps(attributes, sort_keys=True, default=str))
            self.spark.createDataFrame([row], SPANS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SPANS).parquet(self.path)


_configured: Tracer = UnconfiguredTracer()


def bootstrap_tracing(spark: SparkSession | None = None, path: str | None = None) -> Tracer:
    """Set the process's tracer: a table under ``path``, or none; without arguments, the one that is set."""
    global _configured
    if spark is not None:
        _configured = TableTracer(spark, path) if path else UnconfiguredTracer()
    return _configured


@contextlib.contextmanager
def run_trace_context(run_id: str) -> Iterator[None]:
    """Spans inside belong to this run."""
    token = _RUN.set(run_id)
    try:
        yield
    finally:
        _RUN.reset(token)
