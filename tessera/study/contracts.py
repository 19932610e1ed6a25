"""Study data: units and relations as tables, claims, features, and what defines a study."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from enum import Enum
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.study.canonical import canonical_plain, hash_text, hash_value, stable_seed

UNITS = "unit_id string, text string, attributes string, source_ref string"
RELATIONS = "source_id string, target_id string, kind string, attributes string"


class StudyMode(Enum):
    DISCOVERY = "discovery"
    ADJUDICATE_EXTERNAL_CLAIMS = "adjudicate_external_claims"


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).count().where("count > 1").select(key)


def dangling_endpoints(units: DataFrame, relations: DataFrame) -> DataFrame:
    """Ends of relations that are no unit."""
    ends = relations.select(F.explode(F.array("source_id", "target_id")).alias("unit_id")).distinct()
    return ends.join(units.select("unit_id"), "unit_id", "left_anti")


def _first(df: DataFrame, n: int = 5) -> list[Any]:
    return [r[0] for r in df.limit(n).collect()]


@dataclass(frozen=True)
class Corpus:
    """``units`` and ``relations`` tables (schemas ``UNITS`` and ``RELATIONS``) with small metadata. Duplicate ids and dangling relations raise.

    ``fingerprint`` is the content hash, where whoever made the corpus has taken it already.
    """

    units: DataFrame
    relations: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)
    fingerprint: str | None = None

    def __post_init__(self) -> None:
        if bad := _first(duplicate_ids(self.units, "unit_id")):
            raise ValueError(f"duplicate unit ids: {bad}")
        if bad := _first(dangling_endpoints(self.units, self.relations)):
            raise ValueError(f"relations name unknown units: {bad}")

    @classmethod
    def of(cls, spark: SparkSession, units: Iterable[tuple], relations: Iterable[tuple] = (), metadata: dict[str, Any] | None = None) -> Corpus:
        return cls(spark.createDataFrame(list(units), UNITS), spark.createDataFrame(list(relations), RELATIONS), metadata or {})

    def unit_ids(self) -> DataFrame:
        return self.units.select("unit_id")


def subset_corpus(corpus: Corpus, ids: DataFrame) -> Corpus:
    """The units with given ids and the relations with both ends among them; metadata stays behind."""
    keep = ids.select("unit_id").distinct()
    units = corpus.units.join(keep, "unit_id", "left_semi")
    relations = corpus.relations.join(keep.withColumnRenamed("unit_id", "source_id"), "source_id", "left_semi").join(keep.withColumnRenamed("unit_id", "target_id"), "target_id", "left_semi")
    return Corpus(units.select(*corpus.units.columns), relations.select(*corpus.relations.columns))


def canonical_rows(df: DataFrame, names: dict[str, str], order: list[str]) -> DataFrame:
    """Each row's ids as ``k0``, ``k1``, ... and the row as canonical ``json``; ``attributes`` holds JSON text (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for row in p.to_dict("records"):
                item = {short: row[name] for short, name in names.items()}
                item["attrs"] = canonical_plain(json.loads(row["attributes"]) if row["attributes"] else {})
                out.append(json.dumps(item, sort_keys=True, allow_nan=False))
            yield pd.DataFrame({**{f"k{i}": p[c] for i, c in enumerate(order)}, "json": out})

    keys = [f"k{i}" for i in range(len(order))]
    return df.mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", json string")


def _row_json(df: DataFrame, names: dict[str, str], order: list[str]) -> DataFrame:
    """Canonical rows in the order of their ids; rows with equal ids in that of their JSON."""
    return canonical_rows(df, names, order).orderBy(*(f"k{i}" for i in range(len(order))), "json")


def corpus_fingerprint(corpus: Corpus) -> str:
    """SHA-256 over the canonical JSON of metadata, relations and units, in the order of their ids.

    Rows are written and sorted by Spark, and pass the driver one partition at a time, because one hash has to see them in
    order. ``corpus_tree_fingerprint`` is the form for large corpora.
    """
    digest = hashlib.sha256()

    def stream(rows: DataFrame) -> None:
        for i, r in enumerate(rows.select("json").toLocalIterator()):
            digest.update(((", " if i else "") + r[0]).encode())

    digest.update(('{"metadata": ' + json.dumps(canonical_plain(corpus.metadata), sort_keys=True, allow_nan=False) + ', "relations": [').encode())
    stream(_row_json(corpus.relations, {"s": "source_id", "t": "target_id", "k": "kind"}, ["source_id", "target_id", "kind"]))
    digest.update(b'], "units": [')
    stream(_row_json(corpus.units, {"id": "unit_id", "text": "text"}, ["unit_id"]))
    digest.update(b"]}")
    return digest.hexdigest()


def corpus_tree_fingerprint(corpus: Corpus) -> str:
    """A hash of the same content that needs no global order: rows are hashed where they lie and hashes are added up in 4096 buckets."""

    def root(df: DataFrame) -> str:
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        counts = df.select(row.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        limbs = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", "h", "n"), 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(8)]
        buckets = counts.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("c"), *limbs)
        return hash_text("\n".join(sorted("|".join(str(x) for x in r) for r in buckets.collect())))

    return hash_value([root(corpus.units), root(corpus.relations), corpus.metadata])


@dataclass(frozen=True)
class FeatureMatrix:
    """``unit_id`` and named double columns; null, NaN and infinite values, and other column types, raise."""

    table: DataFrame

    def __post_init__(self) -> None:
        names = [c for c in self.table.columns if c != "unit_id"]
        if "unit_id" not in self.table.columns or not names:
            raise ValueError("a feature table needs unit_id and at least one feature")
        if bad := [f.name for f in self.table.schema.fields if f.name in names and f.dataType.simpleString() not in ("double", "float", "int", "bigint", "smallint", "tinyint")]:
            raise ValueError(f"features must be numeric: {bad}")
        faulty = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in names]
        if bad := [c for c, n in self.table.agg(*faulty).first().asDict().items() if n]:
            raise ValueError(f"features must be finite: {bad}")


@dataclass(frozen=True)
class ClaimRecord:
    claim_id: str
    subject: str
    referents: tuple[str, ...]
    assertion: dict[str, Any] = field(default_factory=dict)
    provenance: dict[str, Any] = field(default_factory=dict)


def claim_set_fingerprint(claims: Iterable[ClaimRecord]) -> str:
    """Hash of claims in their order."""
    return hash_value([[c.claim_id, c.subject, list(c.referents), c.assertion, c.provenance] for c in claims])


class ExternalClaimsSource(Protocol):
    def claims(self) -> Iterable[ClaimRecord]: ...
    def claim_fingerprint(self) -> str: ...


class IngestionParser(Protocol):
    def parse(self, spark: SparkSession, path: str) -> Corpus: ...
    def source_fingerprint(self, spark: SparkSession, path: str) -> str: ...


@dataclass(frozen=True)
class PromptManifest:
    """Names of prompts and their versions."""

    versions: tuple[tuple[str, str], ...] = ()

    def version(self, name: str) -> str:
        return dict(self.versions)[name]


def prompt_manifest(**versions: str) -> PromptManifest:
    return PromptManifest(tuple(sorted(versions.items())))


@dataclass(frozen=True)
class StudyDefinition:
    name: str
    modes: frozenset[StudyMode]
    parser: IngestionParser
    feature_builders: tuple[Callable[[Corpus], FeatureMatrix], ...] = ()
    claims_source: ExternalClaimsSource | None = None

    def __post_init__(self) -> None:
        modes = frozenset(StudyMode(m) if isinstance(m, str) else m for m in self.modes)
        object.__setattr__(self, "modes", modes)
        if not self.name or not modes:
            raise ValueError("a study needs a name and a mode")
        if (StudyMode.ADJUDICATE_EXTERNAL_CLAIMS in modes) != (self.claims_source is not None):
            raise ValueError("a claims source is needed for adjudication, and only then")


@dataclass(frozen=True)
class DeterminismRecord:
    seed: int
    input_hashes: tuple[tuple[str, str], ...]
    versions: tuple[tuple[str, str], ...]

    def as_dict(self) -> dict[str, Any]:
        return {"seed": self.seed, "input_hashes": dict(self.input_hashes), "versions": dict(self.versions)}


@dataclass(frozen=True)
class BaselineArtifact:
    """Named tables of a data-only model, the corpus they come from, and what made them reproducible."""

    fingerprint: str
    contents: dict[str, DataFrame]
    determinism: DeterminismRecord


def build_baseline_artifact(corpus: Corpus, contents: dict[str, DataFrame], *, component_versions: dict[str, str] | None = None, extra_inputs: dict[str, Any] | None = None, seed: int | None = None, corpus_hash: str | None = None, trust_corpus_hash: bool = False) -> BaselineArtifact:
    """Hash all inputs and derive the seed from them unless one is given; a wrong ``corpus_hash`` raises unless it is trusted."""
    if "corpus" in (extra_inputs or {}):
        raise ValueError("'corpus' is reserved")
    found = corpus_hash if corpus_hash and trust_corpus_hash else corpus.fingerprint or corpus_fingerprint(corpus)
    if corpus_hash and corpus_hash != found:
        raise ValueError("the corpus does not have the given hash")
    hashes = {"corpus": found, **{k: hash_value(v) for k, v in (extra_inputs or {}).items()}}
    seed = stable_seed(*(f"{k}={v}" for k, v in sorted(hashes.items()))) if seed is None else seed
    return BaselineArtifact(found, dict(contents), DeterminismRecord(seed, tuple(sorted(hashes.items())), tuple(sorted((component_versions or {}).items()))))


@dataclass(frozen=True)
class BaselineDriftReport:
    prior: str | None
    current: str
    prior_units: int | None = None
    current_units: int | None = None

    @property
    def drifted(self) -> bool:
        return self.prior is not None and self.prior != self.current

    @property
    def unit_delta(self) -> int | None:
        return None if self.prior_units is None or self.current_units is None else self.current_units - self.prior_units

    def as_params(self) -> dict[str, str]:
        return {"prior": str(self.prior), "current": self.current, "drifted": str(self.drifted), "unit_delta": str(self.unit_delta)}


class BaselineDriftWarning(UserWarning):
    """The corpus is not the one that an earlier baseline was built on."""


def diff_baseline_fingerprints(prior: str | None, current: str, *, prior_n_units: int | None = None, current_n_units: int | None = None, warn: bool = True) -> BaselineDriftReport:
    import warnings

    report = BaselineDriftReport(prior, current, prior_n_units, current_n_units)
    if warn and report.drifted:
        warnings.warn(f"baseline drift: {prior} -> {current}", BaselineDriftWarning, stacklevel=2)
    return report
