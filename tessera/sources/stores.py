"""Stores over shared folders: files by content, vectors, experiment runs. Run state is in ``study/durable.py``."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Mapping
from functools import reduce
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.pairs import best_of_base
from tessera.plans.versions import Conflict, Versions


class LocalDataVersioner:
    """Files by the hash of their content, under ``<root>/<first two digits>/<hash>``; putting twice does nothing."""

    def __init__(self, root: str):
        self.root = root

    def fingerprint(self, path: str) -> str:
        digest = sha256()
        with open(path, "rb") as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
        return digest.hexdigest()

    def path_for(self, digest: str) -> str:
        if not re.fullmatch("[0-9a-f]{64}", digest):
            raise ValueError("not a content hash")
        return os.path.join(self.root, digest[:2], digest)

    def put(self, path: str) -> str:
        digest = self.fingerprint(path)
        target = self.path_for(digest)
        if not os.path.exists(target):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}"
            shutil.copyfile(path, part)
            os.replace(part, target)
        return digest


def fingerprint_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, length, sha256`` of many files, hashed by the executors."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


class VectorTable:
    """References with vectors of one dimension, in Parquet under ``path``.

    An upsert writes its own rows and commits them as one more generation (``plans/versions.py``); the newest generation of a
    reference counts. So writing costs what is written, readers see whole generations only, a writer that dies leaves nothing
    that is read, and of two writers at once both count. ``compact`` folds the generations into one.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int):
        if dimension < 1:
            raise ValueError("the dimension must be positive")
        self.spark, self.dimension, self._versions = spark, dimension, Versions(spark, path)

    def _state(self) -> tuple[int, dict[str, str]]:
        """The last committed number, -1 if there is none, and its generations."""
        found = self._versions.latest()
        if found is None:
            return -1, {}
        if found[1]["dimension"] != self.dimension:
            raise ValueError(f"the store holds vectors of {found[1]['dimension']} components, not {self.dimension}")
        return found[0], found[1]["tables"]

    def rows(self) -> DataFrame:
        """``ref, v``: the newest vector of each reference."""
        tables = self._state()[1]
        if not tables:
            return self.spark.createDataFrame([], "ref string, v array<double>")
        parts = [self._versions.table(at).select("ref", "v", F.lit(int(g)).alias("g")) for g, at in tables.items()]
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("ref").agg(F.max_by("v", "g").alias("v")) if len(parts) > 1 else every.select("ref", "v")

    def upsert(self, rows: DataFrame, *, attempts: int = 10) -> None:
        """Add or replace ``rows(ref string, v array<double>)``.

        Null references, and vectors that are null, of another length or not finite, raise, and nothing is written. Of rows with
        one reference that whose vector sorts last stays.
        """
        new = rows.select(F.col("ref").cast("string").alias("ref"), F.col("v").cast("array<double>").alias("v"))
        sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        good = F.col("ref").isNotNull() & F.coalesce((F.size("v") == self.dimension) & sound, F.lit(False))
        if not new.where(~good).isEmpty():
            raise ValueError(f"references must be given, and vectors must have {self.dimension} finite components")
        self._state()
        at = self._versions.write(new.groupBy("ref").agg(F.max("v").alias("v")), self._versions.folder(), "rows")
        for _ in range(attempts):
            number, tables = self._state()
            try:
                self._versions.commit(number + 1, {"dimension": self.dimension, "tables": {**tables, str(number + 1): at}})
                return
            except Conflict:  # another writer was faster: these rows come after its rows
                continue
        raise Conflict(f"{attempts} other writers were faster")

    def compact(self) -> None:
        """Fold all generations into one; raises ``Conflict`` if a writer commits meanwhile, and then changes nothing."""
        number, tables = self._state()
        if len(tables) > 1:
            at = self._versions.write(self.rows(), self._versions.folder(), "rows")
            self._versions.commit(number + 1, {"dimension": self.dimension, "tables": {str(number + 1): at}})

    def query(self, vector: list[float], k: int) -> DataFrame:
        """``ref, score`` of the k nearest by cosine, ties to the smaller reference."""
        if k <= 0:
            raise ValueError("k must be positive")
        if len(vector) != self.dimension:
            raise ValueError(f"the query must have {self.dimension} components")
        if not self._state()[1]:
            raise ValueError("the store is empty")
        probe = F.array(*(F.lit(float(x)) for x in vector))
        return self.rows().select("ref", V.cosine(F.col("v"), probe).alias("score")).orderBy(F.desc("score"), "ref").limit(k)

    def query_many(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, ref, score, r`` of the k nearest to each row of ``queries(query_id, v)``: a stated query set against all rows, in blocks."""
        if k <= 0:
            raise ValueError("k must be positive")
        found = best_of_base(queries, self.rows().withColumnRenamed("ref", "id"), k, query_id="query_id")
        return found.withColumnRenamed("id", "ref")


class ExperimentTable:
    """Runs, parameters and metrics as appended rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _add(self, run: str, kind: str, rows: Mapping[str, Any]) -> None:
        data = [(run, kind, str(k), str(v)) for k, v in rows.items()]
        if data:
            self.spark.createDataFrame(data, "run string, kind string, name string, value string").coalesce(1).write.mode("append").parquet(self.path)

    def start_run(self, name: str, params: Mapping[str, Any] | None = None) -> str:
        run = uuid.uuid4().hex
        self._add(run, "status", {"name": name, "state": "RUNNING"})
        self._add(run, "param", params or {})
        return run

    def log(self, run: str, metrics: Mapping[str, float]) -> None:
        self._add(run, "metric", metrics)

    def end_run(self, run: str, state: str = "FINISHED") -> None:
        if state not in ("FINISHED", "FAILED"):
            raise ValueError(f"unknown state {state!r}")
        self._add(run, "end", {"state": state})

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
