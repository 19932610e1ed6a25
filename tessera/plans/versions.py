"""Numbered states of one thing in a shared folder: data first, then one small marker that makes it count.

A writer puts its tables into a folder of its own (``folder``), which no reader looks at, and then creates the marker
``<path>/_commits/<number>.json`` if no other writer has. The marker is the commit point: it appears whole or not at all,
names the folders of the state, and carries a hash of what it says. A writer that dies earlier leaves a folder that no marker
names; one that comes second gets ``Conflict`` and has changed nothing. Readers take the greatest valid number.

Creating a marker only if it is absent is a hard link on a local or mounted file system, and a rename that refuses an
existing target elsewhere, as HDFS has it. An object store whose rename copies needs its own committer in front.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from typing import Any
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tessera.plans.scratch import delete_path


class Conflict(RuntimeError):
    """Another writer has committed this number."""


def _check(body: str) -> str:
    import hashlib

    return hashlib.sha256(body.encode()).hexdigest()


class Versions:
    """The states of one thing under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        whole = urlparse(self._fs.makeQualified(root).toString())
        self._local = unquote(whole.path) if whole.scheme == "file" else None

    def _at(self, *names: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def folder(self) -> str:
        """A new folder name for the tables of a state to come; nothing is created yet."""
        return f"{self.path}/data-{uuid.uuid4().hex}"

    def numbers(self) -> list[int]:
        """Numbers that have a marker, valid or not, ascending."""
        try:
            found = self._fs.listStatus(self._at("_commits"))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return []
            raise
        names = (s.getPath().getName() for s in found)
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, number: int) -> dict[str, Any] | None:
        """What a marker says; nothing if it is not whole."""
        stream = self._fs.open(self._at("_commits", f"{number:012d}.json"))
        try:
            text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
        finally:
            stream.close()
        head, _, body = text.partition("\n")
        return json.loads(body) if body and head == _check(body) else None

    def latest(self) -> tuple[int, dict[str, Any]] | None:
        """The greatest number with a valid marker, and what it says."""
        for number in reversed(self.numbers()):
            if (body := self.read(number)) is not None:
                return number, body
        return None

    def history(self) -> list[tuple[int, dict[str, Any]]]:
        found = ((n, self.read(n)) for n in self.numbers())
        return [(n, body) for n, body in found if body is not None]

    def commit(self, number: int, body: Mapping[str, Any]) -> None:
        """Make a state count under ``number``, unless another has it."""
        said = json.dumps(body, sort_keys=True, allow_nan=False)
        text = f"{_check(said)}\n{said}".encode()
        self._fs.mkdirs(self._at("_commits"))
        name, part = f"{number:012d}.json", f".{uuid.uuid4().hex}"
        if self._local is not None:
            folder = os.path.join(self._local, "_commits")
            aside = os.path.join(folder, part)
            with open(aside, "xb") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(aside, os.path.join(folder, name))
            except FileExistsError:
                raise Conflict(f"{self.path} has a state {number} already") from None
            finally:
                os.unlink(aside)
            return
        stream = self._fs.create(self._at("_commits", part), False)
        stream.write(bytearray(text))
        stream.close()
        target = self._at("_commits", name)
        if self._fs.exists(target) or not self._fs.rename(self._at("_commits", part), target):
            self._fs.delete(self._at("_commits", part), False)
            raise Conflict(f"{self.path} has a state {number} already")

    def write(self, df: DataFrame, folder: str, name: str) -> str:
        """Write a table of a state to come; gives the name that markers use."""
        where = f"{folder}/{name}"
        df.write.option("compression", "zstd").parquet(where)
        return where.removeprefix(f"{self.path}/")

    def table(self, name: str) -> DataFrame:
        """A table that a marker names."""
        return self.spark.read.parquet(f"{self.path}/{name}")

    def sweep(self, keep: int = 1) -> list[str]:
        """Delete data folders that none of the last ``keep`` states names, such as those of writers that died.

        Only for a quiet moment: a state that is being written has no marker yet.
        """
        named = {str(t).split("/")[0] for _, body in self.history()[-keep:] for t in body.get("tables", {}).values()}
        gone = [s.getPath().getName() for s in self._fs.listStatus(self._at())]
        gone = [n for n in gone if n.startswith("data-") and n not in named]
        for n in gone:
            delete_path(self.spark, f"{self.path}/{n}")
        return gone
