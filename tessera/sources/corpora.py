"""Corpora from files that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.study.canonical import hash_text
from tessera.study.contracts import RELATIONS, UNITS, Corpus


class TableParser:
    """Units (and relations) from Parquet, JSON lines, CSV or text; ``unit_id`` and ``text`` name the columns to take."""

    def __init__(self, fmt: str = "parquet", *, unit_id: str = "unit_id", text: str = "text", attributes: tuple[str, ...] = (), relations: str | None = None, **options: str):
        if fmt not in ("parquet", "json", "csv", "orc", "text"):
            raise ValueError(f"unknown format {fmt!r}")
        self.fmt, self.unit_id, self.text, self.attributes, self.relations, self.options = fmt, unit_id, text, attributes, relations, options

    def parse(self, spark: SparkSession, path: str) -> Corpus:
        rows = spark.read.format(self.fmt).options(**self.options).load(path)
        if self.fmt == "text":
            rows = rows.select(F.sha2("value", 256).alias("unit_id"), F.col("value").alias("text")).dropDuplicates(["unit_id"])
        names = ("unit_id", "text") if self.fmt == "text" else (self.unit_id, self.text)
        attributes = F.to_json(F.struct(*self.attributes)) if self.attributes else F.lit("{}")
        units = rows.select(F.col(names[0]).cast("string").alias("unit_id"), F.col(names[1]).alias("text"), attributes.alias("attributes"), F.lit(path).alias("source_ref"))
        relations = spark.read.format(self.fmt).options(**self.options).load(self.relations) if self.relations else spark.createDataFrame([], RELATIONS)
        assert units.columns == [c.split()[0] for c in UNITS.split(", ")]
        return Corpus(units, relations.select(*(c.split()[0] for c in RELATIONS.split(", "))))

    def source_fingerprint(self, spark: SparkSession, path: str) -> str:
        """Hash of the names, sizes and contents of the files."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.sha2("content", 256).alias("h"), "length")
        return hash_text("\n".join(sorted(f"{r[0]}:{r[1]}" for r in files.collect())))
