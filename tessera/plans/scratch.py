"""Intermediate tables in the cluster's shared folder.

A written Parquet table cuts lineage, survives the loss of any executor and is columnar, so later
jobs read only the columns they need.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset and the master is local (tests, notebooks).
LOCAL_ROOT = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        return full if "://" in full else full.replace("file:/", "file:///", 1)
    if spark.sparkContext.master.startswith("local"):
        return LOCAL_ROOT
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named intermediate tables of one operator call.

    ``table`` writes and rereads; ``drop`` frees a table that no later plan reads. What is left goes
    when the driver exits, because lazily returned results still read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._clean)

    def table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str = "zstd") -> DataFrame:
        where = f"{self.path}/{name}"
        writer = df.write.mode("overwrite").option("compression", compression)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, f"{self.path}/{name}")

    def _clean(self) -> None:
        try:
            delete_path(self.spark, self.path)
        except Exception:  # the JVM is often gone by now  # noqa: BLE001
            pass


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted ``rows`` stay within ``most``; else as it is."""
    return F.broadcast(df) if rows <= most else df
