"""Session preparation shared by every entry point."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows in one Arrow batch. Texts can be long, so batches stay far below Spark's default.
ARROW_ROWS = "512"
#: Bytes in one Arrow batch, about; one longer row makes a longer batch.
ARROW_BYTES = "4m"
#: Python workers give freed memory back instead of holding it for the rest of the executor's life.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_MMAP_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, keep Arrow batches small and return memory. Idempotent."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if _HERE not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_HERE, *[p for p in paths if p]])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
