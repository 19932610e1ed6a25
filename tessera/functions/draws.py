"""Reproducible pseudo-random draws from md5, the same in any engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(seed: int | None, stream: str, *ids: Column) -> Column:
    """A hexadecimal sort key that depends on seed, stream name and ids only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed or 0)), F.lit(stream), *(i.cast("string") for i in ids)))


def uniform(seed: int | None, stream: str, *ids: Column) -> Column:
    """A draw in [0, 1) with 32 bits."""
    return F.conv(F.substring(md5_key(seed, stream, *ids), 1, 8), 16, 10).cast("double") / float(1 << 32)


def index(n: Column, seed: int | None, stream: str, *ids: Column) -> Column:
    """A draw from 0 to n - 1."""
    return F.least(F.floor(uniform(seed, stream, *ids) * n), n - 1).cast("long")
