"""Vectors as bytes: validity, exact names, and conversion to numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def element_type(df: DataFrame, column: str) -> np.dtype:
    """What a vector's bytes hold: float32 where the column does, else float64."""
    return np.dtype("<f4" if isinstance(df.schema[column].dataType.elementType, T.FloatType) else "<f8")


def as_bytes(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, node, vec``: a 16-byte name that equal vectors share, and the vector's bytes.

    Both are null where the vector is null, empty, zero, or holds a null or non-finite component, or vec_id is null.
    """
    kind, dtype = df.schema[vec_id].dataType.simpleString(), element_type(df, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values
            bad = np.zeros(len(values) + 1, np.int64)
            flat = values.to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)  # no negative zeros
            np.cumsum(~np.isfinite(flat), out=bad[1:])  # null components have become NaN
            ok = ~np.asarray(lists.is_null()) & ~np.asarray(batch.column(0).is_null())
            nodes, vecs = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if ok[i] and b > a and bad[a] == bad[b] and flat[a:b].any():
                    raw = flat[a:b].tobytes()
                    nodes.append(hashlib.blake2b(raw, digest_size=16).digest())
                    vecs.append(raw)
                else:
                    nodes.append(None)
                    vecs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "node", "vec"])

    return df.select(vec_id, vector).mapInArrow(run, f"vec_id {kind}, node binary, vec binary")


def matrix(raw: list[bytes], dtype: np.dtype) -> np.ndarray:
    """Rows of equal-sized vectors, in double precision."""
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def unit(a: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their greatest component first, so that extremes do not overflow."""
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]
