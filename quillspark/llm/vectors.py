"""Embeddings as binary double vectors, and classes of equal ones."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _doubles(batches):
    for batch in batches:
        vectors, keys = [], []
        for v in batch.column("vector"):
            out = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 becomes 0.0
                if np.isfinite(x).all() and x.any():
                    out = x.tobytes()
            vectors.append(out)
            keys.append(None if out is None else hashlib.md5(out).digest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["id", "key", "vector"])


def doubles(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, key, vector: the bytes of a vector's doubles and their hash; null for vectors that take no part (null, empty
    or zero ones, or with null or non-finite components)."""
    read = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("vector"))
    return read.mapInArrow(_doubles, "id long, key binary, vector binary")


def classes(rows: DataFrame) -> DataFrame:
    """node, id, copies, vector of each distinct vector; node is half of its hash, id the smallest."""
    node = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    each = rows.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    return each.withColumn("node", node)


def matrix(column) -> np.ndarray:
    """The vectors of a binary column, all of one length, as rows."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 0))
