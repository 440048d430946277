"""Whole-number vectors from a table of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 25  # entries are held within this bound, so that sums of squares stay exact


def whole_vectors(rows: DataFrame, scale: int, more: tuple[str, ...] = (), multiple: int = 1) -> tuple[DataFrame, int]:
    """((vec_id, *more, x), width): x holds floor(scale * entry) of every vector that is whole.

    Rows whose vector is null or holds a null, NaN or infinite entry go.  Vectors that are
    shorter than the longest are filled with zeros, and the width is rounded up to a
    multiple.  Entries beyond LARGEST are held at it.
    """
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(F.col("embedding").isNotNull()).where(fine)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // multiple) * multiple
    held = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    filled = F.when(F.size("embedding") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding"))))
    out = kept.select(F.col("vec_id").cast("long").alias("vec_id"), *more, held.alias("x"), "embedding")
    return out.select("vec_id", *more, filled.alias("x")), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
