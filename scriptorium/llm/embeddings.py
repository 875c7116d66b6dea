"""Vectors in numpy: parsing, grouping into shards of bounded size, packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the bounded sample that places the pivots, and pivots.
SAMPLE, PIVOTS = 2048, 32


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=dtype)


def pivots(vectors: DataFrame, column: str, id_col: str) -> np.ndarray:
    """Spread-out members of a bounded sample, farthest first; where they lie affects speed only."""
    rows = vectors.orderBy(F.xxhash64(id_col), id_col).select(column).limit(SAMPLE).collect()
    points = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(points):
        return points
    chosen = [0]
    far = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(PIVOTS, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def common_length(vectors: DataFrame, column: str) -> int:
    """The most frequent vector length; vectors of another length take no part."""
    row = vectors.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return int(row["d"]) if row else 0


def salted(vectors: DataFrame, key: str, id_col: str, rows: int) -> DataFrame:
    """``vectors`` with salt and salts, so that each (key, salt) has about ``rows`` rows."""
    from scriptorium.llm.components import spread

    salts = spread(vectors, key, F.count("*").alias("_n")).select(key, F.ceil(F.col("_n") / rows).cast("int").alias("salts"))
    return vectors.join(salts, key).withColumn("salt", F.pmod(F.xxhash64(id_col), F.col("salts")).cast("int"))
