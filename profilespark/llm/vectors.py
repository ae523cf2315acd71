"""Integer vectors of an embedding column, and exact sums over all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain

HALF = 32  # long components are summed in two halves of this many bits, so that no partial sum overflows
LIMB, LIMBS = 40, 4  # sums travel as so many parts of this many bits


def integer_vectors(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): floor(scale * c) of every component c read as double, for vectors that are not null and hold no null or non-finite
    component. The id keeps its type and may be null; components beyond the range of a long become its nearest end."""
    t = plain(vectors, vec_id=vec_id, embedding=embedding).select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return t.where(F.col("c").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", F.transform("c", lambda c: F.floor(c * scale)).alias("x"))


def rows_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists of a column as a matrix of longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def limbs(sums: list[int] | np.ndarray) -> list[int]:
    """Integers of up to 160 bits as longs: the highest parts of all of them first, which carry the sign, the lowest last."""
    low = (1 << LIMB) - 1
    return [int(s) >> LIMB * i if i == LIMBS - 1 else int(s) >> LIMB * i & low for i in range(LIMBS - 1, -1, -1) for s in sums]


def whole(parts: list[int]) -> list[int]:
    """The integers behind summed ``limbs``."""
    n = len(parts) // LIMBS
    return [sum(int(parts[j * n + i]) << LIMB * (LIMBS - 1 - j) for j in range(LIMBS)) for i in range(n)]


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sum of every column of a matrix of longs, whatever their size."""
    upper, lower = (x >> HALF).sum(axis=0), (x & ((1 << HALF) - 1)).sum(axis=0)
    return [(int(a) << HALF) + int(b) for a, b in zip(upper, lower)]


def summed(partials: DataFrame, key: Column | str, value: str) -> dict:
    """Per key the element-wise sum of array<long> partials as Python integers: one row per key and element reaches the driver."""
    long = partials.select(F.col(key).alias("k"), F.posexplode(value).alias("i", "v"))
    out: dict = {}
    for r in long.groupBy("k", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect():
        out.setdefault(r["k"], {})[r["i"]] = int(r["s"])
    return {k: [d[i] for i in range(len(d))] for k, d in out.items()}
