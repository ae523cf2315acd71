"""The first row of every key, found by a fixed-width order key.

A sorted aggregate over whole rows would sort each task's input. Here a hash aggregate finds the smallest coarse key (eight bytes that never
contradict the order), the rows that reach it are fetched by a join, and only those are ordered exactly; Spark limits them to one row per key
and task before they are shuffled, so a key with many equal rows stays small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

PREFIX = 7  # bytes of a text that fit a long without its sign


def coarse(kind: str, c: Column) -> Column:
    """Eight bytes in the order of a column, nulls first; equal for values that are told apart later only."""
    if kind in ("string", "binary"):
        digits = F.rpad(F.hex(F.substring(c.cast("binary"), 1, PREFIX)), 2 * PREFIX, "0")
        return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(-1).cast("long"))
    if kind in ("double", "float"):
        return F.coalesce(c.cast("double"), F.lit(float("-inf")))
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return F.coalesce(c.cast("long"), F.lit(-(2**63)).cast("long"))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.coalesce(F.datediff(c.cast("date"), F.lit("1970-01-01")).cast("long"), F.lit(-(2**63)).cast("long"))
    return F.coalesce(c.cast("double"), F.lit(float("-inf")))


def on_keys(keys: list[str]) -> Column:
    """Keys against their copies ``_k0`` and so on, null keys being equal."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])


def renamed(df: DataFrame, keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def first_by(candidates: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key of a table that holds few rows a key."""
    return candidates.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of every key that comes first in the order (ascending, nulls first)."""
    rows = cut(df)
    key = coarse(dict(rows.dtypes)[order[0]], F.col(order[0]))
    best = rows.groupBy(*keys).agg(F.min(key).alias("_best")).select(*renamed(rows, keys), "_best")
    reached = rows.withColumn("_own", key).join(best, on_keys(keys) & (F.col("_own") == F.col("_best"))).select(*df.columns)
    return first_by(reached, keys, order)
