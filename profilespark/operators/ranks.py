"""Positions in a global or per-group order without sorting any group in one task.

Rows are dealt to tasks by ranges of the whole order, groups first, so a large group is spread over as many tasks as its size asks for. Each
task sorts its own range; how many rows the ranges before it hold shifts its positions. The driver sees one count a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

INDEX_BITS = 33  # of monotonically_increasing_id: the place in the task's range


def positions(df: DataFrame, order: list, out: str) -> DataFrame:
    """1-based place of every row in the order; rows that are equal in it get some order of their own."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("_at", INDEX_BITS).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, shift = 0, []
    for p in range(max(sizes, default=-1) + 1):
        shift.append(before)
        before += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in shift or [0]]), (F.shiftright("_at", INDEX_BITS) + 1).cast("int"))
    return placed.withColumn(out, start + F.col("_at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1)) + 1).drop("_at")


def group_positions(df: DataFrame, groups: list[str], order: list, out: str) -> DataFrame:
    """1-based place of every row inside its group."""
    placed = positions(df, [*groups, *order], "_place")
    first = placed.groupBy(*groups).agg(F.min("_place").alias("_first"))
    return placed.join(first, groups).withColumn(out, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def group_ranks(df: DataFrame, groups: list[str], value: str | Column, out: str) -> DataFrame:
    """Place of every row inside its group, rows of equal value sharing the first one. Groups and values are not null."""
    valued = df.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    each = valued.groupBy(*groups, "_value").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sums(each, [*groups, "_value"], "_n", "_before")
    first = placed.groupBy(*groups).agg(F.min("_before").alias("_first"))
    ranks = placed.join(first, groups).select(*groups, "_value", (F.col("_before") - F.col("_first") + 1).alias(out))
    return valued.join(ranks, [*groups, "_value"]).drop("_value")


def running_sums(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over all rows before each in the order, which must tell all rows apart."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = {r["_p"]: r["s"] for r in dealt.groupBy("_p").agg(F.sum(amount).alias("s")).collect()}
    before, shift = 0, []
    for p in range(max(sums, default=-1) + 1):
        shift.append(before)
        before += sums.get(p) or 0
    kind = dict(dealt.agg(F.sum(amount).alias("s")).dtypes)["s"]
    start = F.element_at(F.array(*[F.lit(s).cast(kind) for s in shift or [0]]), F.col("_p") + 1)
    inside = F.sum(amount).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn(out, start + F.coalesce(inside, F.lit(0).cast(kind))).drop("_p")

