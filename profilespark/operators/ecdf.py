"""Projection through a frozen weighted distribution: knots, cumulative mass and an as-of lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut
from .ranks import running_sums


def fit_knots(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Equal knots summed, with the mass strictly before each and the total.

    The running sum is taken over ranges of the knots whose totals shift the later ones, so no single task orders all knots, and the ranges
    follow the number of knots.
    """
    x, w = S.to_finite(F.col(value)), S.to_finite(F.col(weight))
    mass = df.select(x.alias("knot"), w.alias("w")).where("knot is not null and w > 0").groupBy("knot").agg(F.sum("w").alias("mass"))
    placed = cut(running_sums(mass, ["knot"], "mass", "before"))
    return placed.join(placed.agg(F.sum("mass").alias("total")), F.lit(True)).select("knot", "mass", "before", "total")


def weighted_ecdf_asof(df: DataFrame, knots: DataFrame, value: str, out: str) -> DataFrame:
    """Percentile of each value: a value on a knot gets the middle of its mass, one between knots the mass to its left.

    A range-partitioned as-of merge: distinct values and knots are laid on one line and dealt to tasks by ranges of it, the last knot at or
    before a value is carried forward inside its range, and a range starts with the last knot of the ranges before it. Rows get their
    value's percentile back by a join.
    """
    v = S.to_finite(F.col(value))
    rows, knots = cut(df.withColumn("_x", v)), cut(knots)
    ask = rows.select(F.col("_x").alias("x")).where("x is not null").distinct()
    none = F.lit(None).cast("double")
    line = ask.select("x", none.alias("knot"), none.alias("mass"), none.alias("before"), F.lit(1).alias("kind")).unionByName(
        knots.select(F.col("knot").alias("x"), "knot", "mass", "before", F.lit(0).alias("kind")))
    dealt = cut(line.repartitionByRange("x").withColumn("_p", F.spark_partition_id()))
    parts = ["knot", "mass", "before"]
    tails = {r["_p"]: r for r in dealt.where("kind = 0").groupBy("_p").agg(F.max("knot").alias("knot"), F.max_by("mass", "knot").alias("mass"), F.max_by("before", "knot").alias("before")).collect()}
    last, carried = None, []
    for p in range((dealt.agg(F.max("_p")).first()[0] or 0) + 1):  # one row a range
        carried.append(last)
        last = tails.get(p, last)
    inside = W.partitionBy("_p").orderBy("x", "kind").rowsBetween(W.unboundedPreceding, 0)

    def seen(c):
        start = F.element_at(F.array(*[F.lit(r[c] if r else None).cast("double") for r in carried]), F.col("_p") + 1)
        return F.coalesce(F.last(c, ignorenulls=True).over(inside), start).alias(c)

    met = dealt.select("x", "kind", *[seen(c) for c in parts]).where("kind = 1")
    total = knots.agg(F.max("total").alias("_t"))
    mass = F.when(F.col("knot").isNull(), 0.0).when(F.col("knot") == F.col("x"), F.col("before") + F.col("mass") / 2).otherwise(F.col("before") + F.col("mass"))
    table = met.join(total, F.lit(True)).select(F.col("x").alias("_at"), (mass / F.col("_t")).alias(out))
    return rows.join(table, F.col("_x") == F.col("_at"), "left").drop("_x", "_at")


def contract_map(df: DataFrame, contract: DataFrame, target: str, tissue: str, value: str, knots: DataFrame) -> DataFrame:
    """Rows placed on the common feature ids; the normal score is kept only where the contract has the coordinate."""
    key = contract.select(F.col("target").alias(target), F.col("tissue").alias(tissue), F.col("feature_id").alias("feature_id_common"), "feature_order")
    j = df.join(key, [target, tissue], "left")
    p = weighted_ecdf_asof(j, knots, value, "_p")
    inside = F.col("feature_id_common").isNotNull()
    return p.withColumn("common_scale_compatible", inside).withColumn("common_value", F.when(inside, S.norm_ppf(F.col("_p")))).drop("_p")
