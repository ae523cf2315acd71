"""One-sided upper-tail generalized ESD as a running window, without iteration.

Removing the largest value again and again means walking a profile from its top; the values still in the set are then a
prefix of the ascending order, so count, mean and spread of every step are running aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab as V
from ..functions.student import gesd_critical

HOT_ROWS = 2_000_000
TAIL_BUCKETS = 64


def _finish(df: DataFrame, profile: str, value: str, rmax_fraction: float) -> DataFrame:
    """Step number, statistic and the rule that ends the walk; expects _n, _mean, _sd, _total, _min."""
    step = (F.col("_total") - F.col("_n") + 1).cast("long")
    limit = F.least(F.floor(F.lit(rmax_fraction) * F.col("_total")), F.col("_total") - 3)
    return (
        df.withColumn("step", step)
        .where((F.col("step") <= limit) & (F.col(value) > F.col("_min")) & (F.col("_sd") > 0))
        .withColumn("n", F.col("_n").cast("long"))
        .withColumn("r_stat", (F.col(value) - F.col("_mean")) / F.col("_sd"))
        .drop("_n", "_mean", "_sd", "_total", "_min")
    )


def _whole_profile_steps(df: DataFrame, profile: str, value: str, order: str, rmax_fraction: float) -> DataFrame:
    up = W.partitionBy(profile).orderBy(F.col(value).asc(), F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    everyone = W.partitionBy(profile)
    moments = df.select(
        "*", F.count(F.lit(1)).over(up).alias("_n"), F.avg(value).over(up).alias("_mean"), F.stddev_samp(value).over(up).alias("_sd"),
        F.count(F.lit(1)).over(everyone).alias("_total"), F.min(value).over(everyone).alias("_min"),
    )
    return _finish(moments, profile, value, rmax_fraction)


def _tail_steps(df: DataFrame, cuts: DataFrame, profile: str, value: str, order: str, rmax_fraction: float) -> DataFrame:
    """Same result for very large profiles: only the top slice is sorted, in buckets seeded with the moments below them.

    Everything under the first cut point is reduced to (n, mean, M2) by a partial aggregate. Bucket edges are values, so
    equal values share a bucket and approximate edges change the balance of the work, never the result.
    """
    edges = F.col("_cuts")
    bucket = F.when(F.col(value) < edges[0], 0).otherwise(F.size(F.filter(edges, lambda c: c <= F.col(value))))
    placed = df.join(F.broadcast(cuts), profile).withColumn("_bucket", bucket)
    m2 = F.var_pop(value) * F.count(F.lit(1))
    sums = placed.groupBy(profile, "_bucket").agg(
        F.count(F.lit(1)).cast("double").alias("bn"), F.avg(value).alias("bmean"), m2.alias("bm2"), F.min(value).alias("bmin")
    )
    # A handful of bucket rows per profile: fold them into the moments of everything strictly below each bucket.
    folded = sums.groupBy(profile).agg(
        F.array_sort(F.collect_list(F.struct("_bucket", "bn", "bmean", "bm2", "bmin"))).alias("_b"),
        F.sum("bn").alias("_total"), F.min("bmin").alias("_min"),
    )
    below = folded.select(profile, "_total", "_min", F.posexplode("_b").alias("_i", "_e"), F.col("_b").alias("_all"))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(acc, e):
        n = acc["n"] + e["bn"]
        d = e["bmean"] - acc["mean"]
        return F.struct(
            n.alias("n"), (acc["mean"] + d * e["bn"] / n).alias("mean"),
            (acc["m2"] + e["bm2"] + d * d * acc["n"] * e["bn"] / n).alias("m2"),
        )

    below = below.select(
        profile, "_total", "_min", F.col("_e._bucket").alias("_bucket"),
        F.aggregate(F.slice("_all", F.lit(1), F.col("_i")), zero, merge).alias("_below"),
    )
    up = W.partitionBy(profile, "_bucket").orderBy(F.col(value).asc(), F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    top = placed.where("_bucket > 0").select(
        "*", F.count(F.lit(1)).over(up).cast("double").alias("_k"), F.avg(value).over(up).alias("_km"),
        (F.var_pop(value).over(up) * F.count(F.lit(1)).over(up)).alias("_k2"),
    )
    j = top.join(F.broadcast(below), [profile, "_bucket"])
    n = F.col("_below.n") + F.col("_k")
    d = F.col("_km") - F.col("_below.mean")
    m2_all = F.col("_below.m2") + F.col("_k2") + d * d * F.col("_below.n") * F.col("_k") / n
    j = j.withColumn("_n", n).withColumn("_mean", F.col("_below.mean") + d * F.col("_k") / n)
    j = j.withColumn("_sd", F.when(n > 1, F.sqrt(m2_all / F.when(n > 1, n - 1))))
    return _finish(j.drop("_cuts", "_bucket", "_below", "_k", "_km", "_k2", "_rows"), profile, value, rmax_fraction)


def gesd_steps(
    df: DataFrame, profile: str, value: str, order: str, rmax_fraction: float = 0.10, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """All attempted removals of every profile: ``step``, ``n`` left before it, statistic ``r_stat``.

    At most floor(fraction * n) removals and never below three values; equal values leave in ``order``. One count per
    profile (an action) finds the profiles above ``hot_rows`` values; these take the bucketed path, and since there are at
    most rows / hot_rows of them their cut points can be broadcast. ``hot_rows=None`` skips the count and declares that no
    profile is that large.
    """
    finite = df.withColumn(value, S.to_finite(F.col(value))).where(F.col(value).isNotNull())
    sized = finite.groupBy(profile).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows) if hot_rows else None
    if sized is None or sized.isEmpty():
        return _whole_profile_steps(finite, profile, value, order, rmax_fraction)
    start = max(0.0, 1.0 - rmax_fraction - 0.01)
    points = [start + (1.0 - start) * i / TAIL_BUCKETS for i in range(TAIL_BUCKETS)]
    hot = F.broadcast(sized.select(profile))
    cuts = finite.join(hot, profile, "left_semi").groupBy(profile).agg(
        F.percentile_approx(value, points, 10000).alias("_cuts")
    )
    cold_steps = _whole_profile_steps(finite.join(hot, profile, "left_anti"), profile, value, order, rmax_fraction)
    hot_steps = _tail_steps(finite, cuts, profile, value, order, rmax_fraction)
    return cold_steps.unionByName(hot_steps.select(*cold_steps.columns))


def gesd_calls(
    df: DataFrame, profile: str, value: str, order: str, alphas=V.ALPHAS, rmax_fraction: float = 0.10,
    hot_rows: int | None = HOT_ROWS, steps: DataFrame | None = None,
) -> DataFrame:
    """Called rows per profile and alpha: every removal up to the last one whose statistic exceeds its threshold."""
    walked = steps if steps is not None else gesd_steps(df, profile, value, order, rmax_fraction, hot_rows)
    levels = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    tested = walked.withColumn("alpha", levels).withColumn("critical_lambda", gesd_critical("n", "alpha"))
    last = tested.where("r_stat > critical_lambda").groupBy(profile, "alpha").agg(F.max("step").alias("_last"))
    return (
        tested.join(last, [profile, "alpha"])
        .where("step <= _last")
        .withColumn("r_minus_lambda", F.col("r_stat") - F.col("critical_lambda"))
        .withColumn("call_rank", F.col("step"))
        .drop("_last")
    )
