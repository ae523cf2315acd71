"""A query against classes of profiles (membership is many to many)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .nearest import orient_pairs
from .quantiles import exact_quantiles, with_quantiles


def _members(classes: DataFrame, query) -> DataFrame:
    return classes.where(F.col("profile") != query).select("class_id", "class_label", "profile").distinct()


def class_residuals(profiles: DataFrame, classes: DataFrame, query, value: str) -> DataFrame:
    """Query minus class median at every cell both have."""
    tested = profiles.where(F.col(value).isNotNull())
    cell = ["class_id", "class_label", "feature_id", "target", "tissue"]
    med = exact_quantiles(tested.join(_members(classes, query), "profile"), cell, {"class_median": (F.col(value), 0.5)})
    mine = tested.where(F.col("profile") == query).select("feature_id", F.col(value).alias("query_value"))
    return med.join(mine, "feature_id").withColumn("query_minus_class_median", F.col("query_value") - F.col("class_median"))


def class_summary(profiles: DataFrame, calls: DataFrame, classes: DataFrame, query, value: str) -> DataFrame:
    """Per class: residual size against the median, call overlap, and how common its calls are among the members.

    ``mean_prevalence`` divides by all members with a profile, a member without the cell counting as not calling it;
    ``mean_prevalence_tested`` divides by the members that tested it.
    """
    have = profiles.where(F.col(value).isNotNull()).select("profile").distinct()
    labels = classes.groupBy("class_id").agg(F.min("class_label").alias("class_label"))
    members = _members(classes, query).drop("class_label").join(have, "profile", "left_semi")
    size = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("members"))
    res = class_residuals(profiles, classes, query, value).groupBy("class_id").agg(
        F.count(F.lit(1)).alias("matched_features"), F.avg(F.abs("query_minus_class_median")).alias("mean_abs_residual"),
        F.sqrt(F.avg(F.col("query_minus_class_median") * F.col("query_minus_class_median"))).alias("rms_residual"))
    called = calls.select("profile", "feature_id").distinct()
    by_cell = called.join(members, "profile").groupBy("class_id", "feature_id").agg(F.count(F.lit(1)).alias("_called"))
    tested = profiles.where(F.col(value).isNotNull()).join(members, "profile").groupBy("class_id", "feature_id").agg(F.count(F.lit(1)).alias("_tested"))
    mine = called.where(F.col("profile") == query).select("feature_id", F.lit(1).alias("_q"))
    n_mine = mine.agg(F.count(F.lit(1)).alias("query_calls"))
    cells = by_cell.join(tested, ["class_id", "feature_id"], "left").join(F.broadcast(size), "class_id").join(mine, "feature_id", "left")
    over = cells.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("class_union_calls"), F.count("_q").alias("shared_calls"),
        F.avg(F.col("_called") / F.col("members")).alias("mean_prevalence"), F.avg(F.try_divide(F.col("_called"), F.col("_tested"))).alias("mean_prevalence_tested"))
    j = labels.join(size, "class_id", "left").join(res, "class_id", "left").join(over, "class_id", "left").join(F.broadcast(n_mine), F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = j.select(
        "class_id", "class_label", zero("members").alias("members"), zero("matched_features").alias("matched_features"), "mean_abs_residual", "rms_residual",
        zero("class_union_calls").alias("class_union_calls"), "query_calls", zero("shared_calls").alias("shared_calls"),
        F.coalesce("mean_prevalence", F.lit(0.0)).alias("mean_prevalence"), F.coalesce("mean_prevalence_tested", F.lit(0.0)).alias("mean_prevalence_tested"))
    union = F.col("class_union_calls") + F.col("query_calls") - F.col("shared_calls")
    status = F.when(F.col("members") == 0, "BLOCKED_MISSING_DATA").when(F.col("matched_features") > 0, "PASS").otherwise("NOT_ESTIMABLE")
    return j.withColumn("fingerprint_union", union).withColumn(
        "fingerprint_jaccard", F.when(union > 0, F.col("shared_calls") / F.when(union > 0, union)).otherwise(1.0)).withColumn("status", status)


def class_differentials(residuals: DataFrame, by: str) -> DataFrame:
    d = F.col("query_minus_class_median")
    return residuals.groupBy("class_id", by).agg(F.count(F.lit(1)).alias("matched_features"), F.avg(d).alias("mean_difference"),
                                                 F.avg(F.abs(d)).alias("mean_absolute_difference"), F.max(F.abs(d)).alias("max_absolute_difference"))


def class_distance(pairs: DataFrame, classes: DataFrame, query, metric: str = "rms") -> DataFrame:
    o = orient_pairs(pairs, query).select(F.col("comparator").alias("profile"), F.col(metric).alias("_d"))
    j = o.join(classes.select("class_id", "class_label", "profile").distinct(), "profile")
    j = cut(j)
    counted = j.groupBy("class_id", "class_label").agg(F.avg("_d").alias("mean_distance"), F.min("_d").alias("minimum_distance"), F.countDistinct("profile").alias("member_count"))
    return with_quantiles(counted, j, ["class_id", "class_label"], {"median_distance": (F.col("_d"), 0.5)})


def method_availability(status: DataFrame, statuses: list[str]) -> DataFrame:
    """Method x status counts; statuses that are not listed, and NULL, count as OTHER."""
    named = status.select("method", F.when(F.col("status").isin(statuses), F.col("status")).otherwise("OTHER").alias("status"))
    return named.groupBy("method").pivot("status", [*statuses, "OTHER"]).count().na.fill(0)
