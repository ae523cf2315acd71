"""Rankings of comparators: orientation, nearest and runner-up, class-wise nearest, top tables.

Top-k selections filter ``row_number() <= k``, which Spark turns into a per-task group limit before the shuffle, so at most k
rows per task and group move, however large the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .quantiles import with_quantiles
from .ranks import group_positions, group_ranks

# metric column, smaller is nearer, label
METRICS = [("rms", True, "RMS"), ("cosine", False, "COSINE"), ("spearman", False, "SPEARMAN"),
           ("alpha001_call_jaccard", False, "FINGERPRINT_JACCARD"), ("support_jaccard", False, "SUPPORT_JACCARD")]
ROUNDING = 1e-12  # share of a value that a few roundings may change


def orient_pairs(pairs: DataFrame, query=None, eligible: DataFrame | None = None, signed: tuple[str, ...] = ()) -> DataFrame:
    """Pairs seen from a query (or, with none named, from both sides): ``query``, ``comparator``, signed values flipped."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    flip = [(-F.col(c)).alias(c) if c in signed else F.col(c) for c in rest]
    fwd = pairs.select(F.col("a").alias("query"), F.col("b").alias("comparator"), *rest)
    back = pairs.select(F.col("b").alias("query"), F.col("a").alias("comparator"), *flip)
    both = fwd.unionByName(back)
    if query is not None:
        both = both.where(F.col("query") == query)
    if eligible is not None:
        both = both.join(eligible.select(F.col("profile").alias("comparator")).distinct(), "comparator", "left_semi").select(*fwd.columns)
    return both


def _long_metrics(oriented: DataFrame, metrics, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per (query, comparator, metric) with ``key`` rising as the comparator gets farther."""
    parts = [
        F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"), (F.col(c).cast("double") * (1 if up else -1)).alias("key"))
        for c, up, label in metrics if c in oriented.columns
    ]
    return oriented.select("query", "comparator", *carry, F.explode(F.array(*parts)).alias("_m")).select("query", "comparator", *carry, "_m.*").where("value is not null")


def _top(df: DataFrame, groups: list[str], k: int, *order: Column) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank", rn).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def settled(c: str) -> Column:
    """A computed number as rankings see it: values that differ by the order of their sums only are one, so the name decides."""
    return F.round(c, 12)


def _first_two(df: DataFrame, groups: list[str]) -> DataFrame:
    top = _top(df, groups, 2, settled("key"), F.col("comparator"))

    def at(r, c):
        return F.max(F.when(F.col("rank") == r, F.col(c)))

    return top.groupBy(*groups).agg(at(1, "comparator").alias("nearest"), at(1, "value").alias("nearest_value"),
                                    at(2, "comparator").alias("runner_up"), at(2, "value").alias("runner_up_value"))


def nearest_summary(pairs: DataFrame, query, eligible: DataFrame | None = None, metrics=METRICS) -> DataFrame:
    """Per metric the nearest comparator, the runner-up and the margin; ties go to the smaller name."""
    picks = _first_two(_long_metrics(orient_pairs(pairs, query, eligible), metrics), ["metric"])
    spark = pairs.sparkSession
    names = spark.createDataFrame([(label,) for c, _, label in metrics if c in pairs.columns], "metric string")
    return names.join(picks, "metric", "left").select(
        "metric", "nearest", "nearest_value", "runner_up", "runner_up_value", F.abs(F.col("nearest_value") - F.col("runner_up_value")).alias("margin"),
        F.when(F.col("nearest_value").isNull(), "NOT_ESTIMABLE").otherwise("PASS").alias("status"))


def nearest_within_family(pairs: DataFrame, roster: DataFrame, metrics=METRICS) -> DataFrame:
    """Nearest member for every member and metric, with the support behind it."""
    long = _long_metrics(orient_pairs(pairs), metrics, ("matched_features", "matched_targets"))
    return nearest_of(long, roster, [label for c, _, label in metrics if c in pairs.columns])


def nearest_of(long: DataFrame, roster: DataFrame, labels: list[str]) -> DataFrame:
    """``nearest_within_family`` from rows (query, comparator, metric, value, key, matched_features, matched_targets) that hold every nearest one."""
    top = _top(long, ["query", "metric"], 1, settled("key"), F.col("comparator")).drop("rank", "key")
    grid = roster.select(F.col("profile").alias("query"), F.explode(F.array(*[F.lit(label) for label in labels])).alias("metric"))
    j = grid.join(top, ["query", "metric"], "left")
    return j.select("query", "metric", F.col("comparator").alias("nearest"), F.col("value").alias("metric_value"),
                    F.coalesce("matched_features", F.lit(0)).alias("matched_features"), F.coalesce("matched_targets", F.lit(0)).alias("matched_targets"),
                    F.when(F.col("value").isNull(), "NOT_ESTIMABLE").otherwise("PASS").alias("status"))


def class_nearest(pairs: DataFrame, query, classes: DataFrame, metric: str = "rms") -> DataFrame:
    """Nearest comparator inside each class, its average-rank percentile and the margin to the second."""
    o = orient_pairs(pairs, query).select("comparator", F.col(metric).alias("value")).where("value is not null")
    labels = classes.groupBy("class_id").agg(F.min("class_label").alias("class_label"))
    members = classes.select("class_id", F.col("profile").alias("comparator")).distinct()
    j = members.join(o, "comparator")
    two = _first_two(j.withColumn("key", F.col("value")), ["class_id"])
    size = j.groupBy("class_id", "value").agg(F.count(F.lit(1)).alias("_c"))
    tied = size.groupBy("class_id").agg(F.min_by("_c", "value").alias("_ties"), F.sum("_c").alias("_n"))
    out = labels.join(two, "class_id", "left").join(tied, "class_id", "left")
    return out.select(
        "class_id", "class_label", F.when(F.col("nearest_value").isNull(), "NOT_ESTIMABLE").otherwise("PASS").alias("status"),
        F.col("nearest").alias("nearest_comparator"), F.col("nearest_value").alias(metric),
        ((F.col("_ties") + 1) / 2 / F.col("_n")).alias("percentile_in_class"), (F.col("runner_up_value") - F.col("nearest_value")).alias("margin"))


def class_nearest_wide(nearest: DataFrame, labels: list[str]) -> DataFrame:
    return nearest.groupBy("status").pivot("class_label", labels).agg(F.first("nearest_comparator"))


def pair_group_summary(detail: DataFrame, by: str, pair: tuple[str, str] = ("a", "b"), left: str = "value_a", right: str = "value_b") -> DataFrame:
    """Per pair and target (or tissue): matched cells, both means, signed, absolute and largest difference."""
    return detail.groupBy(*pair, by).agg(
        F.count(F.lit(1)).alias("matched_features"), F.avg(left).alias("query_mean"), F.avg(right).alias("comparator_mean"),
        F.avg("signed_difference").alias("mean_difference"), F.avg("absolute_difference").alias("mean_absolute_difference"),
        F.max("absolute_difference").alias("max_absolute_difference"))


QUERY_PAIR = dict(pair=("query", "comparator"), left="query_value", right="comparator_value")


def pair_top_tables(detail: DataFrame, k: int = 20, k_coord: int = 30) -> dict[str, DataFrame]:
    """Top tables of every pair of a query's detail: shared strength, query higher, comparator higher, residual, coordinates."""
    pair = ["query", "comparator"]
    targets = pair_group_summary(detail, "target", **QUERY_PAIR)
    tissues = pair_group_summary(detail, "tissue", **QUERY_PAIR)
    strength = targets.withColumn("shared_strength", F.least(F.abs("query_mean"), F.abs("comparator_mean")))
    return {
        "shared": _top(strength, pair, k, F.desc("shared_strength"), F.col("target")),
        "query_higher": _top(targets, pair, k, F.desc("mean_difference"), F.col("target")),
        "comparator_higher": _top(targets, pair, k, F.asc("mean_difference"), F.col("target")),
        "residual": _top(targets, pair, k, F.desc("mean_absolute_difference"), F.col("target")),
        "tissues": _top(tissues, pair, k, F.desc("mean_absolute_difference"), F.col("tissue")),
        "coordinates": _top(detail, pair, k_coord, F.desc("absolute_difference"), F.col("feature_id")),
    }


def top_positive_negative(detail: DataFrame, k: int = 25) -> DataFrame:
    """The k largest, smallest and absolutely largest coordinates of every pair, as one tagged table."""
    pair = ["query", "comparator"]
    d = F.col("signed_difference")
    parts = [("POSITIVE", d.desc()), ("NEGATIVE", d.asc()), ("ABSOLUTE", F.abs(d).desc())]
    frames = [_top(detail, pair, k, o, F.col("feature_id")).withColumn("table", F.lit(t)) for t, o in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def top_shared_targets(detail: DataFrame, k: int = 20) -> DataFrame:
    per = detail.groupBy("query", "comparator", "target").agg(F.count(F.lit(1)).alias("shared_features"), F.avg("absolute_difference").alias("mean_absolute_difference"))
    return _top(per, ["query", "comparator"], k, F.desc("shared_features"), settled("mean_absolute_difference"), F.col("target"))


def ranked_scores(scores: DataFrame, score: str, tie: str, groups: list[str]) -> DataFrame:
    """Scores ranked by absolute value inside each profile; ranges of the whole order are ranked, so no task holds a profile."""
    return group_positions(scores.where(F.col(score).isNotNull()), groups, [F.abs(score).desc(), F.col(tie)], "abs_rank")


def query_ranking(pairs: DataFrame, query, subset: DataFrame, metrics=METRICS + [("pearson", False, "PEARSON")]) -> DataFrame:
    """One row per named comparator and metric with its place (1 = nearest, ties share the better place)."""
    long = _long_metrics(orient_pairs(pairs, query, subset), metrics, ("matched_features", "matched_targets"))
    return group_ranks(cut(long), ["metric"], "key", "place").drop("key")


def residual_recurrence(detail: DataFrame, by: str) -> DataFrame:
    """Across a query's comparators, how targets (or tissues) differ: mean, median, absolute mean, sign counts."""
    per = cut(pair_group_summary(detail, by, **QUERY_PAIR))
    counted = per.groupBy("query", by).agg(
        F.countDistinct("comparator").alias("comparator_count"), F.avg("mean_difference").alias("mean_difference"),
        F.avg("mean_absolute_difference").alias("mean_absolute_difference"),
        F.count_if(F.col("mean_difference") > 0).alias("positive_comparators"), F.count_if(F.col("mean_difference") < 0).alias("negative_comparators"))
    return with_quantiles(counted, per, ["query", by], {"median_difference": (F.col("mean_difference"), 0.5)})


def exact_equality_audit(detail: DataFrame) -> DataFrame:
    """Per comparator the matched features and those at which it equals the query. One molar value reached from two units differs in the
    last bits, and so do means by the order of their sums: values are equal if they differ by such rounding only."""
    gap, size = F.abs("signed_difference"), F.greatest(F.abs("query_value"), F.abs("comparator_value"))
    eq = F.count_if((gap <= ROUNDING * size) & (gap < float("inf")))
    return detail.groupBy("query", "comparator").agg(F.count(F.lit(1)).alias("matched_features"), eq.alias("exact_equal_features"),
                                                     (eq / F.count(F.lit(1))).alias("exact_equality_fraction"))


def unique_call_recurrence(calls: DataFrame, query, roster: DataFrame) -> DataFrame:
    """For each call of the query, how many comparators do not call it (0 rows dropped)."""
    q = calls.where(F.col("profile") == query).select("feature_id").distinct()
    others = roster.where(F.col("profile") != query).agg(F.count(F.lit(1)).alias("n"))
    also = calls.where(F.col("profile") != query).join(q, "feature_id", "left_semi").groupBy("feature_id").agg(F.countDistinct("profile").alias("also"))
    j = q.join(also, "feature_id", "left").join(F.broadcast(others), F.lit(True))
    return j.select("feature_id", (F.col("n") - F.coalesce("also", F.lit(0))).alias("comparator_count")).where("comparator_count > 0")
