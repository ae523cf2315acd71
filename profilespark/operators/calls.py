"""Three-state call cells, call tables and set comparisons of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from .quantiles import exact_quantiles
from .ranks import positions


def alpha_name(alpha: float) -> str:
    """Column suffix of a level: 0.001 -> alpha001, 0.0001 -> alpha0001."""
    return "alpha" + f"{alpha:.10f}".rstrip("0").split(".")[1]


def call_states(profiles: DataFrame, calls: DataFrame, contract: DataFrame, roster: DataFrame, raw: str,
                common: str | None = None, alphas=V.ALPHAS) -> DataFrame:
    """Cells of the roster's profiles on the contract, with call 1 / 0 / NULL per alpha and the signed score of called cells.

    1 = called, 0 = tested and not called, NULL = unsupported. Cells come from the profile table (a row without a value is an
    unsupported cell); the empty part of the roster x contract grid is never written out.
    """
    rows = profiles.select("profile", "feature_id", F.col(raw).alias("_raw"), F.col(common or raw).alias("_common"))
    flags = calls.groupBy("profile", "feature_id").agg(
        *[F.max((F.abs(F.col("alpha") - a) < 1e-12).cast("int")).alias(f"_c{i}") for i, a in enumerate(alphas)]
    )
    mine = rows.join(roster.select("profile"), "profile", "left_semi").join(contract, "feature_id")
    j = mine.join(flags, ["profile", "feature_id"], "left")
    return j.select(
        "profile", *contract.columns,
        *[F.when(F.col(f"_c{i}") == 1, 1).when(F.col("_raw").isNotNull(), 0).alias(f"call_{alpha_name(a)}") for i, a in enumerate(alphas)],
        *[F.when(F.col(f"_c{i}") == 1, F.coalesce("_common", "_raw")).when(F.col("_raw").isNotNull(), 0.0).alias(f"score_{alpha_name(a)}")
          for i, a in enumerate(alphas)],
    )


def call_matrix_counts(states: DataFrame, call: str, contract: DataFrame) -> DataFrame:
    """Cells of every profile by state; what is neither called nor tested counts as unsupported over the whole contract, listed or not."""
    c, total = F.col(call), contract.select("feature_id").distinct().count()
    counts = states.groupBy("profile").agg(F.count_if(c == 1).alias("called"), F.count_if(c == 0).alias("tested_noncall"))
    return counts.withColumn("unsupported", F.lit(total) - F.col("called") - F.col("tested_noncall"))


def profile_call_table(calls: DataFrame, roster: DataFrame, tested: DataFrame, alpha: float) -> DataFrame:
    """Per profile and level: ranked calls; a profile without calls keeps one NO_CALLS row.

    ``tested`` has one row per profile with ``n_tested`` and ``rmax``.
    """
    at = calls.where(F.abs(F.col("alpha") - alpha) < 1e-12).drop("alpha")
    out = roster.select("profile").join(tested, "profile", "left").join(at, "profile", "left")
    return out.withColumn("alpha", F.lit(alpha)).withColumn(
        "call_status", F.when(F.col("feature_id").isNull(), "NO_CALLS").otherwise("CALLED"))


def tested_counts(profiles: DataFrame, value: str, rmax_fraction: float = 0.10) -> DataFrame:
    n = F.count(value)
    limit = F.greatest(F.least(F.floor(F.lit(rmax_fraction) * n), n - 3), F.lit(0))
    return profiles.groupBy("profile").agg(n.alias("n_tested"), limit.cast("long").alias("rmax"))


def call_nesting(calls: DataFrame, loose: float, strict: float) -> DataFrame:
    """Per profile the number of stricter calls missing from the looser set (0 everywhere when nested)."""
    flags = calls.groupBy("profile", "feature_id").agg(
        F.max((F.abs(F.col("alpha") - loose) < 1e-12).cast("int")).alias("l"),
        F.max((F.abs(F.col("alpha") - strict) < 1e-12).cast("int")).alias("s"),
    )
    return flags.groupBy("profile").agg(
        F.sum("l").alias("loose_calls"), F.sum("s").alias("strict_calls"), F.count_if((F.col("s") == 1) & (F.col("l") == 0)).alias("not_nested")
    )


def combined_call_table(calls: DataFrame, loose: float, strict: float) -> DataFrame:
    """Looser-level calls with a flag for those kept at the stricter level."""
    is_strict = F.abs(F.col("alpha") - strict) < 1e-12
    kept = calls.where(is_strict).select("profile", "feature_id", F.lit(True).alias("_k"))
    loose_rows = calls.where(F.abs(F.col("alpha") - loose) < 1e-12)
    return loose_rows.join(kept, ["profile", "feature_id"], "left").withColumn("retained_at_strict", F.col("_k").isNotNull()).drop("_k")


def called_set_membership(df: DataFrame, members: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Every row kept, with a flag for membership of its coordinate in the other set."""
    inside = members.select(*keys).distinct().withColumn("_in", F.lit(True))
    return df.join(inside, keys, "left").withColumn(flag, F.col("_in").isNotNull()).drop("_in")


def sparse_call_matrix(calls: DataFrame, index: str, columns: str, value: str, column_values: list[str]) -> DataFrame:
    """Targets by tissues with called values only."""
    return calls.groupBy(index).pivot(columns, column_values).agg(F.first(value))


def call_partition(calls: DataFrame, query, contract: DataFrame, roster: DataFrame) -> DataFrame:
    """Query calls against every comparator of the roster: SHARED / QUERY_ONLY / COMPARATOR_ONLY with feature metadata.

    A comparator without calls gets the query's as QUERY_ONLY. Comparator rows are joined to the query's calls. What a comparator lacks is the query's sorted list (one row) minus the
    list of calls they share, so no comparator x call product is formed.
    """
    q = calls.where(F.col("profile") == query).select("feature_id").distinct()
    others = calls.where(F.col("profile") != query).select(F.col("profile").alias("comparator"), "feature_id").distinct()
    marked = others.join(q.withColumn("_q", F.lit(True)), "feature_id", "left")
    theirs = marked.select("comparator", "feature_id", F.when(F.col("_q"), "SHARED").otherwise("COMPARATOR_ONLY").alias("call_status"))
    whole = q.agg(F.array_sort(F.collect_list("feature_id")).alias("_all"))
    shared = marked.groupBy("comparator").agg(F.collect_list(F.when(F.col("_q"), F.col("feature_id"))).alias("_have"))
    every = roster.where(F.col("profile") != query).select(F.col("profile").alias("comparator")).distinct().join(shared, "comparator", "left")
    every = every.withColumn("_have", F.coalesce("_have", F.array().cast("array<string>")))
    lacking = every.join(F.broadcast(whole), F.lit(True)).select("comparator", F.explode(F.array_except("_all", "_have")).alias("feature_id"))
    mine = lacking.withColumn("call_status", F.lit("QUERY_ONLY"))
    both = theirs.unionByName(mine)
    return both.join(contract.select("feature_id", "target", "tissue"), "feature_id", "left")


def support_summary(profiles: DataFrame, query, value: str) -> DataFrame:
    """Support of a query against every other profile: shared, union, and what each has alone."""
    tested = profiles.where(F.col(value).isNotNull()).select("profile", "feature_id")
    mine = tested.where(F.col("profile") == query).select("feature_id", F.lit(1).alias("_q"))
    size = mine.agg(F.count(F.lit(1)).alias("query_features"))
    per = tested.where(F.col("profile") != query).join(mine, "feature_id", "left").groupBy("profile").agg(
        F.count("_q").alias("shared_features"), F.count(F.lit(1)).alias("comparator_features"))
    out = per.join(size, F.lit(True))
    return out.select(
        F.col("profile").alias("comparator"), "shared_features",
        (F.col("query_features") + F.col("comparator_features") - F.col("shared_features")).alias("union_features"),
        (F.col("query_features") - F.col("shared_features")).alias("query_only_features"),
        (F.col("comparator_features") - F.col("shared_features")).alias("comparator_only_features"),
    )


def scope_exclusive_calls(wide: DataFrame, narrow: DataFrame, keys: list[str]) -> DataFrame:
    return wide.join(narrow.select(*keys).distinct(), keys, "left_anti")


def key_set_equality(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sizes, duplicates and differences of two coordinate sets."""
    x = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    y = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"))
    j = x.join(y, keys, "full_outer")
    out = j.agg(
        F.count("_na").alias("keys_a"), F.count("_nb").alias("keys_b"),
        F.count_if(F.col("_nb").isNull()).alias("only_a"), F.count_if(F.col("_na").isNull()).alias("only_b"),
        F.count_if((F.col("_na") > 1) | (F.col("_nb") > 1)).alias("duplicated"),
    )
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0)).withColumn("a_subset_of_b", F.col("only_a") == 0)


def profiles_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def replace_by_id(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """The new rows, and the old rows whose id is not replaced."""
    kept = old.join(new.select(id_col).distinct(), id_col, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def scope_reconciliation(narrow: DataFrame, wide: DataFrame, scores: DataFrame, keys: list[str], tol: float = 1e-10) -> DataFrame:
    """Narrow-panel calls against the wide-panel scores and calls: HR_MATCH / HR_DIFFERENCE / MISSING.

    ``narrow`` carries ``value``; ``wide`` is the wide call set; ``scores`` carries every wide value.
    """
    w = wide.select(*keys).distinct().withColumn("_w", F.lit(True))
    s = scores.select(*keys, F.col("value").alias("wide_value"))
    j = narrow.join(s, keys, "left").join(w, keys, "left")
    status = F.when(F.col("wide_value").isNull(), "MISSING").when(F.abs(F.col("value") - F.col("wide_value")) <= tol, "HR_MATCH").otherwise("HR_DIFFERENCE")
    return j.withColumn("scope_status", status).withColumn("called_in_wide", F.col("_w").isNotNull()).drop("_w")


def tissue_class_counts(calls: DataFrame, tissue_class: DataFrame, retained: str) -> DataFrame:
    """Calls by tissue class with distinct targets, tissues and the number kept at the stricter level."""
    j = calls.join(tissue_class, "tissue", "left").withColumn("tissue_class", F.coalesce("tissue_class", F.lit("UNCLASSIFIED")))
    return j.groupBy("tissue_class").agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("target").alias("targets"), F.countDistinct("tissue").alias("tissues"),
        F.count_if(F.col(retained)).alias("retained_calls"),
    )


def axis_order(calls: DataFrame, axis: str, value: str) -> DataFrame:
    """Axis labels by their maximum value, largest first, ties by name (a dictionary-sized result)."""
    top = calls.groupBy(axis).agg(F.max(value).alias("max_value"))
    return positions(top, [F.desc("max_value"), axis], "axis_rank")


def rank_of_calls_shown(calls: DataFrame, k: int) -> DataFrame:
    """Calls of rank 1..k, with a flag telling whether the profile's shown ranks are consecutive."""
    shown = calls.where(F.col("call_rank") <= k)
    ok = shown.groupBy("profile", "alpha").agg(
        ((F.max("call_rank") == F.count(F.lit(1))) & (F.min("call_rank") == 1) & (F.countDistinct("call_rank") == F.count(F.lit(1)))).alias("consecutive"))
    return shown.join(ok, ["profile", "alpha"])


def robust_bound(df: DataFrame, profile: str, value: str, q: float | None = 0.99) -> DataFrame:
    """Colour bound per profile: quantile (or maximum) of absolute values, zero replaced by one."""
    tested = df.where(F.col(value).isNotNull())
    top = tested.groupBy(profile).agg(F.max(F.abs(value)).alias("_b")) if q is None else exact_quantiles(tested, [profile], {"_b": (F.abs(value), q)})
    return top.select(profile, F.when(F.col("_b") > 0, F.col("_b")).otherwise(1.0).alias("bound"))


def profile_coverage(profiles: DataFrame, contract: DataFrame, value: str) -> DataFrame:
    """Supported and total features and targets per profile, with fractions."""
    totals = contract.agg(F.countDistinct("feature_id").alias("total_features"), F.countDistinct("target").alias("total_targets"))
    per = profiles.groupBy("profile").agg(
        F.count(value).alias("supported_features"), F.countDistinct(F.when(F.col(value).isNotNull(), F.col("target"))).alias("supported_targets"))
    return per.join(F.broadcast(totals), F.lit(True)).select(
        "profile", "supported_features", "total_features", (F.col("supported_features") / F.col("total_features")).alias("feature_fraction"),
        "supported_targets", "total_targets", (F.col("supported_targets") / F.col("total_targets")).alias("target_fraction"))
