"""Standardised reference values and score construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .quantiles import with_quantiles


def zscore_within(df: DataFrame, group: str, value: str, out: str, ddof: int = 1) -> DataFrame:
    """(x - mean) / sd inside each group; missing stays missing, a group without spread gets NULL.

    The moments are one map-side-combined aggregate joined back, so a group holding a large share of all rows is
    never sorted or held by one task.
    """
    x = S.to_finite(F.col(value))
    n, sd = F.count("_x"), F.stddev_samp("_x")
    scale = sd if ddof == 1 else F.sqrt(F.try_divide(F.var_pop("_x") * n, n - F.lit(ddof)))
    stats = (
        df.select(F.col(group).alias("_zgroup"), x.alias("_x"))
        .groupBy("_zgroup")
        .agg(
            F.avg("_x").alias("_zmean"),
            F.when((n > ddof) & (F.max("_x") > F.min("_x")), scale).alias("_zsd"),
        )
    )
    joined = df.join(stats, F.col(group).eqNullSafe(F.col("_zgroup")), "left")
    return joined.withColumn(out, F.try_divide(x - F.col("_zmean"), F.col("_zsd"))).drop("_zgroup", "_zmean", "_zsd")


def derive_z_from_ratio(df: DataFrame, score: str, strength: str, out: str) -> DataFrame:
    num, den = S.to_finite(F.col(score)), S.to_finite(F.col(strength))
    return df.withColumn(out, F.when(F.abs(den) > 1e-15, num / F.when(den != 0, den)))


def feature_id(target: Column, tissue: Column) -> Column:
    return F.concat_ws("||", target.cast("string"), tissue.cast("string"))


def score_join(
    activity: DataFrame, expression: DataFrame, target: str, tissue: str, p: str, z: str,
    keys: tuple[str, ...] = (), passthrough: tuple[str, ...] = (), out: str = "score",
) -> DataFrame:
    """Score p * z at every (target, tissue); NULL on either side stays NULL.

    With one profile (no ``keys``) every expression row is kept. With ``keys`` (a profile id) each profile is scored on
    the targets it lists, so a cell a profile never listed is absent, not zero.
    """
    act = activity.select(*keys, F.col(target).alias("_t"), F.col(p).alias("_p"), *passthrough)
    joined = expression.join(act, F.col(target) == F.col("_t"), "inner" if keys else "left")
    return (
        joined.withColumn(out, F.col("_p") * F.col(z))
        .withColumn("feature_id", feature_id(F.col(target), F.col(tissue)))
        .drop("_t")
        .withColumnRenamed("_p", p)
    )


def bounded_score_join(
    activity: DataFrame, expression: DataFrame, target: str, tissue: str, p: str, z: str, rel_class: str,
    keys: tuple[str, ...] = (), out: str = "score", digits: int = 15,
) -> DataFrame:
    """``score_join`` with the bound carried through: relation, status and a sentence for each score."""
    joined = score_join(activity, expression, target, tissue, p, z, keys, (rel_class,), out)
    p_rel = S.invert_relation(F.col(rel_class))
    bound = S.propagate_bound(F.col("pactivity_relation"), F.col(z))
    return (
        joined.withColumn("pactivity_relation", p_rel)
        .withColumn("_b", bound)
        .withColumn("score_relation", F.col("_b.relation"))
        .withColumn("score_status", F.col("_b.status"))
        .withColumn("interpretation", S.bound_interpretation(F.col("score_status"), F.col("score_relation"), F.col(out), digits))
        .drop("_b")
    )


def gene_disagreements(activity: DataFrame, expression: DataFrame, target: str, gene: str) -> DataFrame:
    """Targets whose gene symbol differs between the two tables (case ignored)."""
    a = activity.select(target, F.col(gene).alias("activity_gene")).distinct()
    e = expression.select(target, F.col(gene).alias("expression_gene")).distinct()
    return a.join(e, target).where(F.upper("activity_gene") != F.upper("expression_gene"))


def missing_targets(activity: DataFrame, expression: DataFrame, target: str) -> DataFrame:
    return activity.join(expression.select(target).distinct(), target, "left_anti")


def expression_collapse(
    df: DataFrame, keys: list[str], z: str, raw: str | None = None, ids: str | None = None, tol: float = 1e-8,
) -> DataFrame:
    """One reference value per key: median with its span, support count, conflict flag and the ids behind it."""
    x = S.to_finite(F.col(z))
    base = df.where(x.isNotNull())
    aggs = [
        F.min(x).alias("z_min"), F.max(x).alias("z_max"),
        F.count(x).alias("support_rows"), (F.max(x) - F.min(x)).alias("z_span"),
        ((F.max(x) - F.min(x)) > tol).alias("conflict"),
    ]
    medians = {"expression_z": (x, 0.5)} | ({"raw_median": (S.to_finite(F.col(raw)), 0.5)} if raw else {})
    if ids:
        aggs.append(F.array_join(F.array_sort(F.collect_set(F.col(ids).cast("string"))), " | ").alias("target_ids"))
    return with_quantiles(base.groupBy(*keys).agg(*aggs), base, keys, medians)


def zscore_audit(
    df: DataFrame, group: str, tissue: str, raw: str, z: str, n_tissues: int, tol: float = 1e-10, ddof: str | None = None,
) -> DataFrame:
    """Per group: does the stored z equal the recomputed one, and is the panel complete?"""
    recomputed = zscore_within(df, group, raw, "_rz")
    raw_x, z_x = S.to_finite(F.col(raw)), S.to_finite(F.col(z))
    per_cell = recomputed.groupBy(group, tissue).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(raw_x).alias("_raw"), F.count(z_x).alias("_z"),
        F.max(F.abs(F.col("_rz") - z_x)).alias("_res"),
        F.collect_set(S.to_finite(F.col(ddof)) if ddof else F.lit(1.0)).alias("_dd"),
    )
    out = per_cell.groupBy(group).agg(
        F.sum("_rows").alias("row_count"), F.count(tissue).alias("unique_tissues"), F.sum("_raw").alias("finite_raw"),
        F.sum("_z").alias("finite_z"), F.sum(F.when(F.col("_rows") > 1, F.col("_rows")).otherwise(0)).alias("duplicate_rows"),
        F.max("_res").alias("_res"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_dd")))).alias("_dd"),
    )
    clean = (F.col("unique_tissues") == n_tissues) & (F.col("duplicate_rows") == 0) & (F.col("finite_raw") == F.col("row_count"))
    out = out.withColumn("max_abs_residual", F.when(clean, F.col("_res")))
    complete = (
        clean & (F.col("row_count") == n_tissues) & (F.col("finite_z") == n_tissues)
        & (F.col("_dd") == F.array(F.lit(1.0)))
        & (F.col("max_abs_residual").isNull() | (F.col("max_abs_residual") <= tol))
    )
    return out.withColumn("complete", complete).drop("_res", "_dd")


def unify_expression(old: DataFrame, recovered: DataFrame, target: str, tissue: str, n_tissues: int) -> tuple[DataFrame, DataFrame]:
    """(union, violations): recovered targets must be new, coordinates unique and every target complete."""
    both = old.unionByName(recovered, allowMissingColumns=True)
    overlap = old.select(target).distinct().join(recovered.select(target).distinct(), target, "left_semi")
    shape = both.groupBy(target).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(tissue).alias("tissues"))
    bad = shape.where((F.col("rows") != n_tissues) | (F.col("tissues") != n_tissues))
    violations = overlap.withColumn("violation", F.lit("TARGET_IN_BOTH")).unionByName(
        bad.select(target, F.lit("INCOMPLETE_OR_DUPLICATE_PANEL").alias("violation"))
    )
    return both, violations


def coverage_by_target(scores: DataFrame, target: str, tissue: str, score: str, status: str, z: str, source: str,
                       keys: tuple[str, ...] = ()) -> DataFrame:
    st = F.col(status)
    return scores.groupBy(*keys, target).agg(
        F.countDistinct(tissue).alias("tissue_count"),
        F.count(S.to_finite(F.col(score))).alias("finite_count"),
        F.count_if(st.startswith("EXACT")).alias("exact_count"),
        F.count_if(st.startswith("BOUNDED")).alias("bounded_count"),
        F.min(z).alias("min_z"), F.max(z).alias("max_z"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.array_join(F.array_sort(F.collect_set(F.col(source).cast("string"))), " | ").alias("sources"),
    )


def crosscheck_outer(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], labels: list[str]) -> DataFrame:
    """Old against new on the same keys: side, absolute differences of ``values`` and equality of ``labels``."""
    x = a.select(*keys, *[F.col(v).alias(f"{v}_old") for v in values + labels], F.lit(True).alias("_a"))
    y = b.select(*keys, *[F.col(v).alias(f"{v}_new") for v in values + labels], F.lit(True).alias("_b"))
    j = x.join(y, keys, "full_outer")
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return j.select(
        *keys, side.alias("side"),
        *[c for v in values + labels for c in (f"{v}_old", f"{v}_new")],
        *[F.abs(S.to_finite(F.col(f"{v}_old")) - S.to_finite(F.col(f"{v}_new"))).alias(f"abs_delta_{v}") for v in values],
        *[F.coalesce(F.col(f"{v}_old").cast("string").eqNullSafe(F.col(f"{v}_new").cast("string"))).alias(f"{v}_match") for v in labels],
    )


def panel_subset(df: DataFrame, panel: DataFrame, label: str) -> DataFrame:
    """Rows whose normalised label is in the panel (columns ``key``, ``panel_order``); values are not restandardised."""
    keyed = df.withColumn("_k", S.canonical_key(F.col(label)))
    return keyed.join(panel.select(F.col("key").alias("_k"), "panel_order").distinct(), "_k").drop("_k")
