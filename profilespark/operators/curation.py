"""Per-target summaries of the curated assertions and the final state of a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab as V
from ..session import cut
from .quantiles import with_quantiles


def target_activity_summary(rows: DataFrame, selection: DataFrame, keys: list[str], written: bool = False) -> DataFrame:
    """Counts by species and relation, pActivity ranges, joined lists and the selection outcome per key.

    ``rows`` are the assertions on exact targets; ``selection`` is ``select_activity`` over the measured ones. One aggregate
    pass; lists are sets of the few distinct words of a group. ``rows`` are written first, unless they are already.
    """
    rows = rows.select(*keys, "lane", "pactivity", "species_class", "relation_class", "activity_type", "species", "source_database")
    rows = rows if written else cut(rows)
    measured = F.col("lane") == "MEASURED_NUMERICAL"
    p = F.col("pactivity")

    def sp(c):
        return measured & (F.col("species_class") == c)

    def span(cond, name):
        v = F.when(cond, p)
        return [F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]

    def words(c):
        return S.set_join(F.when(measured, F.col(c)))

    kinds = {"EXACT": "n_exact", "GT_BOUND": "n_gt", "LT_BOUND": "n_lt", "BOUNDED_DIRECTION_UNKNOWN": "n_unknown"}
    pools = {"HUMAN": "human", "MAMMALIAN_NONHUMAN": "mammal"}
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(measured).alias("n_measured"), F.count_if(sp("HUMAN")).alias("n_human"),
        F.count_if(sp("MAMMALIAN_NONHUMAN")).alias("n_mammal"), F.count_if(sp("NON_MAMMALIAN")).alias("n_nonmammal"), F.count_if(sp("UNRESOLVED")).alias("n_unresolved"),
        *[F.count_if(sp(s) & (F.col("relation_class") == r)).alias(f"_{n}_{k}") for s, n in pools.items() for r, k in kinds.items()],
        words("activity_type").alias("activity_types"), words("species").alias("species_list"), words("source_database").alias("sources"),
        *span(measured, "p"), *span(sp("HUMAN"), "human_p"), *span(sp("MAMMALIAN_NONHUMAN"), "mammal_p"))
    pools_of_p = {"p": measured, "human_p": sp("HUMAN"), "mammal_p": sp("MAMMALIAN_NONHUMAN")}
    agg = with_quantiles(agg, rows, keys, {f"{name}_median": (F.when(cond, p), 0.5) for name, cond in pools_of_p.items()})
    j = agg.join(selection, keys, "left")
    pool = {k: F.when(F.col("n_human") > 0, F.col(f"_human_{k}")).when(F.col("n_mammal") > 0, F.col(f"_mammal_{k}")).otherwise(0).alias(k) for k in kinds.values()}
    rc = F.col("relation_class")
    chosen = F.col("pactivity").isNotNull()
    status = (
        F.when(chosen & (rc == "EXACT"), "SELECTED_EXACT_MEASURED")
        .when(chosen & rc.isin("GT_BOUND", "LT_BOUND"), "SELECTED_BOUNDED_MEASURED_DIRECTION_PRESERVED")
        .when(chosen, "SELECTED_BOUNDED_DIRECTION_UNKNOWN_REVIEW_REQUIRED")
        .when(F.col("n_measured") == 0, "NO_HUMAN_OR_MAMMALIAN_MEASURED_NUMERICAL_ACTIVITY")
        .when(F.col("n_human") + F.col("n_mammal") == 0, "ONLY_NONMAMMALIAN_OR_UNRESOLVED_SPECIES_MEASURED_ACTIVITY")
        .when(F.coalesce("bound_selection_rule", F.lit("")) != "", F.col("bound_selection_rule"))
        .otherwise("NO_SELECTABLE_EXACT_OR_BOUNDED_ACTIVITY"))
    base = ["n_all", "n_measured", "n_human", "n_mammal", "n_nonmammal", "n_unresolved"]
    tail = ["activity_types", "species_list", "sources"] + [f"{a}_{b}" for a in ("p", "human_p", "mammal_p") for b in ("min", "median", "max")]
    return j.select(*keys, *base, *pool.values(), *tail, F.coalesce("species_basis", F.lit("")).alias("species_basis"), F.coalesce("selection_kind", F.lit("")).alias("selection_kind"),
                    F.coalesce("bound_selection_rule", F.lit("")).alias("bound_selection_rule"), "assertion_id", "activity_type", "relation_class", "relation_operator",
                    "source_database", "pactivity", "molar", status.alias("selection_status"))


def value_distribution(df: DataFrame, value: str, ceiling: float) -> DataFrame:
    """How values pile up at a ceiling: counts at and above, maximum, most frequent value (smallest on a tie), verdict."""
    per = df.where(F.col(value) > 0).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    row = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("positive_values"), F.coalesce(F.sum(F.when(F.col("v") == ceiling, F.col("n"))), F.lit(0)).alias("at_ceiling"),
        F.coalesce(F.sum(F.when(F.col("v") > ceiling, F.col("n"))), F.lit(0)).alias("above_ceiling"), F.max("v").alias("max_value"),
        F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode_value"))
    verdict = F.when(F.col("above_ceiling") > 0, "VALUES_ABOVE_CEILING_NOT_A_HARD_MAXIMUM").when(
        (F.col("max_value") == ceiling) & (F.col("at_ceiling") > 0), "CEILING_IS_MAXIMUM_REVIEW").otherwise("NO_SIMPLE_CEILING_PATTERN")
    return row.withColumn("ceiling_status", verdict)


def human_support_audit(targets: DataFrame, raw: DataFrame, cleaned: DataFrame, source_token: str) -> DataFrame:
    """Evidence that a target's selection is human: raw records, other sources, or consensus only.

    ``targets``: target, species_basis. ``raw``: rows from ``receptor_match`` with species, value, marker, record_id.
    """
    human = F.lower(S.text(F.col("species"))).rlike(r"\bhuman\b|homo sapiens")
    pos = F.when(human & (F.col("value") > 0), F.col("value"))
    r = raw.groupBy(F.col("matched_target").alias("target")).agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(human).alias("raw_human_rows"), F.min(pos).alias("raw_human_min"), F.max(pos).alias("raw_human_max"),
        S.set_join(F.when(human, F.col("marker"))).alias("raw_markers"))
    ids = raw.where(human).select(F.col("matched_target").alias("target"), "record_id").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("raw_human_ids"))
    explicit = cleaned.where((F.col("species_class") == "HUMAN") & F.col("species_method").isin("TABLE_EXPLICIT", "AUDIT_SOURCE_ASSERTION") & (F.col("lane") == "MEASURED_NUMERICAL")
                             & ~F.upper(S.text(F.col("source_database"))).contains(source_token))
    o = explicit.groupBy("target").agg(F.count(F.lit(1)).alias("other_human_rows"), S.set_join(F.col("source_database")).alias("other_sources"))
    j = targets.join(r, "target", "left").join(ids, "target", "left").join(o, "target", "left").na.fill(0, ["raw_rows", "raw_human_rows", "raw_human_ids", "other_human_rows"])
    status = F.when(F.col("raw_human_rows") > 0, "RAW_EXPLICIT_HUMAN_SUPPORT").when(F.col("other_human_rows") > 0, "OTHER_SOURCE_EXPLICIT_HUMAN_SUPPORT").when(
        F.col("species_basis") == "HUMAN_PRIORITY", "CONSENSUS_HUMAN_ONLY").otherwise("NO_EXPLICIT_HUMAN_SUPPORT_FOUND")
    return j.na.fill("", ["raw_markers", "other_sources"]).withColumn("human_support_status", status)


def _final_class(c: str = "relation_class") -> dict[str, Column]:
    rc, p = F.col(c), F.col("pactivity")
    bounded = rc.isin("GT_BOUND", "LT_BOUND")
    # The status words and notes are part of the result.
    return {
        "value_status": F.when(rc == "GT_BOUND", "BOUNDED_GT").when(rc == "LT_BOUND", "BOUNDED_LT").when(rc == "EXACT", "EXACT").when(p.isNotNull(), "REVIEW_RELATION").otherwise("NO_SELECTED_ACTIVITY"),
        "boundary_nm": F.when(bounded, F.col("molar") * 1e9), "is_bounded": F.coalesce(bounded, F.lit(False)),
        "input_status": F.when(p.isNull(), "NO_SELECTED_ACTIVITY").when(rc == "EXACT", "READY_EXACT").when(bounded, "READY_BOUNDED_RELATION_PRESERVED").otherwise("REVIEW_RELATION"),
        "input_note": F.when(rc == "GT_BOUND", "Use pActivity boundary numerically while preserving '>' relation; value is not an exact affinity.")
        .when(rc == "LT_BOUND", "Use pActivity boundary numerically while preserving '<' relation; value is not an exact affinity.")
        .when(rc == "EXACT", "Exact measured selected activity.").otherwise("No selected activity or unresolved relation."),
    }


def finalize_relation(summary: DataFrame, source_token: str, boundary_p: float, raw_status: str, marker: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(final, patch_audit): rows of the named source at the boundary whose raw record says '>' become bounded.

    Nothing else is patched; every patched row appears in the audit with its state before and after.
    """
    mask = F.upper(S.text(F.col("source_database"))).contains(source_token) & (F.col("pactivity") == boundary_p) & S.text(F.col(raw_status)).contains(marker)
    mask = F.coalesce(mask, F.lit(False))
    patched = summary.withColumns({
        "patched": mask, "relation_operator_before": F.col("relation_operator"), "relation_class_before": F.col("relation_class"),
        "relation_operator": F.when(mask, ">").otherwise(F.col("relation_operator")), "relation_class": F.when(mask, "GT_BOUND").otherwise(F.col("relation_class")),
        "selection_kind": F.when(mask, "BOUNDED_MEASURED_BOUNDARY").otherwise(F.col("selection_kind")),
        "bound_selection_rule": F.when(mask, "RAW_EXPLICIT_GT_BOUNDARY").otherwise(F.col("bound_selection_rule")),
    })
    final = patched.withColumns(_final_class())
    audit = final.where("patched").select(*keys, "relation_operator_before", "relation_class_before", F.col("relation_operator").alias("relation_operator_after"),
                                          F.col("relation_class").alias("relation_class_after"), "value_status", "boundary_nm", "input_status")
    return final.drop("relation_operator_before", "relation_class_before"), audit


def readiness_tier(summary: DataFrame, support: str = "human_support_status", pile: str | None = None, pile_word: str = "10000") -> DataFrame:
    """Provenance tier of the species, readiness of the number, and why."""
    basis, st, rc, p = F.col("species_basis"), F.col(support), F.col("relation_class"), F.col("pactivity")
    tier = F.when((basis == "HUMAN_PRIORITY") & (st == "RAW_EXPLICIT_HUMAN_SUPPORT"), "HUMAN_RAW_EXPLICIT_SUPPORT").when(
        (basis == "HUMAN_PRIORITY") & (st == "OTHER_SOURCE_EXPLICIT_HUMAN_SUPPORT"), "HUMAN_OTHER_SOURCE_EXPLICIT_SUPPORT").when(
        basis == "HUMAN_PRIORITY", "HUMAN_CONSENSUS_SUPPORT").when(basis == "MAMMALIAN_FALLBACK", "MAMMALIAN_FALLBACK").otherwise("NO_PRINCIPAL_SPECIES_SELECTION")
    ready = F.when(p.isNull(), "NOT_READY_NO_SELECTED_ACTIVITY").when(rc.isin("GT_BOUND", "LT_BOUND"), "READY_BOUNDED_RELATION_PRESERVED").when(
        rc == "BOUNDED_DIRECTION_UNKNOWN", "REVIEW_UNKNOWN_BOUND_DIRECTION").when(rc == "EXACT", "READY_EXACT_NUMERIC_AS_REPORTED").otherwise("REVIEW_RELATION_UNRESOLVED")
    piled = S.text(F.col(pile)).contains(pile_word) if pile else F.lit(False)
    why = F.when(p.isNull(), "No selected human/mammalian numerical activity.").when(rc.isin("GT_BOUND", "LT_BOUND"), "Numerical boundary available with explicit relation direction.").when(
        rc == "BOUNDED_DIRECTION_UNKNOWN", "Selected numerical boundary exists but direction remains unresolved.").when(
        (rc == "EXACT") & piled, "Numeric as reported; pile-up documented, no bound inferred without an explicit marker.").when(
        rc == "EXACT", "Exact measured numerical activity selected.").otherwise("Relation classification is unresolved.")
    return summary.withColumns({"provenance_tier": tier, "readiness": ready, "rationale": why})
