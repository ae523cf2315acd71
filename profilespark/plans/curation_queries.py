"""Curation: selection, summaries, finalisation, score construction around the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import activity as A
from ..operators import curation as U
from ..operators import scores as X
from ..session import cut
from . import bindings as B
from .register import r, register
from .views import ENDPOINT_SQL

C = F.col
KEYS = ["profile", "target"]


@register("choose_exact", f"SELECT profile, target, assertion_id, round(pactivity, 6) AS pactivity FROM (SELECT *, row_number() OVER (PARTITION BY profile, target ORDER BY {ENDPOINT_SQL}, round(pactivity, 9) DESC, assertion_id) AS rk FROM eligible WHERE relation_class = 'EXACT' AND {ENDPOINT_SQL} IS NOT NULL) WHERE rk = 1")
def _(spark, sf):
    return A.choose_exact(B.eligible(spark, sf), KEYS, ["assertion_id", "pactivity"]).select(*KEYS, "assertion_id", r("pactivity"))


_BND = f"""SELECT *, count(*) FILTER (relation_class = 'GT_BOUND') OVER w AS n_gt, count(*) FILTER (relation_class = 'LT_BOUND') OVER w AS n_lt FROM (
  SELECT *, min(ep) OVER (PARTITION BY profile, target) AS best FROM (SELECT *, {ENDPOINT_SQL} AS ep FROM eligible WHERE relation_class IN ('GT_BOUND', 'LT_BOUND', 'BOUNDED_DIRECTION_UNKNOWN')) WHERE ep IS NOT NULL)
  WHERE ep = best AND molar > 0 WINDOW w AS (PARTITION BY profile, target)"""


@register("choose_bounded", """SELECT profile, target, CASE WHEN n_gt > 0 AND n_lt > 0 THEN 'MIXED_BOUND_DIRECTIONS_REVIEW_REQUIRED' WHEN n_gt > 0 THEN 'GT_TIGHTEST_LOWER_CONCENTRATION_BOUND' WHEN n_lt > 0 THEN 'LT_TIGHTEST_UPPER_CONCENTRATION_BOUND' ELSE 'UNKNOWN_DIRECTION_PROVISIONAL_STRONGEST_BOUNDARY' END AS bound_rule,
  CASE WHEN n_gt > 0 AND n_lt > 0 THEN NULL ELSE assertion_id END AS assertion_id FROM (
  SELECT *, row_number() OVER (PARTITION BY profile, target ORDER BY CASE WHEN n_gt > 0 THEN relation_class <> 'GT_BOUND' WHEN n_lt > 0 THEN relation_class <> 'LT_BOUND' ELSE false END,
    CASE WHEN n_gt > 0 THEN -molar WHEN n_lt > 0 THEN molar ELSE -round(pactivity, 9) END, assertion_id) AS rk FROM bnd) WHERE rk = 1""", bnd=_BND)
def _(spark, sf):
    return A.choose_bounded(B.eligible(spark, sf), KEYS, ["assertion_id"]).select(*KEYS, "bound_rule", "assertion_id")


_P = ["p_min", "p_median", "p_max", "human_p_min", "human_p_median", "human_p_max", "mammal_p_min", "mammal_p_median", "mammal_p_max"]
_J = lambda c: f"coalesce(array_to_string(list_sort(list_distinct(list({c}) FILTER (m AND trim({c}) <> ''))), ' | '), '')"
SUMMARY = f"""SELECT a.*, coalesce(s.species_basis, '') AS species_basis, coalesce(s.selection_kind, '') AS selection_kind, coalesce(s.bound_selection_rule, '') AS bound_selection_rule, s.assertion_id, s.relation_class, s.relation_operator, s.source_database, s.pactivity, s.molar,
  CASE WHEN s.pactivity IS NOT NULL AND s.relation_class = 'EXACT' THEN 'SELECTED_EXACT_MEASURED' WHEN s.pactivity IS NOT NULL AND s.relation_class IN ('GT_BOUND', 'LT_BOUND') THEN 'SELECTED_BOUNDED_MEASURED_DIRECTION_PRESERVED'
    WHEN s.pactivity IS NOT NULL THEN 'SELECTED_BOUNDED_DIRECTION_UNKNOWN_REVIEW_REQUIRED' WHEN n_measured = 0 THEN 'NO_HUMAN_OR_MAMMALIAN_MEASURED_NUMERICAL_ACTIVITY'
    WHEN n_human + n_mammal = 0 THEN 'ONLY_NONMAMMALIAN_OR_UNRESOLVED_SPECIES_MEASURED_ACTIVITY' WHEN coalesce(s.bound_selection_rule, '') <> '' THEN s.bound_selection_rule ELSE 'NO_SELECTABLE_EXACT_OR_BOUNDED_ACTIVITY' END AS selection_status
FROM (SELECT profile, target, count(*) AS n_all, count(*) FILTER (m) AS n_measured, count(*) FILTER (m AND species_class = 'HUMAN') AS n_human, count(*) FILTER (m AND species_class = 'MAMMALIAN_NONHUMAN') AS n_mammal,
    count(*) FILTER (m AND species_class = 'NON_MAMMALIAN') AS n_nonmammal, count(*) FILTER (m AND species_class = 'UNRESOLVED') AS n_unresolved,
    {_J('activity_type')} AS activity_types, {_J('species')} AS species_list, {_J('source_database')} AS sources,
    {', '.join(f"{fn}(pactivity) FILTER (m{cond}) AS {nm}_{fn}" for nm, cond in (('p', ''), ('human_p', " AND species_class = 'HUMAN'"), ('mammal_p', " AND species_class = 'MAMMALIAN_NONHUMAN'")) for fn in ('min', 'median', 'max'))}
  FROM (SELECT *, lane = 'MEASURED_NUMERICAL' AS m FROM cleaned WHERE target_status = 'MAPPED_EXACT_TARGET' AND target_grain = 'EXACT_SINGLE_PROTEIN') GROUP BY 1, 2) a
LEFT JOIN selection s ON a.profile = s.profile AND a.target = s.target"""


def exact_rows(spark, sf):
    return B.cleaned(spark, sf).where(S.is_exact_target(C("target"), C("target_status"), C("target_grain")))


def summary(spark, sf):
    rows = cut(exact_rows(spark, sf).select(*KEYS, "lane", "species_class", *B.SELECT_COLS))  # both the selection and the summary read them
    sel = A.select_activity(rows.where("lane = 'MEASURED_NUMERICAL'"), KEYS, B.SELECT_COLS)
    return U.target_activity_summary(rows, sel, KEYS, written=True)


_NS = ["n_all", "n_measured", "n_human", "n_mammal", "n_nonmammal", "n_unresolved"]


@register("target_activity_summary", f"SELECT profile, target, {', '.join(_NS)}, activity_types, species_list, sources, {', '.join(f'round({p}, 6) AS {p}' for p in _P)}, species_basis, selection_kind, bound_selection_rule, assertion_id, selection_status FROM summ", summ=SUMMARY)
def _(spark, sf):
    s = summary(spark, sf)
    return s.select(*KEYS, *_NS, "activity_types", "species_list", "sources", *[r(p) for p in _P], "species_basis", "selection_kind", "bound_selection_rule", "assertion_id", "selection_status")


_FINAL = """SELECT *, CASE WHEN patched THEN '>' ELSE relation_operator END AS op2, CASE WHEN patched THEN 'GT_BOUND' ELSE relation_class END AS rc2 FROM (
  SELECT *, coalesce(contains(source_database, 'LAB_A') AND pactivity = 5.5 AND contains(raw_status, 'WITH_EXPLICIT_RELATION_>'), false) AS patched FROM (
    SELECT *, CASE WHEN n_all % 3 <> 0 THEN 'RAW_WITH_EXPLICIT_RELATION_>' ELSE 'NO_MARKER' END AS raw_status FROM summ))"""


def final(spark, sf):
    s = summary(spark, sf).withColumn("raw_status", F.when(C("n_all") % 3 != 0, "RAW_WITH_EXPLICIT_RELATION_>").otherwise("NO_MARKER"))
    return U.finalize_relation(s, "LAB_A", 5.5, "raw_status", "WITH_EXPLICIT_RELATION_>", KEYS)


_STATUS = "CASE WHEN pactivity IS NULL THEN 'NO_SELECTED_ACTIVITY' WHEN rc2 = 'EXACT' THEN 'READY_EXACT' WHEN rc2 IN ('GT_BOUND', 'LT_BOUND') THEN 'READY_BOUNDED_RELATION_PRESERVED' ELSE 'REVIEW_RELATION' END"
_VSTAT = "CASE WHEN rc2 = 'GT_BOUND' THEN 'BOUNDED_GT' WHEN rc2 = 'LT_BOUND' THEN 'BOUNDED_LT' WHEN rc2 = 'EXACT' THEN 'EXACT' WHEN pactivity IS NOT NULL THEN 'REVIEW_RELATION' ELSE 'NO_SELECTED_ACTIVITY' END"


@register("finalize_relation", f"SELECT profile, target, patched, op2 AS relation_operator, rc2 AS relation_class, {_VSTAT} AS value_status, {_STATUS} AS input_status, round(CASE WHEN rc2 IN ('GT_BOUND', 'LT_BOUND') THEN molar * 1e9 END, 3) AS boundary_nm, coalesce(rc2 IN ('GT_BOUND', 'LT_BOUND'), false) AS is_bounded FROM fin", summ=SUMMARY, fin=_FINAL)
def _(spark, sf):
    f, _ = final(spark, sf)
    return f.select(*KEYS, "patched", "relation_operator", "relation_class", "value_status", "input_status", r("boundary_nm", 3), "is_bounded")


@register("finalize_relation_audit", f"SELECT profile, target, relation_operator AS relation_operator_before, relation_class AS relation_class_before, op2 AS relation_operator_after, rc2 AS relation_class_after, {_VSTAT} AS value_status, {_STATUS} AS input_status FROM fin WHERE patched", summ=SUMMARY, fin=_FINAL)
def _(spark, sf):
    _, a = final(spark, sf)
    return a.drop("boundary_nm")


@register("readiness_tier", """SELECT profile, target, CASE WHEN species_basis = 'HUMAN_PRIORITY' AND hs = 'RAW_EXPLICIT_HUMAN_SUPPORT' THEN 'HUMAN_RAW_EXPLICIT_SUPPORT' WHEN species_basis = 'HUMAN_PRIORITY' AND hs = 'OTHER_SOURCE_EXPLICIT_HUMAN_SUPPORT' THEN 'HUMAN_OTHER_SOURCE_EXPLICIT_SUPPORT'
  WHEN species_basis = 'HUMAN_PRIORITY' THEN 'HUMAN_CONSENSUS_SUPPORT' WHEN species_basis = 'MAMMALIAN_FALLBACK' THEN 'MAMMALIAN_FALLBACK' ELSE 'NO_PRINCIPAL_SPECIES_SELECTION' END AS provenance_tier,
  CASE WHEN pactivity IS NULL THEN 'NOT_READY_NO_SELECTED_ACTIVITY' WHEN relation_class IN ('GT_BOUND', 'LT_BOUND') THEN 'READY_BOUNDED_RELATION_PRESERVED' WHEN relation_class = 'BOUNDED_DIRECTION_UNKNOWN' THEN 'REVIEW_UNKNOWN_BOUND_DIRECTION' WHEN relation_class = 'EXACT' THEN 'READY_EXACT_NUMERIC_AS_REPORTED' ELSE 'REVIEW_RELATION_UNRESOLVED' END AS readiness
FROM (SELECT *, CASE n_all % 3 WHEN 0 THEN 'RAW_EXPLICIT_HUMAN_SUPPORT' WHEN 1 THEN 'OTHER_SOURCE_EXPLICIT_HUMAN_SUPPORT' ELSE '' END AS hs FROM summ)""", summ=SUMMARY)
def _(spark, sf):
    s = summary(spark, sf).withColumn("human_support_status", F.when(C("n_all") % 3 == 0, "RAW_EXPLICIT_HUMAN_SUPPORT").when(C("n_all") % 3 == 1, "OTHER_SOURCE_EXPLICIT_HUMAN_SUPPORT").otherwise(""))
    return U.readiness_tier(s).select(*KEYS, "provenance_tier", "readiness")


@register("value_distribution", "SELECT count(*) AS positive_values, count(*) FILTER (value_original = 2000) AS at_ceiling, count(*) FILTER (value_original > 2000) AS above_ceiling, max(value_original) AS max_value, (SELECT value_original FROM assertion WHERE value_original > 0 GROUP BY 1 ORDER BY count(*) DESC, value_original LIMIT 1) AS mode_value, CASE WHEN count(*) FILTER (value_original > 2000) > 0 THEN 'VALUES_ABOVE_CEILING_NOT_A_HARD_MAXIMUM' WHEN max(value_original) = 2000 THEN 'CEILING_IS_MAXIMUM_REVIEW' ELSE 'NO_SIMPLE_CEILING_PATTERN' END AS ceiling_status FROM assertion WHERE value_original > 0")
def _(spark, sf):
    return U.value_distribution(B.assertions(spark, sf), "value_original", 2000.0)


_SP = "CASE WHEN z IS NULL THEN 'MISSING_EXPRESSION' WHEN relation_class = 'EXACT' THEN 'EXACT' WHEN abs(z) <= 1e-15 THEN 'EXACT_ZERO_FROM_EXPRESSION_Z_ZERO' WHEN relation_class = 'BOUNDED_DIRECTION_UNKNOWN' OR relation_class IS NULL THEN 'RELATION_UNRESOLVED' WHEN (relation_class = 'GT_BOUND') = (z > 0) THEN 'BOUNDED_UPPER' ELSE 'BOUNDED_LOWER' END"


def bounded_scores(spark, sf):
    return X.bounded_score_join(B.selection(spark, sf), B.expression_z(spark, sf), "target", "tissue", "pactivity", "z", "relation_class", ("profile",))


@register("bounded_score_join", f"SELECT profile, feature_id, round(score, 6) AS score, {_SP} AS score_status FROM profiles")
def _(spark, sf):
    return bounded_scores(spark, sf).select("profile", "feature_id", r("score"), "score_status")


@register("gene_disagreements", "SELECT DISTINCT a.target, a.gene_symbol AS activity_gene, e.g AS expression_gene FROM assertion a JOIN (SELECT DISTINCT target, CASE WHEN target LIKE 'Brand#1:%' THEN 'OTHER' ELSE lower(gene_symbol) END AS g FROM expression) e ON a.target = e.target WHERE upper(a.gene_symbol) <> upper(e.g)")
def _(spark, sf):
    e = B.expression(spark, sf).withColumn("gene_symbol", F.when(C("target").startswith("Brand#1:"), "OTHER").otherwise(F.lower("gene_symbol")))
    return X.gene_disagreements(B.assertions(spark, sf), e, "target", "gene_symbol")


_CUTEXP = "SELECT * FROM expression WHERE target NOT LIKE '%PROMO'"


@register("missing_targets", "SELECT profile, target FROM selection WHERE target NOT IN (SELECT target FROM expression WHERE target NOT LIKE '%PROMO')")
def _(spark, sf):
    e = B.expression(spark, sf).where(~C("target").endswith("PROMO"))
    return X.missing_targets(B.selection(spark, sf), e, "target").select("profile", "target")


@register("derive_z_from_ratio", "SELECT profile, feature_id, round(CASE WHEN abs(pactivity) > 1e-15 THEN score / pactivity END, 6) AS z2 FROM profiles")
def _(spark, sf):
    return X.derive_z_from_ratio(B.profiles(spark, sf), "score", "pactivity", "z2").select("profile", "feature_id", r("z2"))


@register("zscore_audit", "SELECT target, count(*) AS row_count, count(DISTINCT tissue) AS unique_tissues, count(raw) AS finite_raw, count(z2) AS finite_z, 0 AS duplicate_rows, round(CASE WHEN count(DISTINCT tissue) = 25 THEN max(abs(z - z2)) END, 6) AS max_abs_residual, count(*) = 25 AND coalesce(max(abs(z - z2)) <= 1e-6, true) AS complete FROM (SELECT *, CASE WHEN feature_order % 11 = 0 THEN z + 0.01 ELSE z END AS z2 FROM expression_z) GROUP BY 1")
def _(spark, sf):
    e = B.expression_z(spark, sf).withColumn("z2", F.when(C("feature_order") % 11 == 0, C("z") + 0.01).otherwise(C("z")))
    a = X.zscore_audit(e, "target", "tissue", "raw", "z2", 25, 1e-6)
    return a.select("target", "row_count", "unique_tissues", "finite_raw", "finite_z", "duplicate_rows", r("max_abs_residual"), "complete")


@register("expression_collapse", "SELECT gene_symbol, tissue, round(median(z), 6) AS expression_z, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, count(*) AS support_rows, max(z) - min(z) > 1e-8 AS conflict, round(median(raw), 6) AS raw_median, string_agg(DISTINCT target, ' | ' ORDER BY target) AS target_ids FROM (SELECT *, substr(gene_symbol, length(gene_symbol) - 1) AS fam FROM expression_z) GROUP BY 1, 2".replace("gene_symbol, tissue, round", "fam AS gene, tissue, round", 1).replace("GROUP BY 1, 2", "GROUP BY fam, tissue"))
def _(spark, sf):
    e = B.expression_z(spark, sf).withColumn("gene", F.substring(C("gene_symbol"), F.length("gene_symbol") - 1, F.lit(2)))
    c = X.expression_collapse(e, ["gene", "tissue"], "z", "raw", "target")
    return c.select("gene", "tissue", r("expression_z"), r("z_min"), r("z_max"), "support_rows", "conflict", r("raw_median"), "target_ids")


@register("coverage_by_target", f"SELECT profile, target, count(DISTINCT tissue) AS tissue_count, count(score) AS finite_count, count(*) FILTER (starts_with(st, 'EXACT')) AS exact_count, count(*) FILTER (starts_with(st, 'BOUNDED')) AS bounded_count, round(min(z), 6) AS min_z, round(max(score), 6) AS max_score, string_agg(DISTINCT relation_class, ' | ' ORDER BY relation_class) AS sources FROM (SELECT *, {_SP} AS st FROM profiles) GROUP BY 1, 2".replace("string_agg(", "coalesce(string_agg(").replace("relation_class) AS sources", "relation_class), '') AS sources"))
def _(spark, sf):
    c = X.coverage_by_target(bounded_scores(spark, sf), "target", "tissue", "score", "score_status", "z", "relation_class", ("profile",))
    return c.select("profile", "target", "tissue_count", "finite_count", "exact_count", "bounded_count", r("min_z"), r("max_score"), "sources")


@register("crosscheck_outer", "SELECT coalesce(a.feature_order, b.feature_order) AS feature_order, coalesce(a.tissue, b.tissue) AS tissue, CASE WHEN b.tissue IS NULL THEN 'left_only' WHEN a.tissue IS NULL THEN 'right_only' ELSE 'both' END AS side, round(abs(a.z - b.z), 6) AS abs_delta_z, a.gene_symbol IS NOT DISTINCT FROM b.gene_symbol AS gene_symbol_match FROM (SELECT * FROM expression_z WHERE feature_order % 3 <> 0) a FULL JOIN (SELECT feature_order, tissue, CASE WHEN feature_order % 2 = 0 THEN lower(gene_symbol) ELSE gene_symbol END AS gene_symbol, z + 0.5 AS z FROM expression_z WHERE feature_order % 5 <> 0) b ON a.feature_order = b.feature_order AND a.tissue = b.tissue")
def _(spark, sf):
    e = B.expression_z(spark, sf)
    a = e.where("feature_order % 3 <> 0")
    b = e.where("feature_order % 5 <> 0").withColumn("gene_symbol", F.when(C("feature_order") % 2 == 0, F.lower("gene_symbol")).otherwise(C("gene_symbol"))).withColumn("z", C("z") + 0.5)
    x = X.crosscheck_outer(a, b, ["feature_order", "tissue"], ["z"], ["gene_symbol"])
    return x.select("feature_order", "tissue", "side", r("abs_delta_z"), "gene_symbol_match")


@register("panel_subset", "SELECT target, tissue, panel_order, raw FROM expression JOIN (VALUES ('nation3', 1), ('nation8', 2), ('nation21', 3)) p(key, panel_order) ON regexp_replace(lower(tissue), '[^a-z0-9]+', '', 'g') = key")
def _(spark, sf):
    panel = spark.createDataFrame([("nation3", 1), ("nation8", 2), ("nation21", 3)], "key string, panel_order int")
    return X.panel_subset(B.expression(spark, sf), F.broadcast(panel), "tissue").select("target", "tissue", "panel_order", "raw")


@register("unify_expression", "SELECT target, CASE WHEN n <> 25 THEN 'INCOMPLETE_OR_DUPLICATE_PANEL' ELSE 'TARGET_IN_BOTH' END AS violation FROM (SELECT target, count(*) AS n, count(DISTINCT tissue) AS t FROM (SELECT target, tissue FROM expression WHERE target NOT LIKE '%PROMO' UNION ALL SELECT target, tissue FROM expression WHERE target LIKE '%O' OR target LIKE 'Brand#2:%') GROUP BY 1) WHERE n <> 25 OR t <> 25 UNION ALL SELECT DISTINCT target, 'TARGET_IN_BOTH' FROM expression WHERE target LIKE 'Brand#2:%' AND target NOT LIKE '%PROMO'")
def _(spark, sf):
    e = B.expression(spark, sf).select("target", "tissue", "raw")
    old = e.where(~C("target").endswith("PROMO"))
    rec = e.where(C("target").endswith("O") | C("target").startswith("Brand#2:")).withColumn("recovered", F.lit(True))
    _, bad = X.unify_expression(old, rec, "target", "tissue", 25)
    return bad
