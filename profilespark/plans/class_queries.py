"""Rankings, residuals, classes and the common-scale projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classes as L
from ..operators import ecdf as E
from ..operators import nearest as N
from ..operators import pairs as P
from ..session import cut
from . import bindings as B
from .pair_queries import DETAIL, PAIR_VIEWS, QC, _fp_views, detail, vector_metrics
from .register import r, register
from .scalar_queries import ppf_sql

C = F.col


def vector_pairs(spark, sf):
    """Continuous metrics with the call Jaccard of the looser level."""
    return P.all_pairwise(B.vectors(spark, sf), B.vector_calls(spark, sf), B.vector_roster(spark, sf), "value", (0.001,), 64, False, ("rms", "cosine", "spearman"))


def pairs_of(spark, sf, query):
    """The pairs of one query, without building all others."""
    return P.query_pairs(B.vectors(spark, sf), query, "value", B.vector_calls(spark, sf), (0.001,))


_FP = _fp_views(0.001)
_LONG = """SELECT q AS query, c AS comparator, metric, value, k AS key, matched_features, matched_targets FROM (
  SELECT x.*, unnest(['RMS', 'COSINE', 'SPEARMAN', 'FINGERPRINT_JACCARD', 'SUPPORT_JACCARD', 'PEARSON']) AS metric, unnest([rms, cosine, spearman, call_jaccard, support_jaccard, pearson]) AS value, unnest([rms, -cosine, -spearman, -call_jaccard, -support_jaccard, -pearson]) AS k
  FROM (SELECT a AS q, b AS c, * FROM both_m UNION ALL SELECT b, a, * FROM both_m) x) WHERE value IS NOT NULL"""
NEAR = dict(PAIR_VIEWS, **_FP, both_m="SELECT m.*, fp.call_jaccard FROM metrics m JOIN fp ON m.a = fp.a AND m.b = fp.b", lng=_LONG)
_CONT = dict(PAIR_VIEWS)
_ORIENT = "SELECT 0 AS query, CASE WHEN a = 0 THEN b ELSE a END AS comparator, * FROM metrics WHERE a = 0 OR b = 0"


@register("orient_pairs", "SELECT comparator, round(rms, 6) AS rms, round(CASE WHEN a = 3 THEN d ELSE -d END, 6) AS diff FROM (SELECT CASE WHEN a = 3 THEN b ELSE a END AS comparator, a, sqrt(avg(d * d)) AS rms, sum(va - vb) AS d FROM matched WHERE a = 3 OR b = 3 GROUP BY a, b)", matched=PAIR_VIEWS["matched"])
def _(spark, sf):
    d = P.pair_detail(B.vectors(spark, sf), 3, "value").groupBy("query", "comparator").agg(
        F.sqrt(F.avg(C("absolute_difference") * C("absolute_difference"))).alias("rms"), F.sum("signed_difference").alias("diff"))
    first = C("query") < C("comparator")
    pairs = d.select(F.least("query", "comparator").alias("a"), F.greatest("query", "comparator").alias("b"), "rms", F.when(first, C("diff")).otherwise(-C("diff")).alias("diff"))
    return N.orient_pairs(pairs, 3, signed=("diff",)).select("comparator", r("rms"), r("diff"))


@register("nearest_summary", """SELECT metric, max(CASE WHEN rk = 1 THEN comparator END) AS nearest, round(max(CASE WHEN rk = 1 THEN value END), 6) AS nearest_value, max(CASE WHEN rk = 2 THEN comparator END) AS runner_up,
  round(abs(max(CASE WHEN rk = 1 THEN value END) - max(CASE WHEN rk = 2 THEN value END)), 6) AS margin, 'PASS' AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(key, 12), comparator) AS rk FROM lng WHERE query = 0 AND metric <> 'PEARSON') GROUP BY 1""", **NEAR)
def _(spark, sf):
    return N.nearest_summary(pairs_of(spark, sf, 0), 0).select("metric", "nearest", r("nearest_value"), "runner_up", r("margin"), "status")


@register("nearest_within_family", """SELECT query, metric, comparator AS nearest, round(value, 6) AS metric_value, matched_features, matched_targets, 'PASS' AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY query, metric ORDER BY round(key, 12), comparator) AS rk FROM lng WHERE metric <> 'PEARSON') WHERE rk = 1""", **NEAR)
def _(spark, sf):
    roster = B.vector_roster(spark, sf)
    found = P.nearest_candidates(B.vectors(spark, sf), B.vector_calls(spark, sf), roster, "value", N.METRICS, n_features=64)
    n = N.nearest_within_family(vector_pairs(spark, sf), roster) if found is None else N.nearest_of(found, roster, [label for *_, label in N.METRICS])
    return n.select("query", "metric", "nearest", r("metric_value"), "matched_features", "matched_targets", "status")


_NEARC = """SELECT class_id, class_label, 'PASS' AS status, min(CASE WHEN rk = 1 THEN comparator END) AS nearest_comparator, round(min(CASE WHEN rk = 1 THEN rms END), 6) AS rms,
  round(min(CASE WHEN rk = 1 THEN avg_rank END) / count(*), 6) AS percentile_in_class, round(min(CASE WHEN rk = 2 THEN rms END) - min(CASE WHEN rk = 1 THEN rms END), 6) AS margin
FROM (SELECT class_id, class_label, comparator, rms, row_number() OVER (PARTITION BY class_id ORDER BY round(rms, 12), comparator) AS rk,
  rank() OVER (PARTITION BY class_id ORDER BY rms) + (count(*) OVER (PARTITION BY class_id, rms) - 1) / 2.0 AS avg_rank FROM orient JOIN vector_classes c ON c.profile = comparator) GROUP BY 1, 2"""


@register("class_nearest", _NEARC, **PAIR_VIEWS, orient=_ORIENT)
def _(spark, sf):
    c = N.class_nearest(P.query_pairs(B.vectors(spark, sf), 0, "value"), 0, B.vector_classes(spark, sf))
    return c.select("class_id", "class_label", "status", "nearest_comparator", r("rms"), r("percentile_in_class"), r("margin"))


@register("query_ranking", "SELECT query, comparator, metric, round(value, 6) AS value, matched_features, matched_targets, rank() OVER (PARTITION BY metric ORDER BY key) AS place FROM lng JOIN embeddings e ON e.vec_id = comparator WHERE query = 0 AND e.label = 3", **NEAR)
def _(spark, sf):
    sub = B.table(spark, sf, "embeddings").where("label = 3").select(C("vec_id").alias("profile"))
    return N.query_ranking(pairs_of(spark, sf, 0), 0, sub).select("query", "comparator", "metric", r("value"), "matched_features", "matched_targets", "place")


_GROUP = "count(*) AS matched_features, round(avg({l}), 6) AS query_mean, round(avg({r}), 6) AS comparator_mean, round(avg({d}), 6) AS mean_difference, round(avg(abs({d})), 6) AS mean_absolute_difference, round(max(abs({d})), 6) AS max_absolute_difference"
_G = ["query_mean", "comparator_mean", "mean_difference", "mean_absolute_difference", "max_absolute_difference"]


@register("pair_group_summary", f"SELECT a, b, target, {_GROUP.format(l='va', r='vb', d='(va - vb)')} FROM matched GROUP BY 1, 2, 3", matched=PAIR_VIEWS["matched"])
def _(spark, sf):
    m = P.pair_sums(B.vectors(spark, sf), B.vector_roster(spark, sf), "value", "target", n_features=64)
    return m.select("a", "b", "target", "matched_features", *[r(c) for c in _G])


_D = dict(detail=DETAIL)


@register("residual_recurrence", "SELECT query, tissue, count(*) AS comparator_count, round(avg(md), 6) AS mean_difference, round(median(md), 6) AS median_difference, round(avg(mad), 6) AS mean_absolute_difference, count(*) FILTER (md > 1e-9) AS positive_comparators, count(*) FILTER (md < -1e-9) AS negative_comparators FROM (SELECT query, comparator, tissue, avg(signed_difference) AS md, avg(absolute_difference) AS mad FROM detail GROUP BY 1, 2, 3) GROUP BY 1, 2", **_D)
def _(spark, sf):
    rec = N.residual_recurrence(detail(spark, sf), "tissue")
    return rec.select("query", "tissue", "comparator_count", r("mean_difference"), r("median_difference"), r("mean_absolute_difference"), "positive_comparators", "negative_comparators")


@register("exact_equality_audit", "SELECT query, comparator, count(*) AS matched_features, count(*) FILTER (signed_difference = 0) AS exact_equal_features, round(count(*) FILTER (signed_difference = 0) / count(*), 6) AS exact_equality_fraction FROM detail GROUP BY 1, 2", **_D)
def _(spark, sf):
    return N.exact_equality_audit(detail(spark, sf)).select("query", "comparator", "matched_features", "exact_equal_features", r("exact_equality_fraction"))


@register("unique_call_recurrence", f"SELECT q.feature_id, n - coalesce(k, 0) AS comparator_count FROM (SELECT DISTINCT feature_id FROM vector_calls WHERE profile = {QC} AND alpha > 0.0005) q CROSS JOIN (SELECT count(*) - 1 AS n FROM vector_roster) LEFT JOIN (SELECT feature_id, count(DISTINCT profile) AS k FROM vector_calls WHERE profile <> {QC} AND alpha > 0.0005 GROUP BY 1) o ON o.feature_id = q.feature_id")
def _(spark, sf):
    return N.unique_call_recurrence(B.vector_calls(spark, sf).where("alpha > 0.0005"), QC, B.vector_roster(spark, sf))


_TGT = "SELECT query, comparator, target, avg(query_value) AS qm, avg(comparator_value) AS cm, avg(signed_difference) AS md, avg(absolute_difference) AS mad FROM detail GROUP BY 1, 2, 3"


_VDETAIL = """SELECT 0 AS query, c.profile AS comparator, c.feature_id, c.target, c.tissue, q.value AS query_value, c.value AS comparator_value, q.value - c.value AS signed_difference, abs(q.value - c.value) AS absolute_difference
FROM vectors c JOIN vectors q ON c.feature_id = q.feature_id WHERE q.profile = 0 AND c.profile <> 0 AND q.value IS NOT NULL AND c.value IS NOT NULL"""


def _top_sql(order, k, source="tgt", tie="target"):
    return f"SELECT comparator, {tie}, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, comparator ORDER BY {order}, {tie}) AS rk FROM {source}) WHERE rk <= {k}"


@register("pair_top_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, comparator, {t} AS item, rank FROM ({_top_sql(o, k, s, t)})" for n, o, k, s, t in (
    ("shared", "least(abs(qm), abs(cm)) DESC", 20, "tgt", "target"), ("query_higher", "md DESC", 20, "tgt", "target"), ("comparator_higher", "md", 20, "tgt", "target"),
    ("residual", "mad DESC", 20, "tgt", "target"), ("tissues", "mad DESC", 20, "tis", "tissue"), ("coordinates", "absolute_difference DESC", 30, "detail", "feature_id"))),
    detail=_VDETAIL, tgt=_TGT, tis=_TGT.replace("target", "tissue"))
def _(spark, sf):
    tabs = N.pair_top_tables(P.pair_detail(B.vectors(spark, sf), 0, "value"))
    item = {"tissues": "tissue", "coordinates": "feature_id"}
    out = None
    for name, df in tabs.items():
        part = df.select(F.lit(name).alias("name"), "comparator", C(item.get(name, "target")).alias("item"), "rank")
        out = part if out is None else out.unionByName(part)
    return out


@register("top_positive_negative", " UNION ALL ".join(f"SELECT '{n}' AS tag, comparator, feature_id, rank FROM ({_top_sql(o, 25, 'detail', 'feature_id')})" for n, o in (("POSITIVE", "signed_difference DESC"), ("NEGATIVE", "signed_difference"), ("ABSOLUTE", "absolute_difference DESC"))), **_D)
def _(spark, sf):
    return N.top_positive_negative(detail(spark, sf)).select(C("table").alias("tag"), "comparator", "feature_id", "rank")


@register("top_shared_targets", "SELECT comparator, target, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, comparator ORDER BY n DESC, round(mad, 12), target) AS rk FROM (SELECT query, comparator, target, count(*) AS n, avg(absolute_difference) AS mad FROM detail GROUP BY 1, 2, 3)) WHERE rk <= 20", **_D)
def _(spark, sf):
    return N.top_shared_targets(detail(spark, sf)).select("comparator", "target", "rank")


@register("ranked_scores", "SELECT profile, feature_id, row_number() OVER (PARTITION BY profile ORDER BY abs(value) DESC, feature_order) AS abs_rank FROM vectors WHERE value IS NOT NULL")
def _(spark, sf):
    return N.ranked_scores(B.vectors(spark, sf), "value", "feature_order", ["profile"]).select("profile", "feature_id", "abs_rank")


# ---- classes

_MEM = "SELECT DISTINCT class_id, class_label, profile FROM vector_classes WHERE profile <> 0"
_RES = """SELECT m.class_id, m.class_label, m.feature_id, m.target, m.tissue, q.value AS query_value, med AS class_median, q.value - med AS diff FROM (
  SELECT class_id, class_label, feature_id, target, tissue, median(value) AS med FROM vectors JOIN mem USING (profile) WHERE value IS NOT NULL GROUP BY ALL) m JOIN vectors q ON q.feature_id = m.feature_id AND q.profile = 0 AND q.value IS NOT NULL"""
_CLS = dict(mem=_MEM, res=_RES)


@register("class_residuals", "SELECT class_id, class_label, feature_id, target, tissue, round(query_value, 6) AS query_value, round(class_median, 6) AS class_median, round(diff, 6) AS query_minus_class_median FROM res", **_CLS)
def _(spark, sf):
    c = L.class_residuals(B.vectors(spark, sf), B.vector_classes(spark, sf), 0, "value")
    return c.select("class_id", "class_label", "feature_id", "target", "tissue", r("query_value"), r("class_median"), r("query_minus_class_median"))


@register("class_summary", """SELECT l.class_id, l.class_label, n AS members, matched_features, round(mae, 6) AS mean_abs_residual, round(rms, 6) AS rms_residual, coalesce(u, 0) AS class_union_calls, qc AS query_calls, coalesce(s, 0) AS shared_calls,
  round(coalesce(mp, 0), 6) AS mean_prevalence, round(coalesce(mt, 0), 6) AS mean_prevalence_tested, coalesce(u, 0) + qc - coalesce(s, 0) AS fingerprint_union, round(CASE WHEN coalesce(u, 0) + qc - coalesce(s, 0) > 0 THEN coalesce(s, 0) / (coalesce(u, 0) + qc - coalesce(s, 0)) ELSE 1.0 END, 6) AS fingerprint_jaccard, 'PASS' AS status
FROM (SELECT class_id, class_label, count(*) AS n FROM mem GROUP BY 1, 2) l
JOIN (SELECT class_id, count(*) AS matched_features, avg(abs(diff)) AS mae, sqrt(avg(diff * diff)) AS rms FROM res GROUP BY 1) x ON l.class_id = x.class_id
LEFT JOIN (SELECT c.class_id, count(*) AS u, count(q.feature_id) AS s, avg(nc / sz) AS mp, avg(nc / nt) AS mt FROM
    (SELECT class_id, feature_id, count(*) AS nc FROM lc JOIN mem USING (profile) GROUP BY 1, 2) c
    JOIN (SELECT class_id, feature_id, count(*) AS nt FROM vectors JOIN mem USING (profile) WHERE value IS NOT NULL GROUP BY 1, 2) t ON c.class_id = t.class_id AND c.feature_id = t.feature_id
    JOIN (SELECT class_id, count(*) AS sz FROM mem GROUP BY 1) z ON z.class_id = c.class_id LEFT JOIN (SELECT feature_id FROM lc WHERE profile = 0) q ON q.feature_id = c.feature_id GROUP BY 1) o ON o.class_id = l.class_id
CROSS JOIN (SELECT count(*) AS qc FROM lc WHERE profile = 0)""", lc="SELECT DISTINCT profile, feature_id FROM vector_calls WHERE alpha > 0.0005", **_CLS)
def _(spark, sf):
    s = L.class_summary(B.vectors(spark, sf), B.vector_calls(spark, sf).where("alpha > 0.0005"), B.vector_classes(spark, sf), 0, "value")
    return s.select("class_id", "class_label", "members", "matched_features", r("mean_abs_residual"), r("rms_residual"), "class_union_calls", "query_calls", "shared_calls",
                    r("mean_prevalence"), r("mean_prevalence_tested"), "fingerprint_union", r("fingerprint_jaccard"), "status")


@register("class_differentials", " UNION ALL ".join(f"SELECT class_id, '{b}' AS axis, {b} AS item, count(*) AS matched_features, round(avg(diff), 6) AS mean_difference, round(avg(abs(diff)), 6) AS mean_absolute_difference, round(max(abs(diff)), 6) AS max_absolute_difference FROM res GROUP BY 1, 3" for b in ("target", "tissue")), **_CLS)
def _(spark, sf):
    res = L.class_residuals(B.vectors(spark, sf), B.vector_classes(spark, sf), 0, "value")
    parts = [L.class_differentials(res, b).select("class_id", F.lit(b).alias("axis"), C(b).alias("item"), "matched_features", r("mean_difference"), r("mean_absolute_difference"), r("max_absolute_difference")) for b in ("target", "tissue")]
    return parts[0].unionByName(parts[1])


@register("class_distance", "SELECT class_id, class_label, round(avg(rms), 6) AS mean_distance, round(median(rms), 6) AS median_distance, round(min(rms), 6) AS minimum_distance, count(DISTINCT comparator) AS member_count FROM orient JOIN vector_classes c ON c.profile = comparator GROUP BY 1, 2", **PAIR_VIEWS, orient=_ORIENT)
def _(spark, sf):
    d = L.class_distance(P.query_pairs(B.vectors(spark, sf), 0, "value"), B.vector_classes(spark, sf), 0)
    return d.select("class_id", "class_label", r("mean_distance"), r("median_distance"), r("minimum_distance"), "member_count")


@register("method_availability", "SELECT activity_type AS method, " + ", ".join(f"count(*) FILTER (lane = '{s}') AS {s}" for s in ("MEASURED_NUMERICAL", "MEASURED_NONNUMERICAL", "MODELED_OR_IMPUTED")) + ", count(*) FILTER (coalesce(lane, '') NOT IN ('MEASURED_NUMERICAL', 'MEASURED_NONNUMERICAL', 'MODELED_OR_IMPUTED')) AS OTHER FROM cleaned GROUP BY 1")
def _(spark, sf):
    st = B.cleaned(spark, sf).select(C("activity_type").alias("method"), C("lane").alias("status"))
    return L.method_availability(st, ["MEASURED_NUMERICAL", "MEASURED_NONNUMERICAL", "MODELED_OR_IMPUTED"])


# ---- common scale

_KNOTS = """SELECT knot, mass, sum(mass) OVER (ORDER BY knot) - mass AS before, sum(mass) OVER () AS total FROM (
  SELECT round(o_totalprice / 1000) AS knot, sum(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) AS mass FROM orders GROUP BY 1)"""


def knots(spark, sf):
    o = B.table(spark, sf, "orders").select(F.round(C("o_totalprice") / 1000).alias("v"), F.substring("o_orderpriority", 1, 1).cast("double").alias("w"))
    return E.fit_knots(o, "v", "w")


@register("fit_knots", "SELECT knot, mass, before, total FROM knots", knots=_KNOTS)
def _(spark, sf):
    return knots(spark, sf)


_ASOF = """SELECT q.*, CASE WHEN k.knot IS NULL THEN 0.0 WHEN k.knot = q.v THEN (before + mass / 2) / total ELSE (before + mass) / total END AS p
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN floor(l_extendedprice / 300) ELSE l_extendedprice / 250 - 5 END AS v FROM lineitem) q ASOF LEFT JOIN knots k ON q.v >= k.knot"""


@register("weighted_ecdf_asof", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p, 6) AS p FROM placed", knots=_KNOTS, placed=_ASOF)
def _(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(C("l_linenumber") % 2 == 0, F.floor(C("l_extendedprice") / 300).cast("double")).otherwise(C("l_extendedprice") / 250 - 5).alias("v"))
    return E.weighted_ecdf_asof(li, knots(spark, sf), "v", "p").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("p"))


_MAPK = "SELECT knot, mass, sum(mass) OVER (ORDER BY knot) - mass AS before, sum(mass) OVER () AS total FROM (SELECT round(raw / 10) AS knot, count(*)::DOUBLE AS mass FROM expression GROUP BY 1)"
MAPPED = f"""SELECT target, tissue, raw, feature_id_common, ok, CASE WHEN ok THEN {ppf_sql('pp')} END AS common_value FROM (
  SELECT x.*, c.feature_id AS feature_id_common, c.feature_id IS NOT NULL AS ok, CASE WHEN k.knot IS NULL THEN 0.0 WHEN k.knot = x.v THEN (before + mass / 2) / total ELSE (before + mass) / total END AS pp
  FROM (SELECT *, raw / 11 AS v FROM expression) x LEFT JOIN (SELECT * FROM contract WHERE target NOT LIKE '%PROMO') c ON x.target = c.target AND x.tissue = c.tissue ASOF LEFT JOIN mapk k ON x.v >= k.knot)"""


def mapped(spark, sf):
    e = cut(B.expression(spark, sf).select("target", "tissue", "raw"))
    con = B.contract(spark, sf).where(~C("target").endswith("PROMO"))
    k = E.fit_knots(e.select(F.round(C("raw") / 10).alias("v"), F.lit(1.0).alias("w")), "v", "w")
    rows = e.select("target", "tissue", "raw", (C("raw") / 11).alias("v"))
    return E.contract_map(rows, con, "target", "tissue", "v", k)


@register("contract_map", "SELECT target, tissue, raw, feature_id_common, ok AS common_scale_compatible, round(common_value, 6) AS common_value FROM mapped", mapk=_MAPK, mapped=MAPPED)
def _(spark, sf):
    return mapped(spark, sf).select("target", "tissue", "raw", "feature_id_common", "common_scale_compatible", r("common_value"))
