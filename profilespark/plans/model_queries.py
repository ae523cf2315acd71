"""Low-rank models, ordinations and trees. Most are iterative, so they are checked against NumPy in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import pairs as P
from ..operators import quality as G
from ..session import cut
from . import bindings as B
from .pair_queries import PAIR_VIEWS, states, vector_metrics
from .register import r, register

C = F.col


def score_roster(p):
    return p.select("profile").distinct().withColumn("roster_order", C("profile"))


def score_distances(spark, sf):
    """Full symmetric distances of the score profiles."""
    p, cells = B.written_profiles(spark, sf)
    roster = score_roster(p)
    pairs = P.continuous_metrics(p, roster, "score", n_features=cells, metrics=("rms",))
    return P.metric_matrix(pairs, "rms", roster)


def vector_distances(spark, sf):
    return P.metric_matrix(vector_metrics(spark, sf, "rms"), "rms", B.vector_roster(spark, sf))


@register("complete_case_pca")
def _(spark, sf):
    return M.complete_case_pca(B.profiles(spark, sf), "score").scores


@register("em_svd_pca")
def _(spark, sf):
    return M.em_svd_pca(B.vectors(spark, sf), "value").scores


@register("model_status")
def _(spark, sf):
    return M.em_svd_pca(B.vectors(spark, sf), "value").status


_LD = "SELECT feature_id, avg(value) AS mu, avg(CASE WHEN label < 5 THEN value END) AS l1, avg(CASE WHEN label >= 5 THEN value END) AS l2 FROM vectors GROUP BY 1"


@register("project_rows", """SELECT profile, n AS observed_features, CASE WHEN n < 3 THEN 'NOT_ESTIMABLE_INSUFFICIENT_OBSERVED_FEATURES' ELSE 'ESTIMATED' END AS status,
  round((s22 * b1 - s12 * b2) / (s11 * s22 - s12 * s12), 5) AS PC1, round((s11 * b2 - s12 * b1) / (s11 * s22 - s12 * s12), 5) AS PC2,
  round(sqrt((cc - b1 * (s22 * b1 - s12 * b2) / (s11 * s22 - s12 * s12) - b2 * (s11 * b2 - s12 * b1) / (s11 * s22 - s12 * s12)) / n), 5) AS projection_rmse
FROM (SELECT profile, count(*) AS n, sum(l1 * l1) AS s11, sum(l1 * l2) AS s12, sum(l2 * l2) AS s22, sum(l1 * (value - mu)) AS b1, sum(l2 * (value - mu)) AS b2, sum((value - mu) * (value - mu)) AS cc FROM vectors JOIN ld USING (feature_id) WHERE value IS NOT NULL GROUP BY 1)""", ld=_LD)
def _(spark, sf):
    v = B.vectors(spark, sf)
    ld = v.groupBy("feature_id").agg(F.avg("value").alias("mean"), F.avg(F.when(C("label") < 5, C("value"))).alias("PC1_loading"), F.avg(F.when(C("label") >= 5, C("value"))).alias("PC2_loading"))
    return M.project_rows(v, ld, "value").select("profile", "observed_features", "status", r("PC1", 5), r("PC2", 5), r("projection_rmse", 5))


@register("fixed_reference_pca")
def _(spark, sf):
    e = B.table(spark, sf, "embeddings")
    ref, ask = e.where("label < 7").select(C("vec_id").alias("profile")), e.where("label >= 7").select(C("vec_id").alias("profile"))
    return M.fixed_reference_pca(B.vectors(spark, sf), "value", ref, ask).scores


@register("sparse_call_pca")
def _(spark, sf):
    return M.sparse_call_pca(states(spark, sf), 0.001).scores


@register("target_level_pca")
def _(spark, sf):
    return M.target_level_pca(B.vectors(spark, sf), "value", complete=True).scores


@register("complete_distance_subset")
def _(spark, sf):
    p, cells = B.written_profiles(spark, sf)
    pairs = P.continuous_metrics(p, score_roster(p), "score", n_features=cells, metrics=("rms", "pearson"))
    thin = pairs.withColumn("rms", F.when(C("pearson") > 0.97, C("rms")))
    cover = p.groupBy("profile").agg(F.count("score").alias("coverage"))
    kept, out = M.complete_distance_subset(thin, cover, "rms")
    return kept.select("profile", F.lit(0).cast("long").alias("exclusion_order")).unionByName(out.select("profile", "exclusion_order"))


_MAT = "SELECT a, b, rms AS value FROM metrics UNION ALL SELECT b, a, rms FROM metrics UNION ALL SELECT profile, profile, 0.0::DOUBLE FROM vector_roster"


@register("double_center", "SELECT a, b, round(-(q - ra - rb + g) / 2, 6) AS value FROM (SELECT a, b, value * value AS q, avg(value * value) OVER (PARTITION BY a) AS ra, avg(value * value) OVER (PARTITION BY b) AS rb, avg(value * value) OVER () AS g FROM mat)", mat=_MAT, **PAIR_VIEWS)
def _(spark, sf):
    return M.double_center(vector_distances(spark, sf)).select("a", "b", r("value"))


@register("pcoa")
def _(spark, sf):
    return M.pcoa(vector_distances(spark, sf)).scores


@register("metric_mds")
def _(spark, sf):
    return M.metric_mds(score_distances(spark, sf), 20260813).status


@register("metric_mds_check")
def _(spark, sf):
    d = cut(score_distances(spark, sf))
    return M.metric_mds_check(d, M.metric_mds(d, 20260813)).select("analysis_id", "status", "sample_count", "cells", "stress", "stress_again", "stress_agrees")


@register("average_linkage_by_group")
def _(spark, sf):
    d = vector_metrics(spark, sf, "rms").select("a", "b", C("rms").alias("value"))
    cl = B.vector_classes(spark, sf).select("class_id", "profile")
    inner = d.join(cl.select("class_id", C("profile").alias("a")), "a").join(cl.select("class_id", C("profile").alias("b")), ["class_id", "b"])
    return M.average_linkage_by_group(inner, "class_id")


@register("class_models")
def _(spark, sf):
    out = M.class_models(B.vectors(spark, sf), states(spark, sf), vector_distances(spark, sf), B.vector_classes(spark, sf), "value", 0.001)
    return out["status"]


@register("component_audit")
def _(spark, sf):
    st = M.em_svd_pca(B.vectors(spark, sf).withColumn("grp_label", C("label").cast("string")), "value", group="grp_label").status
    return G.component_audit(st)
