"""Registered queries for scores, selection and outlier calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bindings as B
from .register import register

R = lambda c, d=6: F.round(c, d)


@register("zscore_within", "SELECT target, tissue, raw, round(z, 6) AS z FROM expression_z")
def _(spark, sf):
    return B.expression_z(spark, sf).select("target", "tissue", "raw", R("z").alias("z"))


@register("select_activity", "SELECT profile, target, species_basis, selection_kind, bound_selection_rule, assertion_id, relation_class, "
          "round(pactivity, 6) AS pactivity FROM selection")
def _(spark, sf):
    return B.selection(spark, sf).select("profile", "target", "species_basis", "selection_kind", "bound_selection_rule",
                                         "assertion_id", "relation_class", R("pactivity").alias("pactivity"))


@register("score_join", "SELECT profile, feature_id, round(score, 6) AS score FROM profiles")
def _(spark, sf):
    return B.profiles(spark, sf).select("profile", "feature_id", R("score").alias("score"))


@register("gesd_steps", "SELECT profile, feature_id, CAST(step AS BIGINT) AS step, n, round(r_stat, 6) AS r_stat FROM profile_steps")
def _(spark, sf):
    s = B.profile_steps(spark, sf)
    return s.select("profile", "feature_id", "step", "n", R("r_stat").alias("r_stat"))


_calls_sql = "SELECT profile, feature_id, alpha, CAST(step AS BIGINT) AS call_rank, round(r_stat, 6) AS r_stat, round(critical_lambda, 6) AS critical_lambda FROM "


@register("gesd_calls", _calls_sql + "profile_calls")
def _(spark, sf):
    c = B.profile_calls(spark, sf)
    return c.select("profile", "feature_id", "alpha", "call_rank", R("r_stat").alias("r_stat"), R("critical_lambda").alias("critical_lambda"))


@register("gesd_calls_vectors", _calls_sql + "vector_calls")
def _(spark, sf):
    return B.vector_calls(spark, sf).select("profile", "feature_id", "alpha", "call_rank", R("r_stat").alias("r_stat"), R("critical_lambda").alias("critical_lambda"))
