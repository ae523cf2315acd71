"""Checks. Each returns rows (check_id, status, observed, expected) or rows of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V


def _checks(one_row: DataFrame, items: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """One aggregate row unfolded to check rows: (id, passed, observed, expected)."""
    parts = [
        F.struct(F.lit(i).alias("check_id"), F.when(ok, "PASS").otherwise("FAIL").alias("status"),
                 F.coalesce(obs.cast("string"), F.lit("")).alias("observed"), exp.cast("string").alias("expected"))
        for i, ok, obs, exp in items
    ]
    return one_row.select(F.explode(F.array(*parts)).alias("_c")).select("_c.*")


def panel_contract(df: DataFrame, targets: int, tissues: int, target: str, tissue: str, value: str) -> DataFrame:
    x = F.col(value)
    bad = F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))
    per = df.groupBy(target, tissue).agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    row = per.agg(F.countDistinct(target).alias("t"), F.countDistinct(tissue).alias("u"), F.sum("_n").alias("n"),
                  F.count_if(F.col("_n") > 1).alias("d"), F.sum("_bad").alias("b"))
    c = F.col
    return _checks(row, [
        ("TARGET_COUNT", c("t") == targets, c("t"), F.lit(targets)), ("TISSUE_COUNT", c("u") == tissues, c("u"), F.lit(tissues)),
        ("UNIQUE_COORDINATES", c("d") == 0, c("d"), F.lit(0)), ("ROW_COUNT", c("n") == targets * tissues, c("n"), F.lit(targets * tissues)),
        ("FINITE_VALUES", c("b") == 0, c("b"), F.lit(0)),
    ])


def pairwise_contract(pairs: DataFrame, expected: int) -> DataFrame:
    """Count, self pairs, repeated unordered keys, and the range of every metric present."""
    signed = [m for m in ("cosine", "pearson", "spearman") if m in pairs.columns]
    unit = [m for m in pairs.columns if "jaccard" in m or "overlap_coefficient" in m]
    key = pairs.groupBy(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"))
    per = key.agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("a") == F.col("b")).alias("_self"),
        *[F.count_if((F.col(m) < -1.0000001) | (F.col(m) > 1.0000001)).alias(f"_{m}") for m in signed],
        *[F.count_if((F.col(m) < -1e-12) | (F.col(m) > 1 + 1e-12)).alias(f"_{m}") for m in unit])
    row = per.agg(F.sum("_n").alias("n"), F.sum("_self").alias("self"), F.sum(F.col("_n") - 1).alias("dup"), *[F.sum(f"_{m}").alias(f"_{m}") for m in signed + unit])
    return contract_checks(row, expected, signed + unit)


def contract_checks(row: DataFrame, expected: int, metrics: list[str]) -> DataFrame:
    """The checks of ``pairwise_contract`` from one row of counts."""
    zero, c = F.lit(0), F.col
    return _checks(row, [("PAIR_COUNT", c("n") == expected, c("n"), F.lit(expected)), ("NO_SELF_PAIRS", c("self") == 0, c("self"), zero),
                         ("UNORDERED_KEYS_UNIQUE", c("dup") == 0, c("dup"), zero)]
                   + [(f"{m.upper()}_BOUNDS", c(f"_{m}") == 0, c(f"_{m}"), zero) for m in metrics])


def metric_arithmetic(pairs: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Shared never above union, and each Jaccard equal to shared / union (an empty union counts as 1)."""
    triples = [("SUPPORT", "support_shared", "support_union", "support_jaccard")]
    triples += [(p.upper() + "CALL", f"{p}shared_calls", f"{p}union_calls", f"{p}call_jaccard") for p in ("", "alpha001_", "alpha0001_")]
    triples = [t for t in triples if t[1] in pairs.columns]
    aggs = []
    for name, s, u, j in triples:
        expect = F.when(F.col(u) > 0, F.col(s) / F.when(F.col(u) > 0, F.col(u))).otherwise(1.0)
        aggs += [F.count_if(F.col(s) > F.col(u)).alias(f"{name}_le"), F.count_if(F.abs(expect - F.col(j)) > tol).alias(f"{name}_eq")]
    return arithmetic_checks(pairs.agg(*aggs), [name for name, *_ in triples])


def arithmetic_checks(row: DataFrame, names: list[str]) -> DataFrame:
    """The checks of ``metric_arithmetic`` from one row of counts."""
    zero = F.lit(0)
    return _checks(row, [x for name in names for x in (
        (f"{name}_INTERSECTION_LE_UNION", F.col(f"{name}_le") == 0, F.col(f"{name}_le"), zero),
        (f"{name}_JACCARD_ARITHMETIC", F.col(f"{name}_eq") == 0, F.col(f"{name}_eq"), zero))])


def matrix_symmetry(m: DataFrame, diagonal: float | None, atol: float = 1e-12) -> DataFrame:
    """Largest asymmetry and diagonal error of a long matrix (a, b, value): both cells of a pair meet under one key."""
    per = m.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        (F.max("value") - F.min("value")).alias("gap"), F.max(F.when(F.col("a") == F.col("b"), F.abs(F.col("value") - F.lit(diagonal)))).alias("dg"))
    row = per.agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"), F.coalesce(F.max("dg"), F.lit(0.0)).alias("dg"))
    over = lambda c: F.when(F.col(c) <= atol, 0).otherwise(1)
    return _checks(row, [("SYMMETRY", F.col("gap") <= atol, over("gap"), F.lit(0)), ("DIAGONAL", F.col("dg") <= atol, over("dg"), F.lit(0))])


def frame_regression(observed: DataFrame, reference: DataFrame, keys: list[str], tol: float = 1e-10) -> DataFrame:
    """Column by column: rows on one side only, NULL mask differences, text differences, largest numeric difference."""
    shared = [c for c in observed.columns if c in reference.columns and c not in keys]
    types = dict(observed.dtypes)
    x = observed.select(*keys, *[F.col(c).alias(f"o_{c}") for c in shared], F.lit(1).alias("_o"))
    y = reference.select(*keys, *[F.col(c).alias(f"r_{c}") for c in shared], F.lit(1).alias("_r"))
    j = x.join(y, keys, "full_outer")
    both = F.col("_o").isNotNull() & F.col("_r").isNotNull()
    parts = []
    for c in shared:
        o, r = F.col(f"o_{c}"), F.col(f"r_{c}")
        numeric = types[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")
        delta = F.abs(o.cast("double") - r.cast("double")) if numeric else F.lit(None).cast("double")
        text = F.lit(False) if numeric else (o.isNotNull() & r.isNotNull() & (o.cast("string") != r.cast("string")))
        parts.append(F.struct(F.lit(c).alias("column"), (both & (o.isNull() != r.isNull())).alias("mask"), (both & text).alias("txt"), F.when(both, delta).alias("delta")))
    rows = j.select(both.alias("both"), F.explode(F.array(*parts)).alias("p"))
    return rows.groupBy("p.column").agg(
        F.count_if(~F.col("both")).alias("unmatched_rows"), F.count_if("p.mask").alias("null_mismatches"), F.count_if("p.txt").alias("text_mismatches"),
        F.max("p.delta").alias("max_delta"),
    ).withColumn("status", F.when((F.col("unmatched_rows") == 0) & (F.col("null_mismatches") == 0) & (F.col("text_mismatches") == 0)
                                  & (F.coalesce("max_delta", F.lit(0.0)) <= tol), "PASS").otherwise("FAIL"))


def call_semantics(states: DataFrame, calls: list[str]) -> DataFrame:
    """Finite cells only 0 / 1, and unsupported cells still NULL."""
    row = states.agg(*[a for c in calls for a in (F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)).alias(f"bad_{c}"), F.count_if(F.col(c).isNull()).alias(f"na_{c}"))])
    return _checks(row, [x for c in calls for x in (
        (f"{c.upper()}_VALUES", F.col(f"bad_{c}") == 0, F.col(f"bad_{c}"), F.lit(0)),
        (f"{c.upper()}_UNTESTED_KEPT", F.col(f"na_{c}") > 0, F.col(f"na_{c}"), F.lit(">0")))])


def record_bundle_contract(records: DataFrame, profiles: DataFrame, targets: DataFrame, tissues: DataFrame, datasets: list[str], alphas: list[float],
                           artifacts: DataFrame, positive_only: bool = False) -> DataFrame:
    """Every rule violation of every exchange record: (record_no, violation).

    Registries are small tables (``id``, profiles also ``source_id``); ``artifacts`` has ``path`` and ``record_count``.
    """
    def known(df, flag):
        return df.select(F.col("id").alias(f"_{flag}"), *([F.col("source_id").alias("_source")] if flag == "p" else []))

    key = ["profile_id", "target_id", "tissue_id", "expression_dataset_id", "gesd_alpha"]
    firsts = records.groupBy(*key).agg(F.min("record_no").alias("_first"))
    j = (
        records.join(known(profiles, "p"), F.col("profile_id") == F.col("_p"), "left")
        .join(known(targets, "t"), F.col("target_id") == F.col("_t"), "left")
        .join(known(tissues, "u"), F.col("tissue_id") == F.col("_u"), "left")
        .join(artifacts.select(F.col("path").alias("_path"), F.col("record_count").alias("_rows")), F.col("source_artifact") == F.col("_path"), "left")
        .join(firsts, key, "left")
    )
    hr, member, status = F.col("hr_score"), F.col("fingerprint_member"), F.col("support_status")
    finite = hr.isNull() | ~(F.isnan(hr) | (F.abs(hr) == float("inf")))
    rules = [
        ("UNKNOWN_PROFILE", F.col("_p").isNull()), ("UNKNOWN_TARGET", F.col("_t").isNull()), ("UNKNOWN_TISSUE", F.col("_u").isNull()),
        ("SOURCE_PROFILE_MISMATCH", F.col("_p").isNotNull() & ~F.col("source_profile_id").eqNullSafe(F.col("_source"))),
        ("OUT_OF_SCOPE", ~F.col("expression_dataset_id").isin(datasets) | ~F.col("gesd_alpha").isin(alphas)),
        ("UNDECLARED_SOURCE_ROW", F.col("_path").isNull() | (F.col("source_row") > F.col("_rows"))),
        ("DUPLICATE_COORDINATE", F.col("record_no") > F.col("_first")), ("NONFINITE_SCORE", ~finite),
        ("SUPPORTED_WITHOUT_VALUES", (status == "supported") & (hr.isNull() | member.isNull())),
        ("UNSUPPORTED_WITH_VALUES", (status == "unsupported") & (hr.isNotNull() | member.isNotNull())),
        ("UNTESTED_WITH_MEMBERSHIP", (status == "untested") & member.isNotNull()),
        ("NOT_A_POSITIVE_CALL", F.lit(positive_only) & ((status != "supported") | ~F.coalesce(member, F.lit(False)))),
    ]
    found = F.explode(F.filter(F.array(*[F.when(cond, name) for name, cond in rules]), lambda x: x.isNotNull()))
    return j.select("record_no", found.alias("violation"))


def registry_unique(registry: DataFrame) -> DataFrame:
    """Ids or source ids used more than once."""
    parts = [registry.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(v).alias("violation"), F.col("value").cast("string"), "n")
             for c, v in (("id", "DUPLICATE_ID"), ("source_id", "MANY_TO_ONE_SOURCE"))]
    return parts[0].unionByName(parts[1])


def availability_audit(roster: DataFrame, profiles: DataFrame, raw: str, common: str, called: DataFrame) -> DataFrame:
    """Per identity: cells, targets, READY / PARTIAL / STATUS_ONLY and what it is eligible for."""
    per = profiles.groupBy("profile").agg(F.count(raw).alias("raw_features"), F.count(common).alias("supported_features"),
                                          F.countDistinct(F.when(F.col(common).isNotNull(), F.col("target"))).alias("supported_targets"))
    flag = called.select("profile").distinct().withColumn("_c", F.lit(True))
    j = roster.select("profile").join(per, "profile", "left").join(flag, "profile", "left").na.fill(0, ["raw_features", "supported_features", "supported_targets"])
    numeric = (F.col("raw_features") > 0) & (F.col("supported_features") > 0)
    partial = numeric & ((F.col("supported_features") < V.GATE_FEATURES) | (F.col("supported_targets") < V.GATE_TARGETS))
    return j.select("profile", "raw_features", "supported_features", "supported_targets",
                    F.when(partial, "NUMERICAL_PARTIAL").when(numeric, "NUMERICAL_READY").otherwise("STATUS_ONLY").alias("numerical_status"),
                    numeric.alias("eligible_continuous"), (numeric & F.col("_c").isNotNull()).alias("eligible_fingerprint"),
                    F.when(partial | ~numeric, "PASS_WITH_LIMITATION").otherwise("PASS").alias("qa_status"))


def common_scale_audit(mapped: DataFrame, target: str) -> DataFrame:
    ok = F.col("common_scale_compatible")
    row = mapped.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("out"), F.count_if(~ok & F.col("common_value").isNotNull()).alias("filled"),
                     F.countDistinct(F.when(~ok, F.col(target))).alias("targets_out"))
    c = F.col
    return _checks(row, [("ROWS_ACCOUNTED", c("kept") + c("out") == c("n"), c("kept") + c("out"), c("n")), ("EXCLUDED_NOT_FILLED", c("filled") == 0, c("filled"), F.lit(0)),
                         ("COMPATIBLE_ROWS", c("kept") > 0, c("kept"), F.lit(">0")), ("EXCLUDED_TARGETS", F.lit(True), c("targets_out"), F.lit("reported"))])


def component_audit(status: DataFrame) -> DataFrame:
    allowed = ["PASS", "PASS_WITH_LIMITATION", "NOT_ESTIMABLE"]
    ok = F.coalesce(F.col("component_count") <= F.col("rank"), F.lit(True)) & F.col("status").isin(allowed)
    return status.select("analysis_id", "method", "component_count", "rank", F.when(ok, "PASS").otherwise("FAIL").alias("audit_status"))


def overall_status(checks: DataFrame) -> DataFrame:
    bad, soft = F.count_if(F.col("status") == "FAIL"), F.count_if(F.col("status") == "PASS_WITH_LIMITATION")
    return checks.agg(F.count(F.lit(1)).alias("checks"), bad.alias("failed"),
                      F.when(bad > 0, "FAIL").when(soft > 0, "PASS_WITH_DOCUMENTED_LIMITATIONS").otherwise("PASS").alias("overall"))


def call_count_regression(pairs: DataFrame, calls: DataFrame, count_a: str = "call_count_a", count_b: str = "call_count_b") -> DataFrame:
    """Call counts read from both sides of the pair table against the call table."""
    both = F.array(*[F.struct(F.col(p).alias("profile"), F.col(n).alias("n")) for p, n in (("a", count_a), ("b", count_b))])
    sides = pairs.select(F.explode(both).alias("_s")).select("_s.*")  # the pairs are made once, not once a side
    return ends_against_calls(sides.groupBy("profile").agg(F.min("n").alias("pair_min"), F.max("n").alias("pair_max")), calls)


def ends_against_calls(per: DataFrame, calls: DataFrame) -> DataFrame:
    """The smallest and largest count that its pairs give a profile against the call table."""
    own = calls.groupBy("profile").agg(F.count(F.lit(1)).alias("called"))
    j = per.join(own, "profile", "full_outer")
    ok = (F.col("pair_min") == F.col("pair_max")) & (F.col("pair_min") == F.coalesce("called", F.lit(0)))
    return j.select("profile", "pair_min", "pair_max", F.coalesce("called", F.lit(0)).alias("called"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def coverage_expectation(coverage: DataFrame, expected: DataFrame) -> DataFrame:
    """Supported targets and features against declared numbers; a profile without a declaration passes."""
    j = coverage.join(expected.select("profile", "expected_features", "expected_targets"), "profile", "left")
    ok = F.coalesce(F.col("supported_features") == F.col("expected_features"), F.lit(True)) & F.coalesce(F.col("supported_targets") == F.col("expected_targets"), F.lit(True))
    return j.select("profile", "supported_features", "supported_targets", "expected_features", "expected_targets", F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def union_checks(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
