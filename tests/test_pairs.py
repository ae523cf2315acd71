import numpy as np
from pyspark.sql import functions as F

from profilespark.operators import grid as G
from profilespark.operators import nearest as N
from profilespark.operators import outliers as O
from profilespark.operators import pairs as P
from profilespark.plans import bindings as B


def small(spark):
    rows = [("A", "f1", 1, "t1", 1.0), ("A", "f2", 2, "t1", 2.0), ("A", "f3", 3, "t2", 3.0), ("B", "f1", 1, "t1", 2.0), ("B", "f2", 2, "t1", 3.0), ("B", "f3", 3, "t2", 4.0),
            ("C", "f1", 1, "t1", 5.0), ("C", "f2", 2, "t1", None), ("D", "f9", 9, "t9", 1.0)]
    df = spark.createDataFrame(rows, "profile string, feature_id string, feature_order long, target string, value double").withColumn("tissue", F.lit("u"))
    return df, df.select("profile").distinct().withColumn("roster_order", F.col("profile"))


def test_small_pairs(spark):
    df, roster = small(spark)
    m = {(r.a, r.b): r for r in P.continuous_metrics(df, roster, "value").collect()}
    assert len(m) == 6
    ab = m["A", "B"]
    assert (ab.matched_features, ab.matched_targets, ab.rms, ab.median_abs_difference, ab.pearson) == (3, 2, 1.0, 1.0, 1.0) and not ab.overlap_gate_pass
    assert m["A", "D"].matched_features == 0 and m["A", "D"].rms is None and m["A", "D"].support_jaccard == 0.0
    assert m["A", "C"].pearson is None and m["A", "C"].matched_features == 1


def as_dict(df, cols):
    return {(r.a, r.b): [r[c] for c in cols] for r in df.collect()}


def same(x, y):
    assert x.keys() == y.keys()
    for k in x:
        for p, q in zip(x[k], y[k]):
            assert (p is None) == (q is None) and (p is None or p == q or abs(p - q) < 1e-9), (k, p, q)


def test_block_kernel_equals_joined_rows(spark, sf):
    v = B.vectors(spark, sf).where("profile < 90")
    roster = B.vector_roster(spark, sf).where("profile < 90")
    cols = [c for c in P.continuous_metrics(v, roster, "value").columns if c not in ("a", "b")]
    one = as_dict(P.continuous_metrics(v, roster, "value", blocks=1), cols)
    same(one, as_dict(P.continuous_metrics(v, roster, "value", blocks=5), cols))
    same(one, as_dict(P.metrics_from_rows(v, roster, "value", blocks=3), cols))


def test_an_unsupported_profile_changes_no_other_pair(spark):
    df, roster = small(spark)
    more = roster.unionByName(spark.createDataFrame([("Z", "Z")], "profile string, roster_order string"))
    cols = ["matched_features", "rms", "cosine"]
    before, after = as_dict(P.continuous_metrics(df, roster, "value"), cols), as_dict(P.continuous_metrics(df, more, "value"), cols)
    same(before, {k: v for k, v in after.items() if "Z" not in k})
    assert all(v[0] == 0 for k, v in after.items() if "Z" in k)


def test_nesting_and_partition_invariance(spark, sf):
    v = B.vectors(spark, sf)
    a = {(r.profile, r.feature_id, r.alpha) for r in O.gesd_calls(v, "profile", "value", "feature_order").collect()}
    b = {(r.profile, r.feature_id, r.alpha) for r in O.gesd_calls(v.repartition(13), "profile", "value", "feature_order").collect()}
    assert a == b and {x[:2] for x in a if x[2] < 0.0005} <= {x[:2] for x in a if x[2] > 0.0005}


def test_equal_means_rank_by_name(spark):
    """Both targets have the mean 0.2; summed in these orders, that of the smaller name is larger in the last bit."""
    rows = [("q", "c", t, d) for t, ds in (("ta", (0.1, 0.2, 0.3)), ("tb", (0.3, 0.2, 0.1))) for d in ds]
    detail = spark.createDataFrame(rows, "query string, comparator string, target string, absolute_difference double").coalesce(1)
    assert [(r.target, r["rank"]) for r in N.top_shared_targets(detail).orderBy("rank").collect()] == [("ta", 1), ("tb", 2)]


def test_copies_do_not_grow_with_the_roster(spark):
    """A profile is sent to as many pairs of blocks as there are blocks; it was one for every 128 profiles."""
    assert G.block_count(spark.range(100)) == 1
    assert [G.block_count(spark.range(n)) for n in (10_000, 100_000)] == [G.BLOCKS, G.BLOCKS]
    x, y = G.grid_sides(spark.range(1000).select(F.col("id").alias("profile")), 10)
    assert x.count() + y.count() == 11 * 1000


def uneven(spark, n=60):
    """Every profile supports other cells, some none."""
    rng = np.random.default_rng(3)
    rows = [(p, f"f{j}", j, f"t{j % 3}", "u", float(rng.integers(-3, 4))) for p in range(n) for j in range(12) if p % 10 and rng.random() < 0.6]
    df = spark.createDataFrame(rows, "profile long, feature_id string, feature_order long, target string, tissue string, value double")
    return df, spark.range(n).select(F.col("id").alias("profile"), (-F.col("id")).alias("roster_order"))


def test_sums_of_pairs_equal_their_joined_rows(spark, sf):
    v, roster = B.vectors(spark, sf).where("profile < 70"), B.vector_roster(spark, sf).where("profile < 70")
    for df, names, blocks in ((v, roster, 1), (v, roster, 3), (*uneven(spark), 4)):
        detail = P.matched_support_join(df, names, "value", blocks).cache()
        want = detail.groupBy("a", "b").agg(F.count("*").alias("matched_features"), F.min("feature_id").alias("lo"), F.max("feature_id").alias("hi"),
                                            F.sum("signed_difference").alias("signed_sum"), F.sum("absolute_difference").alias("absolute_sum"))
        got = P.pair_sums(df, names, "value", blocks=blocks)
        texts = lambda d: {(r.a, r.b): (r.lo, r.hi) for r in d.collect()}
        assert texts(got) == texts(want)
        same(as_dict(got, ["matched_features", "signed_sum", "absolute_sum"]), as_dict(want, ["matched_features", "signed_sum", "absolute_sum"]))
        cols = ["matched_features", "query_mean", "comparator_mean", "mean_difference", "mean_absolute_difference", "max_absolute_difference"]
        by = lambda d: {(r.a, r.b, r.target): [r[c] for c in cols] for r in d.collect()}
        same(by(P.pair_sums(df, names, "value", "target", blocks=blocks)), by(N.pair_group_summary(detail, "target")))


def test_changed_profiles_are_in_every_pair(spark):
    df, roster = uneven(spark)
    changed = roster.where("profile % 7 = 0")
    cols = [c for c in P.continuous_metrics(df, roster, "value").columns if c not in ("a", "b")]
    every = as_dict(P.metrics_from_rows(df, roster, "value", blocks=2), cols)
    same(every, as_dict(P.continuous_metrics(df, roster, "value", blocks=3), cols))
    for blocks in (1, 3):
        same({k: v for k, v in every.items() if k[0] % 7 == 0 or k[1] % 7 == 0}, as_dict(P.continuous_metrics(df, roster, "value", blocks=blocks, changed=changed), cols))


def test_layers_compared_in_blocks_equal_their_joined_rows(spark, monkeypatch):
    df, roster = uneven(spark)
    layers = df.select("profile", "feature_id", "value", F.lit("RAW").alias("layer")).unionByName(df.where("profile % 3 > 0").select("profile", "feature_id", F.signum("value").alias("value"), F.lit("SIGN").alias("layer")))
    cols = ["matched", "exact_equal", "near_equal", "max_abs", "mean_abs", "same_support", "identical", "identical_in_any_layer", "identical_in_every_layer"]
    by = lambda d: {(r.layer, r.a, r.b): [r[c] for c in cols] for r in d.collect()}
    block = by(P.vector_equality_forensics(layers, roster))
    monkeypatch.setattr(P, "CHUNK_FEATURES", 0)
    same(block, by(P.vector_equality_forensics(layers, roster)))


def test_call_sets_compared_in_blocks_equal_their_joined_sets(spark, monkeypatch):
    """Both levels, pairs without calls, and the plans: no pair meets another table by its names."""
    df, roster = uneven(spark)
    calls = df.where("value > 1").withColumn("alpha", F.lit(0.001)).unionByName(df.where("value > 2").withColumn("alpha", F.lit(0.0001)))
    wide = P.all_pairwise(df, calls, roster, "value", n_features=12)
    got = as_dict(wide, [c for c in wide.columns if c not in ("a", "b")])
    assert "Join" not in wide._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    monkeypatch.setattr(P, "CHUNK_FEATURES", 0)
    same_text = lambda x: [v if not isinstance(v, str) else float(hash(v)) for v in x]
    joined = P.all_pairwise(df, calls, roster, "value", n_features=12)
    want = as_dict(joined, [c for c in wide.columns if c not in ("a", "b")])
    same({k: same_text(v) for k, v in got.items()}, {k: same_text(v) for k, v in want.items()})


def test_equality_is_not_decided_by_rounding(spark):
    """An activity of 500 nM and one of 0.5 uM score alike at every z, whatever the last bits; other values and missing ones do not count."""
    rows = [("q", "c", -np.log10(v * 1e-9) * z, -np.log10(1000 * v * 1e-12) * z) for v in range(1, 400) for z in (1.7, -0.3)]
    assert sum(x != y for *_, x, y in rows) > 10
    inf, nan = float("inf"), float("nan")
    odd = [("q", "d", x, y) for x, y in ((1.0, 1.0), (0.0, 0.0), (1.0, 1.0 + 1e-9), (inf, 1.0), (inf, inf), (nan, 1.0), (1e-9, 2e-9))]
    detail = spark.createDataFrame([(q, c, float(x), float(y)) for q, c, x, y in rows + odd], "query string, comparator string, query_value double, comparator_value double")
    found = N.exact_equality_audit(detail.withColumn("signed_difference", F.col("query_value") - F.col("comparator_value"))).collect()
    assert {r.comparator: (r.matched_features, r.exact_equal_features) for r in found} == {"c": (len(rows), len(rows)), "d": (7, 2)}
