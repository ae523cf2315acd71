import numpy as np
from pyspark.sql import functions as F

from profilespark.functions.student import critical_lambda
from profilespark.operators import activity as A
from profilespark.operators import outliers as O
from profilespark.operators import scores as X


def test_zscore_cases(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("c", 1.0), ("c", None), ("c", 3.0)]
    df = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(rows)], "i int, g string, x double")
    z = [r.z for r in X.zscore_within(df, "g", "x", "z").orderBy("i").collect()]
    assert z[:3] == [-1.0, 0.0, 1.0] and z[3:5] == [None, None] and z[6] is None
    assert abs(z[5] + 0.5 ** 0.5) < 1e-12 and abs(z[7] - 0.5 ** 0.5) < 1e-12
    z0 = [r.z for r in X.zscore_within(df.where("g = 'a'"), "g", "x", "z", ddof=0).orderBy("i").collect()]
    assert abs(z0[2] - 1 / (2 / 3) ** 0.5) < 1e-12


def test_score_join_keeps_missing(spark):
    act = spark.createDataFrame([("T1", 7.0), ("T2", None)], "t string, p double")
    exp = spark.createDataFrame([("T1", "u", -1.0), ("T1", "v", 1.0), ("T2", "u", 1.0), ("T3", "u", 2.0)], "t string, u string, z double")
    got = {r.feature_id: r.score for r in X.score_join(act, exp, "t", "u", "p", "z").collect()}
    assert got == {"T1||u": -7.0, "T1||v": 7.0, "T2||u": None, "T3||u": None}


def walk(values, alpha):
    """Plain sequential procedure, first index wins a tie."""
    live = [i for i, v in enumerate(values) if np.isfinite(v)]
    rmax, taken, last = min(int(0.1 * len(live)), len(live) - 3), [], 0
    for step in range(1, rmax + 1):
        x = np.array([values[i] for i in live])
        sd = x.std(ddof=1)
        if sd <= 0:
            break
        best = int(np.argmax(x))
        if (x[best] - x.mean()) / sd > critical_lambda([len(live)], [alpha])[0]:
            last = step
        taken.append(live.pop(best))
    return taken[:last]


def cases():
    base = list(np.linspace(-1, 1, 100))
    yield "one", base + [100.0]
    yield "tie", [x for x in base[:50]] + [50.0, 50.0] + base[50:]
    yield "low", base + [-100.0]
    yield "many", list(np.linspace(-1, 1, 500)) + [60.0] * 30
    rng = np.random.default_rng(5)
    yield "noise", list(rng.standard_t(2, 400)) + [np.nan] * 7
    yield "flat", [1.0] * 40


def frame(spark):
    rows = [(name, i, float(v)) for name, vals in cases() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "profile string, k int, v double").repartition(5)


def check(calls):
    got = {}
    for r in calls.collect():
        got.setdefault((r.profile, r.alpha), []).append((r.call_rank, r.k))
    for name, vals in cases():
        for a in (0.001, 0.0001):
            assert [k for _, k in sorted(got.get((name, a), []))] == walk(vals, a), (name, a)


def test_outliers_match_the_sequential_procedure(spark):
    check(O.gesd_calls(frame(spark), "profile", "v", "k"))


def test_hot_profiles_give_the_same_calls(spark):
    df = frame(spark)
    check(O.gesd_calls(df, "profile", "v", "k", hot_rows=120))
    cold = {(r.profile, r.step): r.r_stat for r in O.gesd_steps(df, "profile", "v", "k", hot_rows=None).collect()}
    hot = {(r.profile, r.step): r.r_stat for r in O.gesd_steps(df, "profile", "v", "k", hot_rows=1).collect()}
    assert cold.keys() == hot.keys() and max(abs(cold[k] - hot[k]) for k in cold) < 1e-9


def choice_rows(spark):
    rows = [
        ("e", "A", "BINDING_KI", "EXACT", 6.0, 1e-6), ("e", "B", "BINDING_KI", "EXACT", 5.0, 1e-5), ("e", "C", "INHIBITION_IC50", "EXACT", 9.0, 1e-9),
        ("gt", "A", "BINDING_KI", "GT_BOUND", 5.0, 1e-5), ("gt", "B", "BINDING_KI", "GT_BOUND", 4.0, 1e-4),
        ("lt", "A", "BINDING_KI", "LT_BOUND", 8.0, 1e-8), ("lt", "B", "BINDING_KI", "LT_BOUND", 9.0, 1e-9),
        ("mix", "A", "BINDING_KI", "GT_BOUND", 5.0, 1e-5), ("mix", "B", "BINDING_KI", "LT_BOUND", 6.0, 1e-6),
        ("un", "A", "BINDING_KI", "BOUNDED_DIRECTION_UNKNOWN", 5.0, 1e-5), ("un", "B", "BINDING_KI", "BOUNDED_DIRECTION_UNKNOWN", 6.0, 1e-6),
        ("none", "A", "ASSIGNED", "GT_BOUND", 5.0, 1e-5),
    ]
    return spark.createDataFrame(rows, "k string, assertion_id string, activity_type string, relation_class string, pactivity double, molar double")


def test_choices(spark):
    df = choice_rows(spark)
    assert [r.assertion_id for r in A.choose_exact(df, ["k"], ["assertion_id"]).collect()] == ["A"]
    got = {r.k: (r.assertion_id, r.bound_rule) for r in A.choose_bounded(df, ["k"], ["assertion_id"]).collect()}
    assert got["gt"] == ("B", "GT_TIGHTEST_LOWER_CONCENTRATION_BOUND") and got["lt"] == ("B", "LT_TIGHTEST_UPPER_CONCENTRATION_BOUND")
    assert got["mix"] == (None, "MIXED_BOUND_DIRECTIONS_REVIEW_REQUIRED") and got["un"][0] == "B" and got["none"] == (None, "NO_ELIGIBLE_BOUNDED_ENDPOINT")


def test_exact_rows_without_a_choice_do_not_fall_through(spark):
    df = choice_rows(spark).where("k = 'gt'").unionByName(
        spark.createDataFrame([("gt", "Z", "ASSIGNED", "EXACT", 5.0, 1e-5)], "k string, assertion_id string, activity_type string, relation_class string, pactivity double, molar double"))
    got = A.select_activity(df.withColumn("species_class", F.lit("HUMAN")), ["k"], ["assertion_id"]).collect()[0]
    assert got.assertion_id is None and got.selection_kind == "" and got.bound_selection_rule == ""
