import random

from pyspark.sql import functions as F

from profilespark.operators import activity as A
from profilespark.operators import resolve as Z
from profilespark.operators import winners as W


def test_first_rows_equal_a_sort(spark):
    rng = random.Random(1)
    words = [None, "", "a", "aé", "a-long-prefix-1", "a-long-prefix-2", "b", "é", "\U0001f600"]
    rows = [(rng.choice(["k", "m", None]), rng.choice([None, 1.0, 2.0, float("nan"), -1.5]), rng.choice(words), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, t string, i int")
    text = lambda t: (t is not None, (t or "").encode())
    number = lambda x: (x is not None, x != x if x is not None else False, 0 if x is None or x != x else x)
    for order, key in ((["x", "i"], lambda r: (number(r[1]), r[3])), (["t", "i"], lambda r: (text(r[2]), r[3]))):
        got = {r["k"]: r["i"] for r in W.first_rows(df, ["k"], order).collect()}
        want = {k: min((r for r in rows if r[0] == k), key=key)[3] for k in {r[0] for r in rows}}
        assert got == want


def test_no_sorted_aggregate(spark):
    df = spark.createDataFrame([("p", "t", 1, 6.0, 1e-6, "EXACT", "BINDING_KI", "HUMAN")], "profile string, target string, assertion_id int, pactivity double, molar double, relation_class string, activity_type string, species_class string")
    for out in (A.select_activity(df, ["profile", "target"], ["assertion_id"]), A.choose_exact(df, ["profile"], ["assertion_id"]), A.choose_bounded(df, ["profile"], ["assertion_id"]),
                Z.dedupe_first(df, ["profile"], ["target"]), Z.collapse_identical(df, ["profile"], ["target"], "assertion_id")[0]):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_ties_and_a_key_with_most_rows(spark):
    """All rows of the large target hold the same best value; the smallest id wins."""
    rows = [("hot", f"id{i:05d}", 7.0, 1e-7, "EXACT", "BINDING_KI", "HUMAN") for i in range(3000, 0, -1)]
    rows += [("cold", "b", 6.0, 1e-6, "GT_BOUND", "BINDING_KI", "HUMAN"), ("cold", "a", 6.5, 3e-7, "GT_BOUND", "BINDING_KI", "HUMAN"), ("cold", "c", 9.0, 1e-9, "EXACT", "BINDING_KI", "MAMMALIAN_NONHUMAN")]
    rows += [("mixed", "a", 6.0, 1e-6, "GT_BOUND", "BINDING_KI", "HUMAN"), ("mixed", "b", 6.0, 1e-6, "LT_BOUND", "BINDING_KI", "HUMAN"), ("none", "z", 6.0, 1e-6, "EXACT", "BINDING_KI", "NON_MAMMALIAN")]
    df = spark.createDataFrame(rows, "target string, assertion_id string, pactivity double, molar double, relation_class string, activity_type string, species_class string").repartition(6)
    got = {r["target"]: r for r in A.select_activity(df, ["target"], ["assertion_id", "pactivity"]).collect()}
    assert got["hot"]["assertion_id"] == "id00001" and got["hot"]["selection_kind"] == "EXACT_MEASURED"
    assert got["cold"]["assertion_id"] == "b" and got["cold"]["bound_selection_rule"].startswith("GT_TIGHTEST")
    assert got["mixed"]["assertion_id"] is None and got["mixed"]["bound_selection_rule"] == "MIXED_BOUND_DIRECTIONS_REVIEW_REQUIRED" and got["mixed"]["selection_kind"] == ""
    assert got["none"]["assertion_id"] is None and got["none"]["species_basis"] == ""
    assert df.count() == 3006 and len(got) == 4
