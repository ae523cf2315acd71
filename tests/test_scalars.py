import math

import numpy as np
from pyspark.sql import functions as F

from profilespark.functions import scalars as S
from profilespark.functions.student import critical_lambda
from profilespark.plans.quadrature import lambda_table


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(col.alias("x")).collect()[0]["x"]


def test_compound_name_key(spark):
    rows = spark.createDataFrame([("  Ｓ–ketone  X ",), ("ﬁne",), (None,), ("Straße",)], "n string")
    got = [r[0] for r in rows.select(S.compound_name_key(F.col("n"))).collect()]
    assert got == ["s-ketone x", "fine", "", "strasse"]


def test_general_number(spark):
    df = spark.createDataFrame([(5.0,), (12.5,), (1e6,), (0.0001,), (123456.7,)], "v double")
    got = [r[0] for r in df.select(S.general_number(F.col("v"), 6)).collect()]
    assert got == [f"{v:g}" for v in (5.0, 12.5, 1e6, 0.0001, 123456.7)]


def test_bound_flips_with_sign(spark):
    df = spark.createDataFrame([("GT_BOUND", 2.0), ("GT_BOUND", -2.0), ("LT_BOUND", 1.0), ("EXACT", -1.0), ("GT_BOUND", 0.0), ("X", 1.0), ("EXACT", None)], "c string, z double")
    b = df.select(S.propagate_bound(S.invert_relation(F.col("c")), F.col("z")).alias("b")).select("b.*").collect()
    assert [(r.relation, r.status) for r in b] == [
        ("<", "BOUNDED_UPPER"), (">", "BOUNDED_LOWER"), (">", "BOUNDED_LOWER"), ("=", "EXACT"), ("=", "EXACT_ZERO_FROM_EXPRESSION_Z_ZERO"),
        ("?", "RELATION_UNRESOLVED"), ("?", "MISSING_EXPRESSION")]


def test_norm_ppf_inverts_the_normal_distribution(spark):
    ps = [0.0, 1e-6, 0.001, 0.05, 0.3, 0.5, 0.8, 0.999, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(S.norm_ppf(F.col("p"))).collect()]
    for p, z in zip(ps, got):
        assert abs(0.5 * math.erfc(-z / math.sqrt(2)) - min(max(p, 1e-6), 1 - 1e-6)) < 1e-12


def test_threshold_matches_quadrature_and_published_value():
    n = np.arange(20, 60)
    assert np.abs(critical_lambda(n, np.full(40, 0.001)) - np.array(lambda_table(20, 60, 0.001))).max() < 1e-9
    assert abs(critical_lambda([4466], [0.0001])[0] - 5.46202) < 1e-5
