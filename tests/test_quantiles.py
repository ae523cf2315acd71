import numpy as np
import pytest
from pyspark.sql import functions as F

from profilespark.operators import quantiles as Q
from profilespark.operators import scores as X


def rows():
    """One key holds nine tenths of all rows; ties, nulls, NaN, infinities, outliers and null keys."""
    rng = np.random.default_rng(1)
    out = [("hot", float(v)) for v in rng.standard_normal(4000)] + [("hot", 1e300), ("hot", -1e300)]
    out += [("tied", 2.0)] * 150 + [("two", 1.0)] * 70 + [("two", 1.0 + 1e-15)] * 71 + [("far", float("inf"))] * 3 + [("far", 1.0), ("far", float("-inf"))]
    out += [(None, 3.0), (None, 5.0), ("gone", None), ("nan", float("nan")), ("nan", 4.0), ("one", -0.5)]
    out += [("skew", float(v)) for v in np.exp(20 * rng.random(300))]
    return out


@pytest.mark.parametrize("limit,ranges", [(1 << 16, 1024), (40, 7), (2, 2)])
def test_quantiles_of_a_hot_key(spark, monkeypatch, limit, ranges):
    monkeypatch.setattr(Q, "LIMIT", limit)
    monkeypatch.setattr(Q, "RANGES", ranges)
    data = [r for r in rows() if limit > 2 or r[0] not in ("hot",) or abs(r[1]) < 0.02]
    df = spark.createDataFrame(data, "k string, x double").repartition(5)
    got = {r["k"]: r for r in Q.exact_quantiles(df, ["k"], {"mid": (F.col("x"), 0.5), "high": (F.abs("x"), 0.99), "low": (F.when(F.col("x") > 0, F.col("x")), 0.1)}).collect()}
    groups: dict = {}
    for k, x in data:
        if x is not None and x == x:
            groups.setdefault(k, []).append(x)
    assert set(got) == set(groups)
    for k, x in groups.items():
        x = np.array(x)
        with np.errstate(invalid="ignore"):
            for name, values, q in (("mid", x, 0.5), ("high", np.abs(x), 0.99), ("low", x[x > 0], 0.1)):
                want = np.quantile(values, q) if len(values) else None
                if want is None:
                    assert got[k][name] is None
                elif np.isfinite(want):
                    assert abs(got[k][name] - want) <= 1e-12 * max(1, abs(want)), (k, name)


def test_no_buffer_of_a_group_in_the_plan(spark):
    df = spark.createDataFrame([("a", "t", 1.0, 2.0)], "g string, tissue string, z double, raw double")
    plan = X.expression_collapse(df, ["g", "tissue"], "z", "raw")._jdf.queryExecution().toString().lower()
    assert "median" not in plan.replace("raw_median", "") and "percentile" not in plan
