import random

from pyspark.sql import functions as F

from profilespark.operators import models as M
from profilespark.operators import ranks as R


def test_positions_with_one_leading_value(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 10 else f"g{i % 7}", rng.randint(0, 40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(6)
    got = {r["i"]: r["n"] for r in R.positions(df, ["g", F.desc("x"), "i"], "n").collect()}
    assert [got[i] for _, _, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2]))] == list(range(1, 3001))
    inside = {r["i"]: r["n"] for r in R.group_positions(df, ["g"], [F.desc("x"), "i"], "n").collect()}
    ranks = {r["i"]: r["n"] for r in R.group_ranks(df, ["g"], "x", "n").collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [inside[r[2]] for r in own] == list(range(1, len(own) + 1))
        assert all(ranks[r[2]] == 1 + sum(o[1] < r[1] for o in own) for r in own)
    assert R.positions(df.limit(0), ["g"], "n").count() == 0


def one_at_a_time(names, edges):
    edges, left, out = set(edges), len(names), []
    while left >= 3 and edges:
        count = {p: sum(p in e for e in edges) for p in names}
        worst = min((p for p in names if count[p]), key=lambda p: (-count[p], names[p], p))
        out.append(worst)
        left -= 1
        edges = {e for e in edges if worst not in e}
    return out


def test_dropping_in_rounds_equals_one_at_a_time(spark):
    rng = random.Random(2)
    for t in range(8):
        n, share = rng.choice([(4, 0.9), (9, 0.3), (14, 0.25), (25, 0.1), (25, 0.5), (3, 1.0), (12, 0.0), (30, 0.2)]) if t > 2 else [(25, 0.3), (3, 1.0), (12, 0.0)][t]
        names = {f"p{i:02d}": rng.randint(0, 2) for i in range(n)}
        pairs = [(a, b, None if rng.random() < share else 1.0) for a in names for b in names if a < b]
        kept, out = M.complete_distance_subset(spark.createDataFrame(pairs, "a string, b string, d double"), spark.createDataFrame(list(names.items()), "profile string, coverage int"), "d")
        want = one_at_a_time(names, [(a, b) for a, b, d in pairs if d is None])
        assert [r["profile"] for r in out.orderBy("exclusion_order").collect()] == want
        assert {r["profile"] for r in kept.collect()} == set(names) - set(want)
