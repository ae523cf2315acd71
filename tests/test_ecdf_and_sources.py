import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from profilespark.operators import ecdf as E
from profilespark.sources import files as FI
from profilespark.sources import tables as T


def test_weighted_ecdf(spark):
    k = E.fit_knots(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 1.0), (5.0, 4.0), (7.0, 0.0)], "v double, w double"), "v", "w")
    df = spark.createDataFrame([(2.0,), (3.0,), (0.0,), (9.0,), (5.0,), (None,)], "x double")
    got = {r.x: r.p for r in E.weighted_ecdf_asof(df, k, "x", "p").collect()}
    assert got == {2.0: 2.5 / 8, 3.0: 4 / 8, 0.0: 0.0, 9.0: 1.0, 5.0: 6 / 8, None: None}


def test_ranges_carry_their_tails(spark):
    """Values far above, below and between knots, over several ranges, some of them without any knot."""
    rng = np.random.default_rng(1)
    knots = np.round(rng.standard_normal(300), 2).tolist()
    asked = np.round(rng.standard_normal(3000) * 3 + 2, 2).tolist()
    k = E.fit_knots(spark.createDataFrame([(x, 1.0) for x in knots], "v double, w double"), "v", "w")
    got = {r.x: r.p for r in E.weighted_ecdf_asof(spark.createDataFrame([(x,) for x in asked], "x double").repartition(5), k, "x", "p").collect()}
    at = np.array(knots)
    assert set(got) == set(asked)
    for x, p in got.items():
        assert abs(p - ((at < x).sum() + (at == x).sum() / 2) / 300) < 1e-12


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "sub" / "b.txt").write_bytes(b"two")
    inv = FI.file_inventory(spark, str(tmp_path))
    got = {r.path: (r.bytes, r.sha256) for r in inv.collect()}
    assert got == {"a.txt": (3, hashlib.sha256(b"one").hexdigest()), "sub/b.txt": (3, hashlib.sha256(b"two").hexdigest())}
    manifest = spark.createDataFrame([("a.txt", 3, "x"), ("c.txt", 1, "y")], "path string, bytes long, sha256 string")
    assert {r.path: r.status for r in FI.verify_manifest(inv, manifest).collect()} == {"a.txt": "CHANGED", "sub/b.txt": "UNEXPECTED", "c.txt": "MISSING"}


def test_inventory_of_files_beyond_a_row(spark, tmp_path):
    """A file of more than 2 GB (a hole, which takes no disk) cannot be a row's content."""
    (tmp_path / "a b").mkdir()
    with open(tmp_path / "a b" / "large%20é.bin", "wb") as file:
        file.write(b"start")
        file.truncate((1 << 31) + 7)
    (tmp_path / "small").write_bytes(b"one")
    with open(tmp_path / "a b" / "large%20é.bin", "rb") as file:
        want = hashlib.file_digest(file, "sha256").hexdigest()
    got = sorted((r.path, r.bytes, r.sha256) for r in FI.file_inventory(spark, str(tmp_path)).collect())
    assert [g[1:] for g in got] == [((1 << 31) + 7, want), (3, hashlib.sha256(b"one").hexdigest())]


def test_records_survive_a_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("p1", "t", "u", 1.5, 0.001), ("p2", "t", "v", 2.5, 0.001), ("p1", "s", "u", 3.5, 0.001)], "profile string, target string, tissue string, score double, alpha double")
    recs = T.json_records_export(calls, "DS", "c.csv", ["profile", "target"])
    T.json_records_write(recs, str(tmp_path / "r"), chunk=2)
    back = T.json_records_scan(spark, str(tmp_path / "r"), multi_line=False).orderBy("source_row").collect()
    assert [(r.source_row, r.profile_id, r.target_id, r.hr_score) for r in back] == [(1, "p1", "s", 3.5), (2, "p1", "t", 1.5), (3, "p2", "t", 2.5)]


def test_both_files_hold_the_same_run(spark, tmp_path):
    """A column that differs from run to run (as the last bits of a sum may) is the same in the Parquet and the CSV file."""
    drawn = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    T.write_table(spark.range(50).withColumn("x", drawn()), str(tmp_path / "t"))
    out = T.roundtrip_equivalence(T.read_table(spark, str(tmp_path / "t.parquet")), T.read_table(spark, str(tmp_path / "t.csv"), "id long, x double"), ["id"], ["x"]).first()
    assert (out["keys"], out.unmatched, out.max_delta, out.equal) == (50, 0, 0.0, True)
