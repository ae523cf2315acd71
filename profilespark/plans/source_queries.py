"""Readers, writers and reshaping. Files are written into a scratch folder of the session and read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..operators import reshape as H
from ..session import ensure_checkpoint_dir
from ..sources import files as FI
from ..sources import tables as T
from . import bindings as B
from .register import r, register

C = F.col


def scratch(spark) -> str:
    """A fresh folder below the shared checkpoint folder, so that every executor sees what is written."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{next(tempfile._get_candidate_names())}"


@register("read_table", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, sf):
    out = scratch(spark)
    T.write_table(T.read_table(spark, f"{sf}/part.parquet"), f"{out}/part", ("csv",))
    return T.read_table(spark, f"{out}/part.csv", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").select("p_partkey", "p_name", "p_retailprice")


@register("read_tsv", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(spark, sf):
    out = scratch(spark)
    B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").write.option("header", True).option("sep", "\t").csv(f"{out}/o.tsv")
    return T.read_tsv(spark, f"{out}/o.tsv", "o_orderkey long, o_orderpriority string, o_totalprice double")


@register("resolve_columns", "SELECT c_custkey AS customer, c_name AS label, c_acctbal AS balance FROM customer")
def _(spark, sf):
    return T.resolve_columns(B.table(spark, sf, "customer"), {"customer": ["CUST_ID", "C_CUSTKEY"], "label": ["name", "c_Name"], "balance": ["c_acctbal"], "absent": ["nope"]}, ["customer"])


@register("ensure_columns", "SELECT s_suppkey, s_acctbal, 'none' AS note FROM supplier")
def _(spark, sf):
    return T.ensure_columns(B.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), {"note": F.lit("none"), "s_acctbal": F.lit(0.0)})


@register("unpivot_profiles", "SELECT n_name, c.feature_id, c.target, total FROM (SELECT n_name, p_brand, CASE WHEN sum(l_quantity) > 40 THEN sum(l_quantity) END AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) w RIGHT JOIN (SELECT n_name AS nn, 'Brand#' || i AS feature_id, 'T' || (i % 3) AS target FROM (SELECT DISTINCT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey), range(1, 11) t(i)) c ON w.n_name = c.nn AND w.p_brand = c.feature_id".replace("SELECT n_name, c.feature_id", "SELECT c.nn AS n_name, c.feature_id", 1))
def _(spark, sf):
    j = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part"), C("l_partkey") == C("p_partkey")).join(B.table(spark, sf, "supplier"), C("l_suppkey") == C("s_suppkey")).join(B.table(spark, sf, "nation"), C("s_nationkey") == C("n_nationkey"))
    brands = [f"Brand#{i}" for i in range(1, 26)]
    q = F.sum("l_quantity")
    cells = j.groupBy("n_name", "p_brand").agg(F.when(q > 40, q).alias("q"))
    wide = H.pivot_matrix(cells, "n_name", "p_brand", "q", brands)
    con = spark.createDataFrame([(f"Brand#{i}", f"T{i % 3}") for i in range(1, 11)], "feature_id string, target string")
    return H.unpivot_profiles(wide, F.broadcast(con), "n_name", "total").select("n_name", "feature_id", "target", "total")


@register("pivot_matrix", "SELECT target, " + ", ".join(f"max(CASE WHEN tissue = 'NATION_{i}' THEN raw END) AS NATION_{i}" for i in range(25)) + " FROM expression GROUP BY 1")
def _(spark, sf):
    return H.pivot_matrix(B.expression(spark, sf), "target", "tissue", "raw", [f"NATION_{i}" for i in range(25)])


@register("write_table", "SELECT 'parquet' AS format, count(*) AS n, sum(c_custkey) AS s FROM customer UNION ALL SELECT 'csv', count(*), sum(c_custkey) FROM customer")
def _(spark, sf):
    out = scratch(spark)
    T.write_table(B.table(spark, sf, "customer"), f"{out}/c")
    frames = [T.read_table(spark, f"{out}/c.parquet"), T.read_table(spark, f"{out}/c.csv", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")]
    tags = ["parquet", "csv"]
    parts = [f.agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("s")).select(F.lit(t).alias("format"), "n", "s") for f, t in zip(frames, tags)]
    return parts[0].unionByName(parts[1])


@register("roundtrip_equivalence", "SELECT count(*) AS keys, 0 AS unmatched, 0 AS null_mismatches, 0.0::DOUBLE AS max_delta, true AS equal FROM expression")
def _(spark, sf):
    out = scratch(spark)
    e = B.expression_z(spark, sf).select("target", "tissue", "raw", "z")
    T.write_table(e, f"{out}/e")
    a = T.read_table(spark, f"{out}/e.parquet")
    b = T.read_table(spark, f"{out}/e.csv", "target string, tissue string, raw double, z double")
    return T.roundtrip_equivalence(a, b, ["target", "tissue"], ["raw", "z"])


@register("json_records_scan", "SELECT profile, target, tissue, round(value, 6) AS score, alpha FROM vector_calls")
def _(spark, sf):
    out = scratch(spark)
    calls = B.vector_calls(spark, sf).withColumnRenamed("value", "score")
    recs = T.json_records_export(calls, "DS", "calls.csv", ["profile", "alpha", "call_rank"])
    T.json_records_write(recs, f"{out}/records")
    back = T.json_records_scan(spark, f"{out}/records", multi_line=False)
    return back.select(C("profile_id").cast("long").alias("profile"), C("target_id").alias("target"), C("tissue_id").alias("tissue"), F.round("hr_score", 6).alias("score"), C("gesd_alpha").alias("alpha"))


@register("json_records_export", "SELECT row_number() OVER (ORDER BY CAST(profile AS VARCHAR), profile, alpha, step) AS source_row, profile, target, tissue, true AS fingerprint_member, 'supported' AS support_status FROM vector_calls")
def _(spark, sf):
    calls = B.vector_calls(spark, sf).withColumnRenamed("value", "score")
    recs = T.json_records_export(calls, "DS", "calls.csv", ["profile", "alpha", "call_rank"])
    j = recs.select("source_row", F.from_json("record", T.RECORD_SCHEMA).alias("j"))
    return j.select("source_row", C("j.profile_id").cast("long").alias("profile"), C("j.target_id").alias("target"), C("j.tissue_id").alias("tissue"), C("j.fingerprint_member").alias("fingerprint_member"), C("j.support_status").alias("support_status"))


@register("file_inventory")
def _(spark, sf):
    return FI.file_inventory(spark, sf, exclude=("labels.parquet",))


@register("verify_manifest")
def _(spark, sf):
    inv = FI.file_inventory(spark, sf)
    manifest = inv.where("path <> 'nation.parquet'").withColumn("sha256", F.when(C("path") == "region.parquet", F.lit("changed")).otherwise(C("sha256")))
    return FI.verify_manifest(inv, manifest).select("path", "bytes", "status")
