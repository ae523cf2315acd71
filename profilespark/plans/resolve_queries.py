"""Consensus, de-duplication, checked joins and resolution cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab as V
from ..operators import curation as U
from ..operators import resolve as Z
from . import bindings as B
from .register import r, register
from .views import relation_sql, species_class_sql

C = F.col


@register("consensus_value", "SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def _(spark, sf):
    return Z.consensus_value(B.table(spark, sf, "orders"), "o_custkey", ["o_orderpriority"], C("o_orderstatus") != "P")


_DUP = "SELECT l_orderkey, min(l_linenumber) AS n, CASE WHEN count(DISTINCT l_returnflag) > 1 AND count(DISTINCT l_linestatus) > 1 THEN 'l_returnflag, l_linestatus' WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' WHEN count(DISTINCT l_linestatus) > 1 THEN 'l_linestatus' ELSE '' END AS conflicting_columns FROM lineitem GROUP BY 1"


@register("collapse_identical", _DUP)
def _(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    clean, bad = Z.collapse_identical(li, ["l_orderkey"], ["l_returnflag", "l_linestatus"], "l_linenumber")
    lows = li.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("n"))
    ok = clean.select("l_orderkey", C("l_linenumber").alias("n"), F.lit("").alias("conflicting_columns"))
    return ok.unionByName(bad.join(lows, "l_orderkey"))


@register("dedupe_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) WHERE rk = 1")
def _(spark, sf):
    return Z.dedupe_first(B.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("drop_ambiguous_map", "SELECT label, min(id) AS id FROM (SELECT upper(trim(p_name)) AS label, p_brand AS id FROM part UNION SELECT upper(trim(p_type || p_size)), p_brand FROM part) GROUP BY 1 HAVING count(*) = 1")
def _(spark, sf):
    p = B.table(spark, sf, "part").withColumn("alt", F.concat("p_type", C("p_size").cast("string")))
    return Z.drop_ambiguous_map(p, "p_brand", ["p_name", "alt"])


@register("profile_choice", "SELECT CASE WHEN max(CASE WHEN o_orderpriority LIKE '%MEDIUM%' THEN 1 END) = 1 THEN min(CASE WHEN o_orderpriority LIKE '%MEDIUM%' THEN o_orderpriority END) END AS id, 'PREFERRED' AS rule FROM orders UNION ALL SELECT (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 'MODAL'")
def _(spark, sf):
    o = B.table(spark, sf, "orders")
    return Z.profile_choice(o, "o_orderpriority", "medium").unionByName(Z.profile_choice(o, "o_orderpriority", "absent"))


@register("contract_filter", "SELECT feature_id, feature_order, lower(replace(tissue, '_', '')) AS tissue_key FROM contract WHERE feature_order % 3 = 0")
def _(spark, sf):
    d = B.contract(spark, sf).withColumn("flag", F.when(C("feature_order") % 3 == 0, "Yes").otherwise("0"))
    return Z.contract_filter(d, "flag").select("feature_id", "feature_order", "tissue_key")


@register("measured_split", "SELECT 'measured' AS part, count(*) AS n FROM cleaned WHERE lane = 'MEASURED_NUMERICAL' UNION ALL SELECT 'modeled', count(*) FROM cleaned WHERE lane IN ('MODELED_OR_IMPUTED', 'ASSIGNED_SCENARIO') UNION ALL SELECT 'unresolved_species', count(*) FROM cleaned WHERE species_class = 'UNRESOLVED' UNION ALL SELECT 'bounded', count(*) FROM cleaned WHERE relation_class IN ('GT_BOUND', 'LT_BOUND', 'BOUNDED_DIRECTION_UNKNOWN')")
def _(spark, sf):
    out = None
    for name, df in Z.measured_split(B.cleaned(spark, sf)).items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("value_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM cleaned GROUP BY 2" for c in ("species_class", "relation_class", "lane")))
def _(spark, sf):
    return Z.value_counts(B.cleaned(spark, sf), ["species_class", "relation_class", "lane"])


@register("checked_join", "SELECT 'VIOLATION' AS kind, o_custkey AS k, count(*) AS n FROM orders GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'JOINED', c_custkey, count(*) FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 2")
def _(spark, sf):
    c = B.table(spark, sf, "customer").select(C("c_custkey").alias("k"), "c_name")
    o = B.table(spark, sf, "orders").select(C("o_custkey").alias("k"), "o_orderkey")
    joined, bad = Z.checked_join(c, o, ["k"], "inner", "one_to_one")
    return bad.select(F.lit("VIOLATION").alias("kind"), "k", "n").unionByName(joined.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.lit("JOINED").alias("kind"), "k", "n"))


# requested targets: by id, by a clear gene, by an unclear gene (family), by a composite, by nothing known
_REQ = "SELECT DISTINCT CASE brand % 5 WHEN 0 THEN target ELSE 'X' || brand || tp END AS target, CASE brand % 5 WHEN 1 THEN gene_symbol WHEN 2 THEN 'FAM' || tp WHEN 3 THEN gene_symbol || ';B' ELSE 'NONE' END AS gene_symbol FROM (SELECT *, CAST(regexp_extract(target, '([0-9]+)', 1) AS INTEGER) AS brand, right(gene_symbol, 2) AS tp FROM expression)"
_DIC = "SELECT target, tissue, raw, z, feature_order, CASE WHEN CAST(regexp_extract(target, '([0-9]+)', 1) AS INTEGER) >= 20 THEN 'FAM' || right(gene_symbol, 2) ELSE gene_symbol END AS gene_symbol FROM expression_z"


def requested(spark, sf):
    e = B.expression(spark, sf).select("target", "gene_symbol").distinct()
    n = F.regexp_extract("target", "([0-9]+)", 1).cast("int")
    tp = F.substring(C("gene_symbol"), F.length("gene_symbol") - 1, F.lit(2))
    return e.select(
        F.when(n % 5 == 0, C("target")).otherwise(F.concat(F.lit("X"), n.cast("string"), tp)).alias("target"),
        F.when(n % 5 == 1, C("gene_symbol")).when(n % 5 == 2, F.concat(F.lit("FAM"), tp)).when(n % 5 == 3, F.concat("gene_symbol", F.lit(";B"))).otherwise("NONE").alias("gene_symbol")).distinct()


def dictionary(spark, sf):
    n = F.regexp_extract("target", "([0-9]+)", 1).cast("int")
    tp = F.substring(C("gene_symbol"), F.length("gene_symbol") - 1, F.lit(2))
    return B.expression_z(spark, sf).withColumn("gene_symbol", F.when(n >= 20, F.concat(F.lit("FAM"), tp)).otherwise(C("gene_symbol")))


@register("fallback_join", """SELECT r.target AS requested_id, r.gene_symbol AS requested_gene, coalesce(CASE WHEN d1.k IS NOT NULL THEN 'EXACT_ID' WHEN d2.k IS NOT NULL THEN 'UNAMBIGUOUS_GENE' END, 'NO_MATCH') AS method, coalesce(d1.k, d2.k, 1) AS n
FROM req r LEFT JOIN (SELECT target, count(*) AS k FROM dic GROUP BY 1) d1 ON r.target = d1.target
LEFT JOIN (SELECT upper(gene_symbol) AS g, count(*) AS k FROM dic GROUP BY 1 HAVING count(DISTINCT target) = 1) d2 ON upper(r.gene_symbol) = d2.g AND d1.k IS NULL AND NOT regexp_matches(r.gene_symbol, '[;|,]')""", req=_REQ, dic=_DIC)
def _(spark, sf):
    f = Z.fallback_join(requested(spark, sf), dictionary(spark, sf), "target", "gene_symbol")
    return f.groupBy("requested_id", "requested_gene", "method").agg(F.count(F.lit(1)).alias("n"))


@register("id_or_label_join", "SELECT gene_symbol, feature_order AS tissue_key, round(z, 6) AS value_a, round(abs(z - (z + 1)), 6) AS abs_delta, 'GENE_PLUS_TISSUE_LABEL' AS join_mode FROM (SELECT gene_symbol, tissue AS feature_order, z FROM expression_z)")
def _(spark, sf):
    e = B.expression_z(spark, sf)
    a = e.select("gene_symbol", F.concat(F.lit("a"), "tissue").alias("tid"), C("tissue").alias("lab"), "z")
    b = e.select("gene_symbol", F.concat(F.lit("b"), "tissue").alias("tid"), C("tissue").alias("lab"), (C("z") + 1).alias("z2"))
    return Z.id_or_label_join(a, b, "gene_symbol", "tid", "lab", "z", "z2").select("gene_symbol", "tissue_key", r("value_a"), r("abs_delta"), "join_mode")


_NEWV = "SELECT profile, feature_id, CASE WHEN profile % 4 = 1 AND feature_order = 7 THEN value + 1 ELSE value END AS v FROM vectors WHERE profile % 2 = 1 AND NOT (profile % 4 = 3 AND profile % 3 = 0 AND feature_order = 9)"


@register("gated_upsert", "SELECT profile, feature_id, CASE WHEN a.value IS NULL AND v IS NULL THEN NULL WHEN n.profile IS NULL THEN 'KEY_SET' WHEN (a.value IS NULL) <> (v IS NULL) THEN 'NULL_MASK_value' ELSE 'VALUE_value' END AS violation FROM (SELECT * FROM vectors WHERE profile % 2 = 1) a LEFT JOIN newv n USING (profile, feature_id) WHERE n.profile IS NULL OR (a.value IS NULL) <> (v IS NULL) OR abs(a.value - v) > 1e-10".replace("CASE WHEN a.value IS NULL AND v IS NULL THEN NULL WHEN n.profile", "CASE WHEN n.profile").replace("LEFT JOIN newv n USING (profile, feature_id)", "LEFT JOIN newv n ON a.profile = n.profile AND a.feature_id = n.feature_id").replace("SELECT profile, feature_id, CASE", "SELECT a.profile, a.feature_id, CASE"), newv=_NEWV)
def _(spark, sf):
    v = B.vectors(spark, sf)
    new = v.where("profile % 2 = 1").where(~((C("profile") % 4 == 3) & (C("profile") % 3 == 0) & (C("feature_order") == 9))).withColumn("value", F.when((C("profile") % 4 == 1) & (C("feature_order") == 7), C("value") + 1).otherwise(C("value")))
    _, bad = Z.gated_upsert(v, new, ["profile", "feature_id"], ["value"])
    return bad


@register("gated_upsert_result", "SELECT profile, feature_id, round(CASE WHEN profile % 2 = 1 AND profile % 5 <> 0 THEN value ELSE value END, 6) AS value, profile % 2 = 1 AND profile % 5 <> 0 AS replaced FROM vectors")
def _(spark, sf):
    v = B.vectors(spark, sf).withColumn("replaced", F.lit(False))
    new = v.where("profile % 2 = 1").withColumn("replaced", F.lit(True)).withColumn("value", F.when((C("profile") % 5 == 0), C("value") + 1).otherwise(C("value")))
    out, _ = Z.gated_upsert(v, new, ["profile", "feature_id"], ["value"])
    return out.select("profile", "feature_id", r("value"), "replaced")


# ---- identities and targets

_ID_SQL = """SELECT s_suppkey, nm, lane, CASE WHEN nm = '' THEN 'UNRESOLVED' WHEN k = 'supplier shared' THEN CASE WHEN lane = 'EAST' THEN 'RESOLVED' WHEN lane = 'WEST' THEN 'RESOLVED' ELSE 'AMBIGUOUS' END WHEN k IN ('twin', 'twin-name') THEN 'AMBIGUOUS' WHEN regexp_matches(k, '^supplier#0000000[0-9]{2}$') AND s_suppkey % 10 = 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status,
  CASE WHEN k = 'supplier shared' THEN CASE lane WHEN 'EAST' THEN 'S000' WHEN 'WEST' THEN 'S010' END WHEN regexp_matches(k, '^supplier#0000000[0-9]{2}$') AND s_suppkey % 10 = 0 THEN 'S' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') END AS canonical_id,
  CASE WHEN k = 'supplier shared' AND lane = 'NORTH' THEN 'S000,S010' WHEN k = 'twin' THEN 'S020,S030' ELSE '' END AS candidates
FROM (SELECT *, lower(regexp_replace(trim(nm), '\\s+', ' ', 'g')) AS k FROM (SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN '  ' || upper(s_name) WHEN 1 THEN 'Supplier   Shared' WHEN 2 THEN 'twin' WHEN 3 THEN '' ELSE s_name END AS nm, CASE s_suppkey % 3 WHEN 0 THEN 'EAST' WHEN 1 THEN 'WEST' ELSE 'NORTH' END AS lane FROM supplier WHERE s_suppkey < 100 OR s_suppkey % 10 <> 0))"""


@register("resolve_identity", _ID_SQL)
def _(spark, sf):
    s = B.table(spark, sf, "supplier").where("s_suppkey < 100 or s_suppkey % 10 <> 0")
    m = C("s_suppkey") % 10
    nm = F.when(m == 0, F.concat(F.lit("  "), F.upper("s_name"))).when(m == 1, "Supplier   Shared").when(m == 2, "twin").when(m == 3, "").otherwise(C("s_name"))
    lane = F.when(C("s_suppkey") % 3 == 0, "EAST").when(C("s_suppkey") % 3 == 1, "WEST").otherwise("NORTH")
    rows = s.select("s_suppkey", nm.alias("nm"), lane.alias("lane"))
    reg = s.where("s_suppkey % 10 = 0").select(F.concat(F.lit("S"), F.lpad(C("s_suppkey").cast("string"), 3, "0")).alias("canonical_id"), F.concat(F.lit("Label "), "s_name").alias("label"),
                                              F.when(C("s_suppkey").isin(20, 30), F.array("s_name", F.lit("Twin"))).otherwise(F.array("s_name")).alias("aliases"))
    amb = spark.createDataFrame([("supplier shared", ["S000", "S010"], "Shared by two.", {"EAST": "S000", "WEST": "S010"})], "alias string, candidate_ids array<string>, reason string, lanes map<string,string>")
    out = Z.resolve_identity(rows, "nm", "lane", reg, amb)
    return out.select("s_suppkey", "nm", "lane", "status", "canonical_id", F.array_join("candidates", ",").alias("candidates"))


_HT = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN g NOT IN ('', 'EXACT_SINGLE_PROTEIN') THEN 'UNSUPPORTED_TARGET_GRAIN' WHEN lower(t) IN ('nmda receptor', 'gabaa receptor') THEN 'AMBIGUOUS_TARGET_GRAIN' WHEN x.target IS NOT NULL THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution,
  CASE WHEN g IN ('', 'EXACT_SINGLE_PROTEIN') AND lower(t) NOT IN ('nmda receptor', 'gabaa receptor') THEN x.target END AS resolved_target
FROM (SELECT l.*, CASE l_linenumber WHEN 1 THEN upper(p_brand || ':' || p_type) WHEN 2 THEN 'gene' || regexp_extract(p_brand, '([0-9]+)', 1) || lower(substr(p_type, 1, 2)) WHEN 3 THEN 'NMDA receptor' WHEN 4 THEN 'GABAA Receptor' WHEN 5 THEN 'nothing' ELSE p_brand || ':' || p_type END AS t,
    CASE l_linenumber WHEN 6 THEN 'FAMILY' WHEN 7 THEN 'EXACT_SINGLE_PROTEIN' ELSE '' END AS g FROM lineitem l JOIN part ON l_partkey = p_partkey) q
LEFT JOIN (SELECT DISTINCT target, gene_symbol FROM expression) x ON lower(t) = lower(x.target) OR lower(t) = lower(x.gene_symbol)"""


@register("harmonize_target", _HT)
def _(spark, sf):
    j = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part"), C("l_partkey") == C("p_partkey"))
    n = C("l_linenumber")
    gene = F.concat(F.lit("gene"), B.brand_no().cast("string"), F.lower(F.substring("p_type", 1, 2)))
    rows = j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(n == 1, F.upper(B.target())).when(n.isin(6, 7), B.target()).otherwise("").alias("cid"), F.when(n == 2, gene).otherwise("").alias("gene"),
        F.when(n == 3, "NMDA receptor").when(n == 4, "GABAA Receptor").when(n == 5, "nothing").otherwise("ignored").alias("lab"), F.when(n == 6, "FAMILY").when(n == 7, "EXACT_SINGLE_PROTEIN").otherwise("").alias("grain_in"))
    con, _ = Z.target_contract(B.expression(spark, sf).select("target", "gene_symbol", F.lit("EXACT_SINGLE_PROTEIN").alias("grain")))
    out = Z.harmonize_target(rows, con, "cid", "gene", "lab", "grain_in")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "resolution", "resolved_target")


@register("target_contract", "SELECT target, gene_symbol, g AS grain, count(*) OVER (PARTITION BY target) > 1 AS conflict FROM (SELECT DISTINCT target, gene_symbol, CASE WHEN feature_order % 1000 = 7 THEN 'OTHER' ELSE 'EXACT_SINGLE_PROTEIN' END AS g FROM expression)")
def _(spark, sf):
    d = B.expression(spark, sf).withColumn("grain", F.when(C("feature_order") % 1000 == 7, "OTHER").otherwise("EXACT_SINGLE_PROTEIN"))
    con, bad = Z.target_contract(d)
    return con.join(bad.select("target", F.lit(True).alias("_b")), "target", "left").select("target", "gene_symbol", "grain", C("_b").isNotNull().alias("conflict"))


# ---- species cascade. Audit rows come from orders, raw records from suppliers.

def audit(spark, sf):
    o = B.table(spark, sf, "orders")
    k = C("o_orderkey")
    return o.select(
        F.concat(F.lit("o"), k.cast("string")).alias("source_assertion_id"), F.concat(F.lit("g"), (k % 50).cast("string")).alias("duplicate_group_id"),
        F.when(k % 4 == 0, "Mus musculus").when(k % 4 == 1, "unclear").otherwise("").alias("organism"),
        F.when(k % 8 == 3, "human").otherwise("").alias("species"), F.when(k % 4 == 2, 10116.0).alias("taxon_id"),
        F.when(k % 3 == 0, ">").when(k % 3 == 1, "lt").otherwise("~").alias("relation_operator"))


_AUDIT = """SELECT 'o' || o_orderkey AS sid, 'g' || (o_orderkey % 50) AS gid, o_orderkey,
  CASE WHEN o_orderkey % 4 = 0 THEN 'MAMMALIAN_NONHUMAN' WHEN o_orderkey % 8 = 3 THEN 'HUMAN' WHEN o_orderkey % 4 = 2 THEN 'MAMMALIAN_NONHUMAN' END AS cls,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Mus musculus' WHEN o_orderkey % 8 = 3 THEN 'Homo sapiens' WHEN o_orderkey % 4 = 2 THEN 'taxon:10116' END AS species,
  CASE WHEN o_orderkey % 3 = 0 THEN '>' WHEN o_orderkey % 3 = 1 THEN 'lt' END AS op FROM orders"""


def raw_records(spark, sf):
    s = B.table(spark, sf, "supplier")
    k = C("s_suppkey")
    base = s.select(k.cast("string").alias("record_id"), F.when(k % 3 == 0, "Homo sapiens").when(k % 3 == 1, "rat").otherwise("zebrafish").alias("species"),
                    F.concat(F.lit("Rec-"), (k % 40).cast("string")).alias("receptor"), F.when(k % 4 == 0, "other drug").when(k % 4 == 1, "").otherwise("Ligandine").alias("ligand"))
    return base.unionByName(base.where("cast(record_id as int) % 7 = 0").withColumn("species", F.lit("mouse")))


_RAW = """SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS record_id, CASE s_suppkey % 3 WHEN 0 THEN 'HUMAN' WHEN 1 THEN 'MAMMALIAN_NONHUMAN' ELSE 'NON_MAMMALIAN' END AS cls, CASE s_suppkey % 3 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'rat' ELSE 'zebrafish' END AS species,
  'REC' || (s_suppkey % 40) AS name_key, CASE s_suppkey % 4 WHEN 0 THEN 'other drug' WHEN 1 THEN '' ELSE 'ligandine' END AS ligand FROM supplier
  UNION ALL SELECT s_suppkey, CAST(s_suppkey AS VARCHAR), 'MAMMALIAN_NONHUMAN', 'mouse', 'REC' || (s_suppkey % 40), CASE s_suppkey % 4 WHEN 0 THEN 'other drug' WHEN 1 THEN '' ELSE 'ligandine' END FROM supplier WHERE s_suppkey % 7 = 0"""
_RAWID = "SELECT record_id, min(cls) AS cls, min(species) AS species, bool_or(ligand = '' OR contains(ligand, 'ligandine')) AS ok FROM raw GROUP BY 1 HAVING count(DISTINCT (cls, species)) = 1"
_RAWNM = "SELECT name_key, min(cls) AS cls, min(species) AS species FROM raw WHERE ligand = '' OR contains(ligand, 'ligandine') GROUP BY 1 HAVING count(DISTINCT (cls, species)) = 1"


@register("raw_record_map", "SELECT 'ID' AS kind, record_id AS k, cls, species FROM rawid UNION ALL SELECT 'NAME', name_key, cls, species FROM rawnm", raw=_RAW, rawid=_RAWID, rawnm=_RAWNM)
def _(spark, sf):
    by_id, by_name = Z.raw_record_map(raw_records(spark, sf), "ligandine")
    return by_id.select(F.lit("ID").alias("kind"), C("record_id").alias("k"), "cls", "species").unionByName(by_name.select(F.lit("NAME").alias("kind"), C("name_key").alias("k"), "cls", "species"))


def species_input(spark, sf):
    a = B.assertions(spark, sf)
    blank = C("source_row") % 2 == 0
    ref = C("source_row") % 3 != 0
    return a.select(
        "assertion_id", F.when(ref, F.concat(F.lit("o"), C("source_row").cast("string"), F.lit(" | x"), C("source_row").cast("string"))).otherwise("").alias("all_ids"),
        F.when(C("source_row") % 5 == 0, F.concat(F.lit("g"), (C("source_row") % 50).cast("string"))).otherwise(C("duplicate_group_id")).alias("duplicate_group_id"),
        "source_database", "assay_id", F.when(blank, "").otherwise(C("species_reported")).alias("species_reported"), F.when(~blank, C("taxon_reported")).alias("taxon_reported"),
        F.when(blank, "").otherwise(C("target_organism")).alias("target_organism"), F.lit("").alias("assay_organism"), F.lit("").alias("original_target_name"),
        F.concat(F.lit("rec "), (C("source_row") % 60).cast("string")).alias("target_name"), "gene_symbol", "target", "relation", "lane_hint" if "lane_hint" in a.columns else F.lit("").alias("lane_hint"))


_SIN = f"""SELECT *, CASE WHEN c1 <> 'UNRESOLVED' THEN c1 WHEN c2 <> 'UNRESOLVED' THEN c2 END AS own, CASE WHEN c1 = 'HUMAN' OR (c1 = 'UNRESOLVED' AND c2 = 'HUMAN') THEN 'Homo sapiens' WHEN c1 <> 'UNRESOLVED' THEN sr WHEN c2 <> 'UNRESOLVED' THEN tor END AS own_sp FROM (
  SELECT *, {species_class_sql('sr', 'tr')} AS c1, {species_class_sql('tor', 'NULL')} AS c2 FROM (
    SELECT assertion_id, source_row, source_database, relation, regexp_extract(assay_id, 'LAB Ki_([0-9]+)', 1) AS rec, CASE WHEN source_row % 5 = 0 THEN 'g' || (source_row % 50) ELSE duplicate_group_id END AS gid,
      CASE WHEN source_row % 2 = 0 THEN '' ELSE species_reported END AS sr, CASE WHEN source_row % 2 = 1 THEN taxon_reported END AS tr, CASE WHEN source_row % 2 = 0 THEN '' ELSE coalesce(target_organism, '') END AS tor, 'REC' || (source_row % 60) AS nm FROM assertion))"""
_S1 = """SELECT s.*, coalesce(own, a.cls, g.cls, CASE WHEN r.ok THEN r.cls END) AS cls, coalesce(own_sp, a.species, g.species, CASE WHEN r.ok THEN r.species END) AS sp,
  CASE WHEN own IS NOT NULL THEN 'TABLE_EXPLICIT' WHEN a.cls IS NOT NULL THEN 'AUDIT_SOURCE_ASSERTION' WHEN g.cls IS NOT NULL THEN 'AUDIT_DUPLICATE_GROUP' WHEN r.ok THEN 'RAW_RECORD_ID' END AS method
FROM sin s LEFT JOIN aud a ON s.source_row % 3 <> 0 AND a.o_orderkey = s.source_row AND a.cls IS NOT NULL
LEFT JOIN (SELECT gid, min(cls) AS cls, min(species) AS species FROM aud WHERE cls IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (cls, species)) = 1) g ON g.gid = s.gid
LEFT JOIN rawid r ON s.source_database LIKE '%LAB_A%' AND r.record_id = s.rec"""
_S2 = """SELECT s.assertion_id, coalesce(s.cls, d.cls, n.cls, 'UNRESOLVED') AS species_class, coalesce(s.sp, d.sp, n.species, 'UNRESOLVED') AS species,
  coalesce(method, CASE WHEN d.cls IS NOT NULL THEN 'DUPLICATE_GROUP_UNANIMOUS' END, CASE WHEN n.cls IS NOT NULL THEN 'RAW_NAME_UNANIMOUS' END, '') AS species_method
FROM s1 s LEFT JOIN (SELECT gid, min(cls) AS cls, min(sp) AS sp FROM s1 WHERE cls IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (cls, sp)) = 1) d ON d.gid = s.gid AND s.cls IS NULL
LEFT JOIN rawnm n ON s.cls IS NULL AND d.cls IS NULL AND s.source_database LIKE '%LAB_A%' AND n.name_key = s.nm"""


def species(spark, sf):
    return Z.resolve_species(species_input(spark, sf), audit(spark, sf), raw_records(spark, sf), "LAB_A", "LAB", "ligandine", ["organism", "species"], ["taxon_id"])


@register("resolve_species", "SELECT assertion_id, species_class, species, species_method FROM s2", aud=_AUDIT, raw=_RAW, rawid=_RAWID, rawnm=_RAWNM, sin=_SIN, s1=_S1, s2=_S2)
def _(spark, sf):
    return species(spark, sf).select("assertion_id", "species_class", "species", "species_method")


@register("recover_relation", f"SELECT s.assertion_id, CASE WHEN relation = '=' THEN '=' WHEN a.op IS NOT NULL THEN a.op ELSE relation END AS relation_operator, CASE WHEN relation = '=' THEN 'TABLE_EXACT' WHEN a.op IS NOT NULL THEN 'AUDIT_SOURCE_ASSERTION' WHEN relation = 'BOUNDED' THEN 'TABLE_DIRECTION_UNKNOWN' ELSE 'TABLE' END AS relation_source, {relation_sql(chr(40) + 'CASE WHEN relation = chr(61) THEN chr(61) WHEN a.op IS NOT NULL THEN a.op ELSE relation END' + chr(41))} AS relation_class FROM sin s LEFT JOIN aud a ON s.source_row % 3 <> 0 AND a.o_orderkey = s.source_row AND a.op IS NOT NULL", aud=_AUDIT, sin=_SIN)
def _(spark, sf):
    rr = Z.recover_relation(species_input(spark, sf).select("assertion_id", "all_ids", "relation"), audit(spark, sf), ["relation_operator"])
    return rr.select("assertion_id", "relation_operator", "relation_source", "relation_class")


_SRC = "SELECT o_orderkey AS row_no, CASE o_orderkey % 6 WHEN 0 THEN '>' WHEN 1 THEN 'unknown' WHEN 2 THEN 'approx <5' ELSE '' END AS relation, CASE o_orderkey % 4 WHEN 0 THEN 'Ki > ' || o_custkey WHEN 1 THEN '<= ' || o_custkey WHEN 2 THEN CAST(o_custkey AS VARCHAR) ELSE '=' END AS value_text, o_orderpriority AS note FROM orders"
_DET = lambda t: f"(CASE WHEN regexp_matches({t}, '>\\s*=') THEN '>=' WHEN regexp_matches({t}, '<\\s*=') THEN '<=' WHEN regexp_matches({t}, '(^|[^A-Za-z])>\\s*[0-9.]') THEN '>' WHEN regexp_matches({t}, '(^|[^A-Za-z])<\\s*[0-9.]') THEN '<' ELSE '' END)"


def source_rows(spark, sf):
    k = C("o_orderkey")
    return B.table(spark, sf, "orders").select(
        k.alias("row_no"), F.when(k % 6 == 0, ">").when(k % 6 == 1, "unknown").when(k % 6 == 2, "approx <5").otherwise("").alias("relation"),
        F.when(k % 4 == 0, F.concat(F.lit("Ki > "), C("o_custkey").cast("string"))).when(k % 4 == 1, F.concat(F.lit("<= "), C("o_custkey").cast("string"))).when(k % 4 == 2, C("o_custkey").cast("string")).otherwise("=").alias("value_text"), C("o_orderpriority").alias("note"))


@register("source_record_relation", f"SELECT row_no, CASE WHEN relation = '>' THEN '>' WHEN {_DET('relation')} <> '' THEN {_DET('relation')} ELSE {_DET('value_text')} END AS source_relation, CASE WHEN relation = '>' THEN 'SOURCE_FIELD:relation' WHEN {_DET('relation')} <> '' THEN 'SOURCE_FIELD_TEXT:relation' WHEN {_DET('value_text')} <> '' THEN 'SOURCE_VALUE_TEXT:value_text' ELSE '' END AS source_relation_from FROM src", src=_SRC)
def _(spark, sf):
    return Z.source_record_relation(source_rows(spark, sf), ["relation"], ["value_text"]).select("row_no", "source_relation", "source_relation_from")


@register("explicit_marker", f"""SELECT row_no, CASE WHEN m1 = '' AND m2 = '' THEN '' WHEN m1 = '' THEN m2 WHEN m2 = '' THEN m1 WHEN (m1 LIKE '>%') <> (m2 LIKE '>%') THEN 'CONFLICT' WHEN m1 = '>=' OR m2 = '>=' THEN '>=' WHEN m1 = '<=' OR m2 = '<=' THEN '<=' ELSE m1 END AS explicit_marker FROM (SELECT row_no, {_DET('value_text')} AS m1, CASE WHEN {_DET('relation')} <> '' THEN {_DET('relation')} WHEN relation = '>' THEN '>' ELSE '' END AS m2 FROM src)""", src=_SRC)
def _(spark, sf):
    return Z.explicit_marker(source_rows(spark, sf), "value_text", ["relation"]).select("row_no", "explicit_marker")


@register("receptor_match", "SELECT DISTINCT matched_target, record_id, species FROM (SELECT DISTINCT target AS matched_target, 'REC' || (source_row % 60) AS k FROM assertion WHERE source_database LIKE '%LAB_A%') a JOIN raw r ON a.k = r.name_key WHERE contains(ligand, 'ligandine')", raw=_RAW.replace("'ligandine' END", "CASE WHEN s_suppkey % 5 = 0 THEN 's-ligandine' ELSE 'ligandine' END END").replace("WHERE contains(ligand, 'ligandine')", "")  # the enantiomer rows are filtered below
          .replace("FROM supplier WHERE s_suppkey % 7 = 0", "FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey % 5 <> 0").replace("ligand FROM supplier\n", "ligand FROM supplier WHERE s_suppkey % 5 <> 0\n"))
def _(spark, sf):
    raw = raw_records(spark, sf).withColumn("ligand", F.when((C("ligand") == "Ligandine") & (C("record_id").cast("int") % 5 == 0), "S-Ligandine").otherwise(C("ligand")))
    cl = species_input(spark, sf)
    out = Z.receptor_match(raw, cl, "target", ["original_target_name", "target_name"], "LAB_A", "ligandine", r"\b[sr][- ]ligandine")
    return out.select("matched_target", "record_id", F.when(C("species") == "Homo sapiens", "Homo sapiens").otherwise(C("species")).alias("species")).distinct()


@register("neighbor_rows", "SELECT row_no, note FROM src WHERE row_no IN (SELECT unnest([o_orderkey - 1, o_orderkey, o_orderkey + 1]) FROM orders WHERE o_totalprice > 400000)", src=_SRC)
def _(spark, sf):
    req = B.table(spark, sf, "orders").where("o_totalprice > 400000").select(C("o_orderkey").alias("requested_row"))
    return Z.neighbor_rows(source_rows(spark, sf), req, "row_no").select("row_no", "note")


@register("nearest_source_record", """SELECT request_id, row_no, CAST(score AS INTEGER) AS match_score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, abs(row_no - request_id), row_no) AS rk FROM (
  SELECT q.o_orderkey AS request_id, s.row_no, CASE WHEN contains(upper(relation || ' | ' || value_text || ' | ' || note), upper(q.o_orderpriority)) THEN 5 ELSE 0 END + CASE WHEN contains(upper(value_text), CAST(q.o_custkey AS VARCHAR)) OR contains(upper(relation || ' | ' || value_text || ' | ' || note), CAST(q.o_custkey AS VARCHAR)) THEN 3 ELSE 0 END AS score
  FROM orders q JOIN src s ON s.row_no BETWEEN q.o_orderkey - 1 AND q.o_orderkey + 1)) WHERE rk = 1""", src=_SRC)
def _(spark, sf):
    req = B.table(spark, sf, "orders").select(C("o_orderkey").alias("request_id"), C("o_orderkey").alias("requested_row"), C("o_orderpriority").alias("target"), C("o_custkey").cast("double").alias("expected_value"), F.lit("other").alias("source_database"))
    out = Z.nearest_source_record(req, source_rows(spark, sf), "row_no", ["relation", "value_text", "note"], "LAB")
    return out.select("request_id", "row_no", "match_score")


@register("expression_recovery", """SELECT r.target AS requested_id, r.gene_symbol AS requested_gene, CASE WHEN first_ok THEN 'RECOVERABLE_FROZEN_DICTIONARY' WHEN regexp_matches(r.gene_symbol, '[;|,]') THEN 'COMPOSITE_GENE_NOT_SPLIT' WHEN s.t IS NULL THEN 'GENE_NOT_FOUND_IN_SECOND_SOURCE'
  WHEN s.t = 25 AND s.clash = 0 AND s.spread THEN 'RECOVERABLE_SECOND_SOURCE' ELSE 'SECOND_SOURCE_INCOMPLETE_OR_CONFLICTING' END AS recovery_status
FROM req r LEFT JOIN (SELECT q.target, q.gene_symbol, count(*) = 25 AND count(DISTINCT d.tissue) = 25 AND count(d.z) = 25 AND max(abs(d.z - d.z0)) <= 1e-6 AS first_ok FROM req q
    JOIN dic d ON d.target = q.target OR (q.gene_symbol = d.gene_symbol AND q.target NOT IN (SELECT target FROM dic) AND q.gene_symbol IN (SELECT gene_symbol FROM dic GROUP BY 1 HAVING count(DISTINCT target) = 1)) GROUP BY 1, 2) f ON f.target = r.target AND f.gene_symbol = r.gene_symbol
LEFT JOIN (SELECT g, count(*) FILTER (lo = hi) AS t, count(*) FILTER (lo <> hi) AS clash, max(hi) > min(hi) AS spread FROM (SELECT gene_symbol AS g, tissue, min(raw) AS lo, max(raw) AS hi FROM dic2 GROUP BY 1, 2) GROUP BY 1) s ON s.g = upper(r.gene_symbol) AND NOT regexp_matches(r.gene_symbol, '[;|,]')""",
          req=_REQ, dic=_DIC.replace("raw, z, feature_order", "raw, CASE WHEN feature_order % 9000 = 6001 THEN z + 1 ELSE z END AS z, z AS z0, feature_order"), dic2="SELECT gene_symbol, tissue, raw FROM dic WHERE feature_order % 8000 <> 2103")
def _(spark, sf):
    d = dictionary(spark, sf).withColumn("z", F.when(C("feature_order") % 9000 == 6001, C("z") + 1).otherwise(C("z")))
    second = dictionary(spark, sf).where("feature_order % 8000 <> 2103").select("gene_symbol", "tissue", "raw")
    st, _ = Z.expression_recovery(requested(spark, sf), d.select("target", "gene_symbol", "tissue", "raw", "z"), second, 25, 1e-6)
    return st


@register("human_support_audit", """SELECT t.target, coalesce(n, 0) AS raw_rows, coalesce(h, 0) AS raw_human_rows, coalesce(o, 0) AS other_human_rows, CASE WHEN coalesce(h, 0) > 0 THEN 'RAW_EXPLICIT_HUMAN_SUPPORT' WHEN coalesce(o, 0) > 0 THEN 'OTHER_SOURCE_EXPLICIT_HUMAN_SUPPORT' WHEN basis = 'HUMAN_PRIORITY' THEN 'CONSENSUS_HUMAN_ONLY' ELSE 'NO_EXPLICIT_HUMAN_SUPPORT_FOUND' END AS human_support_status
FROM (SELECT DISTINCT target, CASE WHEN target LIKE '%SMALL' THEN 'HUMAN_PRIORITY' ELSE '' END AS basis FROM assertion) t
LEFT JOIN (SELECT matched_target, count(*) AS n, count(*) FILTER (species = 'Homo sapiens') AS h FROM (SELECT DISTINCT target AS matched_target, 'REC' || (source_row % 60) AS k FROM assertion WHERE source_database LIKE '%LAB_A%' AND target LIKE '%LARGE') a JOIN raw r ON a.k = r.name_key WHERE contains(ligand, 'ligandine') GROUP BY 1) m ON m.matched_target = t.target
LEFT JOIN (SELECT target, count(*) AS o FROM cleaned WHERE species_class = 'HUMAN' AND lane = 'MEASURED_NUMERICAL' AND source_database NOT LIKE '%LAB_A%' AND (target LIKE '%LARGE' OR target LIKE '%PROMO') GROUP BY 1) x ON x.target = t.target""", raw=_RAW)
def _(spark, sf):
    cl = B.cleaned(spark, sf).withColumn("species_method", F.when(C("target").endswith("LARGE") | C("target").endswith("PROMO"), "TABLE_EXPLICIT").otherwise("RAW_NAME_UNANIMOUS"))
    raw = Z.receptor_match(raw_records(spark, sf), species_input(spark, sf).where(C("target").endswith("LARGE")), "target", ["target_name"], "LAB_A", "ligandine", r"\b[sr][- ]ligandine")
    raw = raw.withColumn("value", C("record_id").cast("double")).withColumn("marker", F.lit(""))
    targets = B.assertions(spark, sf).select("target").distinct().withColumn("species_basis", F.when(C("target").endswith("SMALL"), "HUMAN_PRIORITY").otherwise(""))
    return U.human_support_audit(targets, raw, cl, "LAB_A").select("target", "raw_rows", "raw_human_rows", "other_human_rows", "human_support_status")
