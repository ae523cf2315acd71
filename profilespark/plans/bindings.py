"""The operators' input tables derived from the given tables (star schema, vectors, texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import activity as A
from ..operators import outliers as O
from ..operators import scores as X
from ..session import cut

SELECT_COLS = ["assertion_id", "activity_type", "relation_class", "relation_operator", "pactivity", "molar", "species",
               "source_database", "value_original", "unit_original"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table; one whose files split into fewer tasks than there are cores is spread out (never so at scale)."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("lineitem", "embeddings", "documents", "events") and df.rdd.getNumPartitions() < min(cores, 8):
        return df.repartition(cores)
    return df


def brand_no(c: str = "p_brand") -> Column:
    return F.regexp_extract(F.col(c), "([0-9]+)", 1).cast("int")


def type_no() -> Column:
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("p_type")), F.lit(9))


def target() -> Column:
    return F.concat_ws(":", "p_brand", "p_type")


def assertions(spark: SparkSession, sf: str) -> DataFrame:
    """One raw assertion per line item: value, unit, relation, endpoint, species and identifiers."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    orders, cust, supp = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "supplier")
    j = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(orders, li.l_orderkey == orders.o_orderkey)
        .join(cust, orders.o_custkey == cust.c_custkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
    )
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"),
                      F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long"))
    kind = F.element_at(F.array(*[F.lit(x) for x in (
        "BINDING_KI", "BINDING_KD", "INHIBITION_IC50", "ACTIVATION_EC50", "FUNCTIONAL_AC50", "OTHER_QUANTITATIVE_POTENCY",
        "ASSIGNED_SCENARIO")]), F.col("l_linenumber"))
    unit = F.when(F.col("l_linenumber") % 5 == 3, "µM").when(F.col("l_linenumber") % 5 == 4, "pM").otherwise("nM")
    rel = F.when(F.col("l_returnflag") == "A", "=").when(F.col("l_returnflag") == "N", "<").when(F.col("l_linestatus") == "F", ">").otherwise("BOUNDED")
    sp = F.col("s_nationkey") % 4
    strength = F.col("l_quantity") * (F.col("l_suppkey") + 1)
    return j.select(
        F.concat_ws("/", "o_orderpriority", "c_mktsegment").alias("profile"),
        key.alias("assertion_id"),
        target().alias("target"),
        F.concat(F.lit("GENE"), brand_no().cast("string"), F.substring("p_type", 1, 2)).alias("gene_symbol"),
        F.col("p_name").alias("target_name"),
        F.when(F.col("l_partkey") % 11 == 0, "FAMILY_GENERIC").when(F.col("l_partkey") % 11 == 1, "UNRESOLVED").otherwise("EXACT_SINGLE_PROTEIN").alias("target_grain"),
        F.when(F.col("l_partkey") % 11 == 1, "UNRESOLVED_TARGET").otherwise("MAPPED_EXACT_TARGET").alias("target_status"),
        kind.alias("activity_type"),
        F.when(F.col("l_suppkey") % 7 == 0, "MODELED").otherwise("MEASURED").alias("activity_origin"),
        rel.alias("relation"),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit(4.0) + F.col("l_quantity") / 16).alias("supplied_p"),
        F.when(F.col("l_orderkey") % 3 == 0, strength * 1e-9).alias("std_value"),
        F.when(F.col("l_orderkey") % 3 == 0, "M").alias("std_unit"),
        F.when(F.col("l_orderkey") % 17 == 0, 0.0).otherwise(strength).alias("value_original"),
        unit.alias("unit_original"),
        F.when(sp == 0, "Homo sapiens").when(sp == 1, "Rattus norvegicus").when(sp == 2, "zebrafish").otherwise("").alias("species_reported"),
        F.when(F.col("s_nationkey") % 8 == 0, 9606.0).alias("taxon_reported"),
        F.when(F.col("l_linestatus") == "F", "mouse").alias("target_organism"),
        F.element_at(F.array(F.lit("LAB_A"), F.lit("LAB_B"), F.lit("LAB_C")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("source_database"),
        F.concat(F.lit("LAB Ki_"), F.col("s_suppkey").cast("string"), F.lit(".0 assay")).alias("assay_id"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("duplicate_group_id"),
        F.col("l_orderkey").alias("source_row"),
    )


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Assertions with class of relation, species, lane and the working pActivity."""
    work = S.working_pactivity(F.col("supplied_p"), F.col("std_value"), F.col("std_unit"), F.col("value_original"), F.col("unit_original"))
    none = F.lit(None).cast("double")
    staged = assertions(spark, sf).withColumns({
        "_c1": S.species_class(F.col("species_reported"), F.col("taxon_reported")),
        "_c2": S.species_class(F.col("target_organism"), none),
        "relation_class": S.relation_class(F.col("relation")),
        "pactivity": work["pactivity"], "molar": work["molar"], "value_origin": work["origin"], "invalid_boundary": work["invalid"],
    })
    own = F.col("_c1") != "UNRESOLVED"
    return staged.withColumns({
        "species_class": F.when(own, F.col("_c1")).otherwise(F.col("_c2")),
        "species": F.when(own, S.species_name(F.col("species_reported"), F.col("taxon_reported"), F.col("_c1"))).otherwise(
            S.species_name(F.col("target_organism"), none, F.col("_c2"))),
        "relation_operator": F.col("relation"),
        "lane": S.activity_lane(F.col("activity_type"), F.col("activity_origin"), F.col("pactivity")),
    }).drop("_c1", "_c2")


def eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Measured numeric assertions on exact targets."""
    return cleaned(spark, sf).where(
        S.is_exact_target(F.col("target"), F.col("target_status"), F.col("target_grain")) & (F.col("lane") == "MEASURED_NUMERICAL")
    )


def selection(spark: SparkSession, sf: str, cols: list[str] = SELECT_COLS) -> DataFrame:
    return A.select_activity(eligible(spark, sf), ["profile", "target"], cols)


def expression(spark: SparkSession, sf: str) -> DataFrame:
    """Target x nation panel of summed quantities, a fixed share of the cells raised sixfold so that outliers exist."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    orders, cust, nat = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    j = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(orders, li.l_orderkey == orders.o_orderkey)
        .join(cust, orders.o_custkey == cust.c_custkey)
        .join(nat, cust.c_nationkey == nat.n_nationkey)
    )
    raised = (F.col("n_nationkey") * 7 + F.col("brand") * 3 + F.length("p_type")) % 43 == 0
    cells = (
        j.select("p_brand", "p_type", brand_no().alias("brand"), type_no().alias("type_no"), "n_name", "n_nationkey", "l_quantity")
        .groupBy("p_brand", "p_type", "brand", "type_no", "n_name", "n_nationkey")
        .agg(F.sum("l_quantity").alias("q"))
    )
    return cells.select(
        target().alias("target"),
        F.concat(F.lit("GENE"), F.col("brand").cast("string"), F.substring("p_type", 1, 2)).alias("gene_symbol"),
        F.col("n_name").alias("tissue"),
        (F.col("brand") * 1000 + F.col("type_no") * 100 + F.col("n_nationkey")).cast("long").alias("feature_order"),
        (F.col("q") * F.when(raised, 6.0).otherwise(1.0)).alias("raw"),
    )


def expression_z(spark: SparkSession, sf: str) -> DataFrame:
    return X.zscore_within(expression(spark, sf), "target", "raw", "z")


def contract(spark: SparkSession, sf: str, e: DataFrame | None = None) -> DataFrame:
    return (expression(spark, sf) if e is None else e).select("feature_order", X.feature_id(F.col("target"), F.col("tissue")).alias("feature_id"), "target", "tissue")


def written_scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The score table and the expression panel it is made of, each written once."""
    e = cut(expression(spark, sf))
    return cut(profiles(spark, sf, X.zscore_within(e, "target", "raw", "z"))), e


def written_profiles(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The score table, written once for queries that read it several times, and the number of cells of its contract."""
    p, e = written_scores(spark, sf)
    return p, e.count()


def profiles(spark: SparkSession, sf: str, z: DataFrame | None = None) -> DataFrame:
    """Long score table: profile x (target, tissue)."""
    scored = X.score_join(selection(spark, sf, ["pactivity", "relation_class"]), expression_z(spark, sf) if z is None else z, "target", "tissue", "pactivity", "z", ("profile",), ("relation_class",))
    return scored.select("profile", "feature_id", "feature_order", "target", "tissue", "pactivity", "z", "relation_class", "score")


def profile_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Outlier steps of the score profiles; the scores are written once, since sizing and walking both read them."""
    return O.gesd_steps(cut(profiles(spark, sf)), "profile", "score", "feature_order")


def profile_calls(spark: SparkSession, sf: str) -> DataFrame:
    return O.gesd_calls(cut(profiles(spark, sf)), "profile", "score", "feature_order")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding cells as profiles: a fifth of the cells is unsupported, a fixed share is raised."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    gone = (F.col("vec_id") * 7 + F.col("pos") * 3) % 5 == 0
    raised = (F.col("vec_id") * 7 + F.col("pos") * 3) % 43 == 0
    x = F.col("x").cast("double")
    return v.select(
        F.col("vec_id").alias("profile"), F.col("label"), F.col("pos").cast("long").alias("feature_order"),
        F.format_string("f%02d", F.col("pos")).alias("feature_id"),
        F.concat(F.lit("t"), F.floor(F.col("pos") / 8).cast("string")).alias("target"),
        F.concat(F.lit("u"), (F.col("pos") % 8).cast("string")).alias("tissue"),
        F.when(~gone, x * F.when(raised, 6.0).otherwise(1.0)).alias("value"),
    )


def vector_contract(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("feature_order", "feature_id", "target", "tissue").distinct()


def vector_roster(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("profile"), F.col("vec_id").alias("roster_order"))


def vector_calls(spark: SparkSession, sf: str) -> DataFrame:
    return O.gesd_calls(vectors(spark, sf), "profile", "value", "feature_order")


def vector_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Membership, many to many: the label, and a second class for every third vector."""
    e = table(spark, sf, "embeddings")
    a = e.select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("class_id"), F.col("vec_id").alias("profile"))
    b = e.where("vec_id % 3 = 0").select(F.concat(F.lit("M"), (F.col("vec_id") % 4).cast("string")).alias("class_id"), F.col("vec_id").alias("profile"))
    both = a.unionByName(b)
    return both.select("class_id", F.concat(F.lit("Class "), "class_id").alias("class_label"), "profile")
