"""Queries read their large inputs once, and rows that share a key are answered by their own fields."""

from pyspark.sql import functions as F

from profilespark.operators import activity, curation, quality, resolve
from profilespark.plans import bindings, curation_queries, registry

ASSERTION = "assertion_id string, all_ids string, duplicate_group_id string, source_database string, assay_id string, species_reported string, taxon_reported double, target_organism string, assay_organism string, original_target_name string, target_name string, gene_symbol string, target string, relation string"


def _assertions(spark, rows):
    return spark.createDataFrame([(k, ids, "", "LAB_B", "", species, None, "", "", "", "", "", "", rel) for k, ids, species, rel in rows], ASSERTION)


def test_species_of_rows_that_share_a_key(spark):
    rows = _assertions(spark, [("k", "a1", "", "="), ("k", "a2", "", "="), ("k", "", "Homo sapiens", "="), ("k", "", "", "=")])
    audit = spark.createDataFrame([("a1", "", "mouse"), ("a2", "", "human")], "source_assertion_id string, duplicate_group_id string, organism string")
    raw = spark.createDataFrame([], "record_id string, species string, receptor string, ligand string")
    audit = audit.withColumn("taxon", F.lit(None).cast("double"))
    got = resolve.resolve_species(rows, audit, raw, "LAB_A", "LAB", "lig", ["organism"], ["taxon"])
    assert sorted((r.all_ids, r.species_class, r.species_method) for r in got.collect()) == [
        ("", "HUMAN", "TABLE_EXPLICIT"), ("", "UNRESOLVED", ""), ("a1", "MAMMALIAN_NONHUMAN", "AUDIT_SOURCE_ASSERTION"), ("a2", "HUMAN", "AUDIT_SOURCE_ASSERTION")]


def test_relation_of_rows_that_share_a_key(spark):
    rows = _assertions(spark, [("k", "a1", "", "BOUNDED"), ("k", "a2", "", "BOUNDED"), ("k", "a1", "", "="), ("k", "", "", "<"), (None, "a1", "", None)])
    audit = spark.createDataFrame([("a1", ">"), ("a2", "<")], "source_assertion_id string, relation_operator string")
    got = resolve.recover_relation(rows, audit, ["relation_operator"])
    assert sorted((r.all_ids, r.relation or "", r.relation_operator, r.relation_source) for r in got.collect()) == [
        ("", "<", "<", "TABLE"), ("a1", "", ">", "AUDIT_SOURCE_ASSERTION"), ("a1", "=", "=", "TABLE_EXACT"), ("a1", "BOUNDED", ">", "AUDIT_SOURCE_ASSERTION"), ("a2", "BOUNDED", "<", "AUDIT_SOURCE_ASSERTION")]


def test_call_count_regression_makes_its_pairs_once(spark):
    def made(batches):
        yield from batches

    pairs = spark.createDataFrame([(1, 2, 3, 0), (1, 3, 3, 4), (2, 3, 1, 4)], "a int, b int, call_count_a int, call_count_b int")
    calls = spark.createDataFrame([(1,)] * 3 + [(3,)] * 4, "profile int")
    got = quality.call_count_regression(pairs.mapInArrow(made, pairs.schema), calls)
    assert sorted((r.profile, r.pair_min, r.pair_max, r.called, r.status) for r in got.collect()) == [(1, 3, 3, 3, "PASS"), (2, 0, 1, 0, "FAIL"), (3, 4, 4, 4, "PASS")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_call_matrix_counts_makes_its_panel_once(spark, sf, monkeypatch):
    made, real = [], bindings.expression
    monkeypatch.setattr(bindings, "expression", lambda *a: made.append(a) or real(*a))
    assert registry.queries()["call_matrix_counts"](spark, sf).columns and len(made) == 1


def test_summary_joins_the_line_items_once(spark, sf, monkeypatch):
    plans = []
    for module in (curation, curation_queries, activity):
        real = getattr(module, "cut", None)
        if real is not None:
            monkeypatch.setattr(module, "cut", lambda df, real=real: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    registry.queries()["readiness_tier"](spark, sf)
    assert sum("l_orderkey" in p for p in plans) == 1
