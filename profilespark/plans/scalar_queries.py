"""Scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab as V
from . import bindings as B
from .register import r, register
from .views import molar_sql, relation_sql, species_class_sql, unit_sql

C = F.col

_FINITE = "CASE event_id % 6 WHEN 0 THEN CAST(value AS {s}) WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'n/a' WHEN 4 THEN ' 12.5 ' ELSE '' END"
_sql_finite = _FINITE.format(s="VARCHAR")


@register("to_finite", f"SELECT event_id, CASE WHEN isfinite(x) THEN x END AS x FROM (SELECT event_id, TRY_CAST({_sql_finite} AS DOUBLE) AS x FROM events)")
def _(spark, sf):
    return B.table(spark, sf, "events").select("event_id", S.to_finite(F.expr(_FINITE.format(s="STRING"))).alias("x"))


_TRUTHY = "CASE l_orderkey % 7 WHEN 0 THEN '1' WHEN 1 THEN ' True ' WHEN 2 THEN 'YES' WHEN 3 THEN 'y' WHEN 4 THEN 'no' WHEN 5 THEN '0' END"


@register("truthy", f"SELECT flag, count(*) AS n FROM (SELECT coalesce(lower(trim({_TRUTHY})) IN ('1','true','yes','y'), false) AS flag FROM lineitem) GROUP BY 1")
def _(spark, sf):
    return B.table(spark, sf, "lineitem").select(S.truthy(F.expr(_TRUTHY)).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


_NB = "CASE WHEN p_partkey % 4 = 0 THEN 'Unknown' WHEN p_partkey % 4 = 1 THEN '  ' ELSE p_name END"


@register("first_nonblank", f"SELECT p_brand, coalesce(arg_min(v, p_partkey), '') AS first_name FROM (SELECT p_brand, p_partkey, CASE WHEN trim({_NB}) <> '' AND upper(trim({_NB})) NOT IN ('NAN','NONE','NA','N/A','UNKNOWN','UNRESOLVED') THEN trim({_NB}) END AS v FROM part) WHERE v IS NOT NULL OR true GROUP BY 1")
def _(spark, sf):
    return B.table(spark, sf, "part").groupBy("p_brand").agg(S.first_nonblank(F.expr(_NB), C("p_partkey")).alias("first_name"))


@register("uniq_join", "SELECT p_brand, string_agg(v, ' | ' ORDER BY o) AS names FROM (SELECT p_brand, trim(p_name) AS v, min(p_partkey) AS o FROM part WHERE trim(p_name) <> '' GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    return S.uniq_join(B.table(spark, sf, "part"), ["p_brand"], "p_name", "p_partkey", "names")


_IDS = "concat(' A', CAST(l_orderkey AS {s}), ' | |B', CAST(l_partkey AS {s}), '|')"


@register("split_ids", f"SELECT ids, count(*) AS n FROM (SELECT list_filter(list_transform(string_split({_IDS.format(s='VARCHAR')}, '|'), lambda x: trim(x)), lambda x: x <> '') AS ids FROM lineitem) GROUP BY 1".replace("SELECT ids,", "SELECT array_to_string(ids, ',') AS ids,").replace("GROUP BY 1", "GROUP BY ALL"))
def _(spark, sf):
    ids = S.split_ids(F.expr(_IDS.format(s="STRING")))
    return B.table(spark, sf, "lineitem").select(F.array_join(ids, ",").alias("ids")).groupBy("ids").agg(F.count(F.lit(1)).alias("n"))


_ROWS = "concat(CAST(l_partkey AS {s}), '.0; ', CAST(l_suppkey AS {s}), '|x,', CAST(l_linenumber AS {s}))"


@register("parse_row_list", f"SELECT rows_text, count(*) AS n FROM (SELECT array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(trim({_ROWS.format(s='VARCHAR')}), '[|,; ]+'), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x IS NOT NULL), lambda x: CAST(x AS BIGINT)), ',') AS rows_text FROM lineitem) GROUP BY 1")
def _(spark, sf):
    rows = S.parse_row_list(F.expr(_ROWS.format(s="STRING")))
    return B.table(spark, sf, "lineitem").select(F.array_join(rows.cast("array<string>"), ",").alias("rows_text")).groupBy("rows_text").agg(F.count(F.lit(1)).alias("n"))


@register("canonical_key", "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS k, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) AS ku FROM documents")
def _(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(S.canonical_key(C("text"))).alias("k"), F.md5(S.canonical_key_unicode(C("text"))).alias("ku"))


@register("upper_key", "SELECT c_custkey, regexp_replace(upper(trim(c_name)), '[^A-Z0-9]+', '', 'g') AS k, replace(upper(trim(c_mktsegment || ' x')), ' ', '') AS g FROM customer")
def _(spark, sf):
    return B.table(spark, sf, "customer").select("c_custkey", S.upper_key(C("c_name")).alias("k"), S.upper_key(F.concat("c_mktsegment", F.lit(" x")), spaces_only=True).alias("g"))


@register("compound_name_key", "SELECT page_id, regexp_replace(trim(lower(replace(replace(replace(url, '–', '-'), '—', '-'), '−', '-'))), '\\s+', ' ', 'g') AS k FROM pages")
def _(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", S.compound_name_key(C("url")).alias("k"))


@register("slug", "SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS s, CASE WHEN l = '' THEN 'compound' ELSE l END AS l FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s, lower(regexp_replace(regexp_replace(trim(CASE WHEN page_id % 9 = 0 THEN '--' ELSE url END), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS l FROM pages)")
def _(spark, sf):
    odd = F.when(C("page_id") % 9 == 0, "--").otherwise(C("url"))
    return B.table(spark, sf, "pages").select("page_id", S.slug(C("url")).alias("s"), S.slug(odd, lower=True, empty="compound").alias("l"))


_UNITS = "CASE l_linenumber WHEN 1 THEN 'nM' WHEN 2 THEN 'µM' WHEN 3 THEN 'μ M' WHEN 4 THEN 'Molar' WHEN 5 THEN 'mol/L' WHEN 6 THEN 'pMolar' ELSE 'kg' END"
_VAL = "CASE WHEN l_orderkey % 10 = 0 THEN -1.0 ELSE l_quantity END"


@register("normalize_unit", f"SELECT unit, count(*) AS n FROM (SELECT {unit_sql(_UNITS)} AS unit FROM lineitem) GROUP BY 1")
def _(spark, sf):
    return B.table(spark, sf, "lineitem").select(S.normalize_unit(F.expr(_UNITS)).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


_act = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST({_VAL} AS DOUBLE) AS x, {_UNITS} AS u FROM lineitem"


@register("to_molar", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(m * 1e12, 3) AS pm FROM (SELECT *, {molar_sql('x', 'u')} AS m FROM act)", act=_act)
def _(spark, sf):
    m = S.to_molar(F.expr(_VAL).cast("double"), F.expr(_UNITS))
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(m * 1e12, 3).alias("pm"))


@register("pactivity", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(-log10(m), 6) AS p FROM (SELECT *, {molar_sql('x', 'u')} AS m FROM act)", act=_act)
def _(spark, sf):
    p = S.pactivity(F.expr(_VAL).cast("double"), F.expr(_UNITS))
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(p, 6).alias("p"))


_RELS = "CASE (l_orderkey + l_linenumber) % 12 WHEN 0 THEN '=' WHEN 1 THEN ' eq' WHEN 2 THEN 'Exact' WHEN 3 THEN '>' WHEN 4 THEN '>=' WHEN 5 THEN 'gte' WHEN 6 THEN '<' WHEN 7 THEN 'LE' WHEN 8 THEN 'bounded' WHEN 9 THEN '~' WHEN 10 THEN '' END"


@register("relation_class", f"SELECT cls, count(*) AS n FROM (SELECT {relation_sql(_RELS)} AS cls FROM lineitem) GROUP BY 1")
def _(spark, sf):
    return B.table(spark, sf, "lineitem").select(S.relation_class(F.expr(_RELS)).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


_TXT = "CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN concat('Ki >', CAST(l_partkey AS {s})) WHEN 1 THEN concat('>', CAST(l_partkey AS {s}), ' nM') WHEN 2 THEN concat('value > = ', CAST(l_partkey AS {s})) WHEN 3 THEN concat('1,', CAST(l_partkey AS {s}), '.5e1') WHEN 4 THEN concat('K< ', CAST(l_partkey AS {s})) WHEN 5 THEN concat(' <.', CAST(l_partkey AS {s})) WHEN 6 THEN concat('approx -', CAST(l_partkey AS {s}), '.25 <= x') ELSE 'none' END"
_txt_sql = _TXT.format(s="VARCHAR")


@register("detect_relation_in_text", f"SELECT t, op, count(*) AS n FROM (SELECT t, CASE WHEN regexp_matches(t, '>\\s*=') THEN '>=' WHEN regexp_matches(t, '<\\s*=') THEN '<=' WHEN regexp_matches(t, '(^|[^A-Za-z])>\\s*[0-9.]') THEN '>' WHEN regexp_matches(t, '(^|[^A-Za-z])<\\s*[0-9.]') THEN '<' ELSE '' END AS op FROM (SELECT trim({_txt_sql}) AS t FROM lineitem)) GROUP BY ALL")
def _(spark, sf):
    t = B.table(spark, sf, "lineitem").select(F.trim(F.expr(_TXT.format(s="STRING"))).alias("t"))
    return t.select("t", S.detect_relation_in_text(C("t")).alias("op")).groupBy("t", "op").agg(F.count(F.lit(1)).alias("n"))


@register("parse_number_in_text", f"SELECT t, x, count(*) AS n FROM (SELECT t, TRY_CAST(nullif(regexp_extract(replace(t, ',', ''), '[-+]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?'), '') AS DOUBLE) AS x FROM (SELECT trim({_txt_sql}) AS t FROM lineitem)) GROUP BY ALL")
def _(spark, sf):
    t = B.table(spark, sf, "lineitem").select(F.trim(F.expr(_TXT.format(s="STRING"))).alias("t"))
    return t.select("t", S.parse_number_in_text(C("t")).alias("x")).groupBy("t", "x").agg(F.count(F.lit(1)).alias("n"))


@register("extract_record_id", "SELECT assay_id, regexp_extract(assay_id, 'LAB Ki_([0-9]+)', 1) AS record_id, count(*) AS n FROM assertion GROUP BY ALL")
def _(spark, sf):
    a = B.assertions(spark, sf).groupBy("assay_id").agg(F.count(F.lit(1)).alias("n"))
    return a.select("assay_id", S.extract_record_id(C("assay_id"), "LAB").alias("record_id"), "n")


_SPN = ["human", "Homo sapiens cells", "RAT", "Mus musculus", "Sprague-Dawley rat", "crate", "zebrafish", "E. coli K12", "stingray", "", "plant", "Bos taurus"]
_SPE = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_SPN)) + " END"
_STX = "CASE WHEN p_size % 9 = 0 THEN 9606.0 WHEN p_size % 9 = 1 THEN 10116.0 WHEN p_size % 9 = 2 THEN 7955.0 END"


@register("classify_species", f"SELECT p_partkey, cls, CASE WHEN cls = 'HUMAN' THEN 'Homo sapiens' WHEN cls = 'UNRESOLVED' THEN 'UNRESOLVED' WHEN nm <> '' THEN nm ELSE 'taxon:' || CAST(CAST(tx AS BIGINT) AS VARCHAR) END AS species FROM (SELECT *, {species_class_sql('nm', 'tx')} AS cls FROM (SELECT p_partkey, {_SPE} AS nm, CAST({_STX} AS DOUBLE) AS tx FROM part))")
def _(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", F.expr(_SPE).alias("nm"), F.expr(_STX).cast("double").alias("tx"))
    out = S.classify_species(p, "nm", "tx", "s_")
    return out.select("p_partkey", C("s_class").alias("cls"), C("s_species").alias("species"))


@register("normalize_activity", f"SELECT assertion_id, upper(replace(unit_original, 'µ', 'u')) AS unit, relation_class, relation_class <> 'EXACT' AS is_bounded, round({molar_sql('value_original', 'unit_original')} * 1e12, 3) AS pm, round(-log10({molar_sql('value_original', 'unit_original')}), 6) AS p, 'MEASURED' AS measured FROM cleaned")
def _(spark, sf):
    a = B.assertions(spark, sf)
    n = S.normalize_activity(C("value_original"), C("unit_original"), C("relation"), F.lit("MEASURED"), F.lit("OBSERVED"))
    return a.select("assertion_id", n.alias("n")).select(
        "assertion_id", C("n.reported_unit").alias("unit"), C("n.relation_class").alias("relation_class"), C("n.is_bounded").alias("is_bounded"),
        F.round(C("n.molar") * 1e12, 3).alias("pm"), F.round("n.pactivity", 6).alias("p"), C("n.measured_or_modeled").alias("measured"))


@register("working_pactivity", "SELECT assertion_id, round(pactivity, 6) AS pactivity, round(molar * 1e12, 3) AS pm, value_origin, invalid_boundary FROM cleaned")
def _(spark, sf):
    return B.cleaned(spark, sf).select("assertion_id", r("pactivity"), F.round(C("molar") * 1e12, 3).alias("pm"), "value_origin", "invalid_boundary")


@register("activity_lane", "SELECT lane, activity_type, count(*) AS n FROM cleaned GROUP BY ALL")
def _(spark, sf):
    return B.cleaned(spark, sf).groupBy("lane", "activity_type").agg(F.count(F.lit(1)).alias("n"))


@register("is_exact_target", "SELECT target_status, target_grain, (target_status = 'MAPPED_EXACT_TARGET' AND target_grain = 'EXACT_SINGLE_PROTEIN') AS exact, count(*) AS n FROM assertion GROUP BY ALL")
def _(spark, sf):
    ex = S.is_exact_target(C("target"), C("target_status"), C("target_grain"))
    return B.assertions(spark, sf).select("target_status", "target_grain", ex.alias("exact")).groupBy("target_status", "target_grain", "exact").agg(F.count(F.lit(1)).alias("n"))


_INV = "CASE relation_class WHEN 'EXACT' THEN '=' WHEN 'GT_BOUND' THEN '<' WHEN 'LT_BOUND' THEN '>' ELSE '?' END"


@register("invert_relation", f"SELECT relation_class, {_INV} AS p_relation, count(*) AS n FROM cleaned GROUP BY ALL")
def _(spark, sf):
    return B.cleaned(spark, sf).groupBy("relation_class").agg(F.count(F.lit(1)).alias("n")).select("relation_class", S.invert_relation(C("relation_class")).alias("p_relation"), "n")


_BOUND = f"""SELECT *, CASE WHEN z IS NULL THEN '?' WHEN pr = '=' OR abs(z) <= 1e-15 THEN '=' WHEN pr = '?' THEN '?' WHEN z > 0 THEN pr WHEN pr = '<' THEN '>' ELSE '<' END AS rel,
  CASE WHEN z IS NULL THEN 'MISSING_EXPRESSION' WHEN pr = '=' THEN 'EXACT' WHEN abs(z) <= 1e-15 THEN 'EXACT_ZERO_FROM_EXPRESSION_Z_ZERO' WHEN pr = '?' THEN 'RELATION_UNRESOLVED'
    WHEN (pr = '<') = (z > 0) THEN 'BOUNDED_UPPER' ELSE 'BOUNDED_LOWER' END AS status FROM (SELECT *, {_INV} AS pr FROM profiles)"""


@register("propagate_bound", "SELECT profile, feature_id, rel, status FROM bound", bound=_BOUND)
def _(spark, sf):
    p = B.profiles(spark, sf).withColumn("b", S.propagate_bound(S.invert_relation(C("relation_class")), C("z")))
    return p.select("profile", "feature_id", C("b.relation").alias("rel"), C("b.status").alias("status"))


@register("bound_interpretation", "SELECT profile, feature_id, CASE WHEN status = 'EXACT' THEN 'HR exact conditional on selected activity and expression Z.' WHEN status LIKE 'EXACT_ZERO%' THEN 'HR equals zero because expression Z equals zero.' WHEN status LIKE 'BOUNDED%' THEN 'HR ' || rel || ' ' || format('{:.6g}', score) || '; numeric value is a boundary, not an exact HR score.' ELSE 'HR relation unresolved.' END AS interpretation FROM bound", bound=_BOUND)
def _(spark, sf):
    p = B.profiles(spark, sf).withColumn("b", S.propagate_bound(S.invert_relation(C("relation_class")), C("z")))
    return p.select("profile", "feature_id", S.bound_interpretation(C("b.status"), C("b.relation"), C("score"), 6).alias("interpretation"))


def _poly_sql(coeffs, x):
    acc = f"CAST({coeffs[-1]!r} AS DOUBLE)"
    for k in reversed(coeffs[:-1]):
        acc = f"({acc} * {x} + CAST({k!r} AS DOUBLE))"
    return acc


def ppf_sql(p):
    """The same published polynomials over a clipped column; ``p`` is an expression."""
    a = S._AS241
    return f"""(SELECT CASE WHEN abs(q) <= 0.425 THEN q * {_poly_sql(a['a'], '(0.180625 - q * q)')} / {_poly_sql(a['b'], '(0.180625 - q * q)')}
      ELSE sign(q) * CASE WHEN s <= 5 THEN {_poly_sql(a['c'], '(s - 1.6)')} / {_poly_sql(a['d'], '(s - 1.6)')} ELSE {_poly_sql(a['e'], '(s - 5)')} / {_poly_sql(a['f'], '(s - 5)')} END END
      FROM (SELECT pc - 0.5 AS q, sqrt(-ln(CASE WHEN pc < 0.5 THEN pc ELSE 1 - pc END)) AS s FROM (SELECT greatest(least({p}, 1 - 1e-6), 1e-6)::DOUBLE AS pc)))"""


@register("norm_ppf", f"SELECT o_orderkey, round({ppf_sql('p')}, 6) AS z FROM (SELECT o_orderkey, o_totalprice / 500000.0::DOUBLE AS p FROM orders)")
def _(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", F.round(S.norm_ppf(C("o_totalprice") / 500000.0), 6).alias("z"))


@register("gesd_critical", "SELECT n, alpha, round(lam, 6) AS lam FROM (SELECT count(value) AS n FROM vectors GROUP BY profile) v JOIN lambda_narrow USING (n)")
def _(spark, sf):
    from ..functions.student import gesd_critical

    n = B.vectors(spark, sf).groupBy("profile").agg(F.count("value").alias("n"))
    lv = n.select("n", F.explode(F.array(*[F.lit(a) for a in V.ALPHAS])).alias("alpha"))
    return lv.select("n", "alpha", F.round(gesd_critical("n", "alpha"), 6).alias("lam"))


_SCORE = "CASE WHEN l_linenumber = 7 THEN -999 ELSE CASE WHEN contains(t, upper(p_type)) THEN 5 ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 AND contains(t, 'LAB') THEN 3 ELSE 0 END + CASE WHEN contains(t, format('{:.6g}', l_quantity)) THEN 3 ELSE 0 END END"


@register("record_match_score", f"SELECT score, count(*) AS n FROM (SELECT {_SCORE} AS score FROM (SELECT *, upper(p_name || ' | ' || p_type || CAST(p_size AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN 'lab' ELSE '' END) AS t FROM lineitem JOIN part ON l_partkey = p_partkey)) GROUP BY 1")
def _(spark, sf):
    j = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part"), C("l_partkey") == C("p_partkey"))
    gone = C("l_linenumber") == 7
    f1 = F.when(~gone, C("p_name"))
    f2 = F.when(~gone, F.concat("p_type", C("p_size").cast("string"), F.when(C("p_size") % 2 == 0, "lab").otherwise("")))
    src = F.when(C("l_suppkey") % 2 == 0, "lab_a").otherwise("other")
    score = S.record_match_score([f1, f2], C("p_type"), C("l_quantity"), src, "LAB")
    return j.select(score.alias("score")).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


_LABELS = [("nation5", "Nation Five"), ("nation7", "Nation Seven"), ("nation10", "Nation Ten")]


@register("display_label", "SELECT n_nationkey, coalesce(l.label, trim(n_name)) AS label, CASE WHEN d.label IS NOT NULL THEN dk ELSE k END AS pair_key, coalesce(d.label, l.label, trim(disp)) AS pair_label FROM (SELECT *, regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') AS k, regexp_replace(lower(disp), '[^a-z0-9]+', '', 'g') AS dk FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation-' || (n_nationkey + 1) ELSE 'shown ' || n_nationkey END AS disp FROM nation)) LEFT JOIN labels_t l ON k = l.key LEFT JOIN labels_t d ON dk = d.key",
          labels_t="SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _LABELS) + ") t(key, label)")
def _(spark, sf):
    from ..operators.resolve import display_label

    lab = spark.createDataFrame(_LABELS, "key string, label string")
    n = B.table(spark, sf, "nation").withColumn("disp", F.when(C("n_nationkey") % 2 == 0, F.concat(F.lit("Nation-"), (C("n_nationkey") + 1).cast("string"))).otherwise(F.concat(F.lit("shown "), C("n_nationkey").cast("string"))))
    one = display_label(n, lab, "n_name").select("n_nationkey", "disp", "n_name", "label")
    two = display_label(one.withColumnRenamed("label", "label1"), lab, "n_name", "disp")
    return two.select("n_nationkey", C("label1").alias("label"), C("tissue_key").alias("pair_key"), C("label").alias("pair_label"))
