"""DuckDB twins of the bindings, as named common table expressions that oracle queries pull in by name."""

from __future__ import annotations

import re

from ..functions import vocab as V

_species = lambda name, taxon: f"""
  CASE WHEN {taxon} = 9606 THEN 'HUMAN'
       WHEN {taxon} IN ({', '.join(str(t) for t in V.MAMMAL_TAXA if t != V.HUMAN_TAXON)}) THEN 'MAMMALIAN_NONHUMAN'
       WHEN lower(trim(coalesce({name}, ''))) IN ({', '.join(repr(n) for n, t in V.TAXON_BY_NAME.items() if t == V.HUMAN_TAXON)}) THEN 'HUMAN'
       WHEN lower(trim(coalesce({name}, ''))) IN ({', '.join(repr(n) for n, t in V.TAXON_BY_NAME.items() if t in V.MAMMAL_TAXA)}) THEN 'MAMMALIAN_NONHUMAN'
       WHEN lower(trim(coalesce({name}, ''))) IN ({', '.join(repr(n) for n, t in V.TAXON_BY_NAME.items() if t not in V.MAMMAL_TAXA)}) THEN 'NON_MAMMALIAN'
       WHEN regexp_matches(lower(coalesce({name}, '')), 'human|homo sapiens') THEN 'HUMAN'
       WHEN regexp_matches(lower(coalesce({name}, '')), '{'|'.join(re.escape(w).replace(chr(92) + ' ', ' ') for w in V.MAMMAL_TOKENS)}') THEN 'MAMMALIAN_NONHUMAN'
       WHEN regexp_matches(lower(coalesce({name}, '')), '{'|'.join(re.escape(w).replace(chr(92) + ' ', ' ') for w in V.OTHER_TOKENS)}') THEN 'NON_MAMMALIAN'
       ELSE 'UNRESOLVED' END"""

species_class_sql = _species


def unit_sql(u: str) -> str:
    t = f"replace(upper(replace(replace(trim(coalesce({u}, '')), 'μ', 'u'), 'µ', 'u')), ' ', '')"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.UNIT_ALIASES.items())
    return f"(CASE {t} {whens} ELSE {t} END)"


def molar_sql(x: str, u: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in V.UNIT_TO_MOLAR.items())
    return f"(CASE WHEN {x} > 0 THEN {x} * (CASE {unit_sql(u)} {whens} END) END)"


def relation_sql(r: str) -> str:
    def words(ws):
        return ", ".join(f"'{w}'" for w in ws)
    return (f"(CASE WHEN upper(trim(coalesce({r},''))) IN ({words(V.EXACT_RELATIONS)}) THEN 'EXACT' "
            f"WHEN upper(trim(coalesce({r},''))) IN ({words(V.GT_RELATIONS)}) THEN 'GT_BOUND' "
            f"WHEN upper(trim(coalesce({r},''))) IN ({words(V.LT_RELATIONS)}) THEN 'LT_BOUND' "
            f"WHEN upper(trim(coalesce({r},''))) = 'BOUNDED' THEN 'BOUNDED_DIRECTION_UNKNOWN' ELSE 'UNKNOWN' END)")


ENDPOINT_SQL = "(CASE activity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.ENDPOINT_PRIORITY.items()) + " END)"

VIEWS: dict[str, str] = {}

VIEWS["assertion"] = """
SELECT o_orderpriority || '/' || c_mktsegment AS profile,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS assertion_id,
  p_brand || ':' || p_type AS target,
  'GENE' || regexp_extract(p_brand, '([0-9]+)', 1) || substr(p_type, 1, 2) AS gene_symbol,
  p_name AS target_name,
  CASE WHEN l_partkey % 11 = 0 THEN 'FAMILY_GENERIC' WHEN l_partkey % 11 = 1 THEN 'UNRESOLVED' ELSE 'EXACT_SINGLE_PROTEIN' END AS target_grain,
  CASE WHEN l_partkey % 11 = 1 THEN 'UNRESOLVED_TARGET' ELSE 'MAPPED_EXACT_TARGET' END AS target_status,
  CASE l_linenumber WHEN 1 THEN 'BINDING_KI' WHEN 2 THEN 'BINDING_KD' WHEN 3 THEN 'INHIBITION_IC50' WHEN 4 THEN 'ACTIVATION_EC50'
    WHEN 5 THEN 'FUNCTIONAL_AC50' WHEN 6 THEN 'OTHER_QUANTITATIVE_POTENCY' WHEN 7 THEN 'ASSIGNED_SCENARIO' END AS activity_type,
  CASE WHEN l_suppkey % 7 = 0 THEN 'MODELED' ELSE 'MEASURED' END AS activity_origin,
  CASE WHEN l_returnflag = 'A' THEN '=' WHEN l_returnflag = 'N' THEN '<' WHEN l_linestatus = 'F' THEN '>' ELSE 'BOUNDED' END AS relation,
  CASE WHEN l_orderkey % 5 = 0 THEN 4.0::DOUBLE + l_quantity / 16 END AS supplied_p,
  CASE WHEN l_orderkey % 3 = 0 THEN l_quantity * (l_suppkey + 1) * CAST(1e-9 AS DOUBLE) END AS std_value,
  CASE WHEN l_orderkey % 3 = 0 THEN 'M' END AS std_unit,
  CASE WHEN l_orderkey % 17 = 0 THEN 0.0::DOUBLE ELSE l_quantity * (l_suppkey + 1) END AS value_original,
  CASE WHEN l_linenumber % 5 = 3 THEN 'µM' WHEN l_linenumber % 5 = 4 THEN 'pM' ELSE 'nM' END AS unit_original,
  CASE s_nationkey % 4 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'Rattus norvegicus' WHEN 2 THEN 'zebrafish' ELSE '' END AS species_reported,
  CASE WHEN s_nationkey % 8 = 0 THEN 9606.0::DOUBLE END AS taxon_reported,
  CASE WHEN l_linestatus = 'F' THEN 'mouse' END AS target_organism,
  CASE s_suppkey % 3 WHEN 0 THEN 'LAB_A' WHEN 1 THEN 'LAB_B' ELSE 'LAB_C' END AS source_database,
  'LAB Ki_' || s_suppkey || '.0 assay' AS assay_id,
  l_partkey || '-' || l_suppkey AS duplicate_group_id,
  l_orderkey AS source_row
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""

VIEWS["cleaned"] = f"""
SELECT *, CASE WHEN upper(activity_type) LIKE '%ASSIGNED%' OR upper(activity_type) LIKE '%SCENARIO%' THEN 'ASSIGNED_SCENARIO'
    WHEN activity_origin = 'MODELED' THEN 'MODELED_OR_IMPUTED'
    WHEN activity_origin = 'MEASURED' AND pactivity IS NOT NULL THEN 'MEASURED_NUMERICAL'
    WHEN activity_origin = 'MEASURED' THEN 'MEASURED_NONNUMERICAL' ELSE 'OTHER' END AS lane
FROM (
  SELECT *, relation AS relation_operator, {relation_sql('relation')} AS relation_class,
    CASE WHEN c1 <> 'UNRESOLVED' THEN c1 ELSE c2 END AS species_class,
    CASE WHEN c1 = 'HUMAN' THEN 'Homo sapiens' WHEN c1 <> 'UNRESOLVED' THEN species_reported
         WHEN c2 <> 'UNRESOLVED' THEN target_organism ELSE 'UNRESOLVED' END AS species,
    CASE WHEN std_value > 0 THEN coalesce(supplied_p, -log10(std_value))
         WHEN om > 0 THEN coalesce(supplied_p, -log10(om)) ELSE supplied_p END AS pactivity,
    CASE WHEN std_value > 0 THEN std_value WHEN om > 0 THEN om WHEN supplied_p IS NOT NULL THEN pow(10.0::DOUBLE, -supplied_p) END AS molar,
    CASE WHEN std_value > 0 THEN CASE WHEN supplied_p IS NULL THEN 'RECOMPUTED_FROM_STANDARDIZED_M' ELSE 'SUPPLIED_PACTIVITY_AND_STANDARDIZED_M' END
         WHEN om > 0 THEN CASE WHEN supplied_p IS NULL THEN 'RECOMPUTED_FROM_ORIGINAL_VALUE' ELSE 'SUPPLIED_PACTIVITY_AND_ORIGINAL_VALUE' END
         WHEN supplied_p IS NOT NULL THEN 'SUPPLIED_PACTIVITY_ONLY' ELSE 'NO_NUMERICAL_ACTIVITY' END AS value_origin,
    (std_value IS NULL AND om IS NULL AND supplied_p IS NULL AND value_original <= 0) AS invalid_boundary
  FROM (SELECT *, {molar_sql('value_original', 'unit_original')} AS om,
          {_species('species_reported', 'taxon_reported')} AS c1, {_species('target_organism', 'NULL')} AS c2 FROM assertion))"""

VIEWS["eligible"] = """
SELECT * FROM cleaned WHERE target_status = 'MAPPED_EXACT_TARGET' AND target_grain = 'EXACT_SINGLE_PROTEIN' AND lane = 'MEASURED_NUMERICAL'"""

VIEWS["pooled"] = f"""
SELECT * FROM (SELECT *, {ENDPOINT_SQL} AS ep,
    bool_or(species_class = 'HUMAN') OVER (PARTITION BY profile, target) AS any_human,
    bool_or(species_class = 'MAMMALIAN_NONHUMAN') OVER (PARTITION BY profile, target) AS any_mammal FROM eligible)
WHERE species_class = CASE WHEN any_human THEN 'HUMAN' WHEN any_mammal THEN 'MAMMALIAN_NONHUMAN' END"""

VIEWS["exact_pick"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile, target ORDER BY ep, round(pactivity, 9) DESC, assertion_id) AS rk
  FROM pooled WHERE relation_class = 'EXACT' AND ep IS NOT NULL) WHERE rk = 1"""

VIEWS["bounded_pick"] = """
SELECT * FROM (SELECT *, CASE WHEN n_gt > 0 AND n_lt > 0 THEN 'MIXED_BOUND_DIRECTIONS_REVIEW_REQUIRED'
      WHEN n_gt > 0 THEN 'GT_TIGHTEST_LOWER_CONCENTRATION_BOUND' WHEN n_lt > 0 THEN 'LT_TIGHTEST_UPPER_CONCENTRATION_BOUND'
      ELSE 'UNKNOWN_DIRECTION_PROVISIONAL_STRONGEST_BOUNDARY' END AS bound_rule,
    row_number() OVER (PARTITION BY profile, target ORDER BY
      CASE WHEN n_gt > 0 THEN (CASE WHEN relation_class = 'GT_BOUND' THEN 0 ELSE 1 END)
           WHEN n_lt > 0 THEN (CASE WHEN relation_class = 'LT_BOUND' THEN 0 ELSE 1 END) ELSE 0 END,
      CASE WHEN n_gt > 0 THEN -molar WHEN n_lt > 0 THEN molar ELSE -round(pactivity, 9) END, assertion_id) AS rk
  FROM (SELECT *, count(*) FILTER (relation_class = 'GT_BOUND') OVER (PARTITION BY profile, target) AS n_gt,
               count(*) FILTER (relation_class = 'LT_BOUND') OVER (PARTITION BY profile, target) AS n_lt
        FROM (SELECT *, min(ep) OVER (PARTITION BY profile, target) AS best_ep FROM pooled
              WHERE relation_class IN ('GT_BOUND', 'LT_BOUND', 'BOUNDED_DIRECTION_UNKNOWN') AND ep IS NOT NULL)
        WHERE ep = best_ep AND molar > 0)) WHERE rk = 1"""

_cols = ["assertion_id", "activity_type", "relation_class", "relation_operator", "pactivity", "molar", "species",
         "source_database", "value_original", "unit_original"]
VIEWS["selection"] = """
SELECT g.profile, g.target,
  CASE WHEN h THEN 'HUMAN_PRIORITY' WHEN m THEN 'MAMMALIAN_FALLBACK' ELSE '' END AS species_basis,
  CASE WHEN e.profile IS NOT NULL THEN 'EXACT_MEASURED'
       WHEN coalesce(nx, 0) = 0 AND b.profile IS NOT NULL AND b.bound_rule NOT LIKE 'MIXED%' THEN 'BOUNDED_MEASURED_BOUNDARY' ELSE '' END AS selection_kind,
  CASE WHEN coalesce(nx, 0) > 0 THEN '' WHEN b.profile IS NOT NULL THEN b.bound_rule
       WHEN coalesce(nb, 0) > 0 THEN 'NO_ELIGIBLE_BOUNDED_ENDPOINT' ELSE '' END AS bound_selection_rule,
  """ + ",\n  ".join(
    f"CASE WHEN coalesce(nx, 0) > 0 THEN e.{c} WHEN b.bound_rule NOT LIKE 'MIXED%' THEN b.{c} END AS {c}" for c in _cols
) + """
FROM (SELECT profile, target, bool_or(species_class = 'HUMAN') AS h, bool_or(species_class = 'MAMMALIAN_NONHUMAN') AS m FROM eligible GROUP BY 1, 2) g
LEFT JOIN (SELECT profile, target, count(*) FILTER (relation_class = 'EXACT') AS nx,
             count(*) FILTER (relation_class IN ('GT_BOUND', 'LT_BOUND', 'BOUNDED_DIRECTION_UNKNOWN')) AS nb FROM pooled GROUP BY 1, 2) k
  ON g.profile = k.profile AND g.target = k.target
LEFT JOIN exact_pick e ON g.profile = e.profile AND g.target = e.target
LEFT JOIN bounded_pick b ON g.profile = b.profile AND g.target = b.target"""

VIEWS["expression"] = """
SELECT p_brand || ':' || p_type AS target, 'GENE' || brand || substr(p_type, 1, 2) AS gene_symbol, n_name AS tissue,
  CAST(brand * 1000 + type_no * 100 + n_nationkey AS BIGINT) AS feature_order,
  q * CASE WHEN (n_nationkey * 7 + brand * 3 + length(p_type)) % 43 = 0 THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END AS raw
FROM (SELECT p_brand, p_type, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS brand,
    CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 WHEN 'STANDARD' THEN 5 ELSE 9 END AS type_no,
    n_name, n_nationkey, sum(l_quantity) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""

VIEWS["expression_z"] = """
SELECT *, CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - avg(raw) OVER w) / stddev_samp(raw) OVER w END AS z
FROM expression WINDOW w AS (PARTITION BY target)"""

VIEWS["contract"] = "SELECT feature_order, target || '||' || tissue AS feature_id, target, tissue FROM expression"

VIEWS["profiles"] = """
SELECT s.profile, x.target || '||' || x.tissue AS feature_id, feature_order, x.target, tissue, pactivity, z, relation_class, pactivity * z AS score
FROM selection s JOIN expression_z x ON s.target = x.target"""

VIEWS["vectors"] = """
SELECT vec_id AS profile, label, CAST(pos AS BIGINT) AS feature_order, 'f' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature_id,
  't' || (pos // 8) AS target, 'u' || (pos % 8) AS tissue,
  CASE WHEN (vec_id * 7 + pos * 3) % 5 <> 0 THEN CAST(x AS DOUBLE) * CASE WHEN (vec_id * 7 + pos * 3) % 43 = 0 THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END END AS value
FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""

VIEWS["vector_contract"] = "SELECT DISTINCT feature_order, feature_id, target, tissue FROM vectors"

VIEWS["vector_roster"] = "SELECT vec_id AS profile, vec_id AS roster_order FROM embeddings"

VIEWS["vector_classes"] = """
SELECT class_id, 'Class ' || class_id AS class_label, profile FROM (
  SELECT 'L' || label AS class_id, vec_id AS profile FROM embeddings
  UNION ALL SELECT 'M' || (vec_id % 4), vec_id FROM embeddings WHERE vec_id % 3 = 0)"""

_STEPS = """
SELECT *, (value - mu) / sd AS r_stat FROM (
  SELECT *, total - n + 1 AS step FROM (
    SELECT {cols}, {value} AS value, count(*) OVER up AS n, avg({value}) OVER up AS mu, stddev_samp({value}) OVER up AS sd,
      count(*) OVER (PARTITION BY profile) AS total, min({value}) OVER (PARTITION BY profile) AS lowest
    FROM {source} WHERE {value} IS NOT NULL
    WINDOW up AS (PARTITION BY profile ORDER BY {value}, feature_order DESC ROWS UNBOUNDED PRECEDING)))
WHERE step <= least(floor(0.10::DOUBLE * total), total - 3) AND value > lowest AND sd > 0"""
VIEWS["profile_steps"] = _STEPS.format(cols="profile, feature_id, feature_order, target, tissue", value="score", source="profiles")
VIEWS["vector_steps"] = _STEPS.format(cols="profile, feature_id, feature_order, target, tissue", value="value", source="vectors")

_CALLS = """
SELECT t.*, r_stat - critical_lambda AS r_minus_lambda FROM (
  SELECT s.*, alpha, lam AS critical_lambda, max(CASE WHEN r_stat > lam THEN step END) OVER (PARTITION BY profile, alpha) AS last_step
  FROM {steps} s JOIN {lam} l ON s.n = l.n) t WHERE step <= last_step"""
VIEWS["profile_calls"] = _CALLS.format(steps="profile_steps", lam="lambda_wide")
VIEWS["vector_calls"] = _CALLS.format(steps="vector_steps", lam="lambda_narrow")

_LAMBDA_RANGES = {"lambda_wide": (1500, 3751), "lambda_narrow": (20, 65)}


def _lambda_view(lo: int, hi: int) -> str:
    """Thresholds for every n in [lo, hi), from an independent quadrature (see ``quadrature.py``)."""
    from .quadrature import lambda_table

    parts = []
    for alpha in V.ALPHAS:
        values = ", ".join(repr(float(x)) for x in lambda_table(lo, hi, alpha))
        parts.append(f"SELECT {lo} - 1 + generate_subscripts(v, 1) AS n, CAST({alpha!r} AS DOUBLE) AS alpha, CAST(unnest(v) AS DOUBLE) AS lam FROM (SELECT [{values}] AS v)")
    return " UNION ALL ".join(parts)


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    names = list(VIEWS) + list(_LAMBDA_RANGES)
    return [n for n in names if n in words]


def oracle(body: str, **extra: str) -> str:
    """``WITH`` every view the body mentions, dependencies first. ``extra`` adds query-local views."""
    local = {k: v for k, v in extra.items()}
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in done:
            return
        sql = local.get(name) or VIEWS.get(name) or _lambda_view(*_LAMBDA_RANGES[name])
        if name not in _LAMBDA_RANGES:
            for dep in [d for d in _needs(sql) if d != name] + [d for d in local if d != name and re.search(rf"\b{d}\b", sql)]:
                visit(dep)
        done[name] = sql

    for name in _needs(body) + [d for d in local if re.search(rf"\b{d}\b", body)]:
        visit(name)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in done.items()) + "\n" + body
