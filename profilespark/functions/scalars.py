"""Scalar rules as Catalyst column expressions (one small Arrow function where Catalyst has no equivalent)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V


def _lit_map(d: dict) -> Column:
    """Constant map, written as one SQL literal (folded by Catalyst, one call from Python)."""
    def sql(x):
        return "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x)

    return F.expr("map(" + ", ".join(sql(x) for kv in d.items() for x in kv) + ")")


def _in(c: Column, words) -> Column:
    return F.coalesce(c.isin(list(words)), F.lit(False))


def text(c: Column) -> Column:
    """Trimmed text, NULL read as blank."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def to_finite(c: Column) -> Column:
    """Number or NULL: bad text, NaN and infinities become NULL."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def truthy(c: Column) -> Column:
    return _in(F.lower(F.trim(c.cast("string"))), V.TRUE_WORDS)


def nonblank(c: Column) -> Column:
    """The trimmed value, NULL when it is one of the words that mean "no value"."""
    t = text(c)
    return F.when((t != "") & ~F.upper(t).isin(V.BLANK_WORDS), t)


def first_nonblank(c: Column, order: Column) -> Column:
    """Aggregate: the first usable value of the group by ``order``, blank when none."""
    v = nonblank(c)
    return F.coalesce(F.min_by(v, F.when(v.isNotNull(), order)), F.lit(""))


def joinable(c: Column) -> Column:
    """The value as it takes part in a joined list, NULL when it takes none."""
    t = text(c)
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def uniq_join(df: DataFrame, keys: list[str], c: str, order: str, out: str, sep: str = " | ") -> DataFrame:
    """Distinct usable values per group, joined in order of first appearance.

    Values are reduced to one row each before anything is collected, so a hot group costs its distinct values.
    """
    v = joinable(F.col(c))
    firsts = df.select(*keys, v.alias("_v"), F.col(order).alias("_o")).where("_v is not null")
    firsts = firsts.groupBy(*keys, "_v").agg(F.min("_o").alias("_o"))
    lists = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("_l"))
    return lists.select(*keys, F.array_join(F.col("_l._v"), sep).alias(out))


def set_join(c: Column, sep: str = " | ") -> Column:
    """Aggregate: distinct usable values joined in alphabetical order."""
    return F.array_join(F.array_sort(F.collect_set(joinable(c))), sep)


def split_ids(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def parse_row_list(c: Column) -> Column:
    """Whole numbers listed in a text, ``"2.0"`` read as 2 and everything else dropped."""
    parts = F.split(F.trim(F.coalesce(c, F.lit(""))), r"[|,; ]+")
    nums = F.transform(parts, lambda x: to_finite(x))
    return F.transform(F.filter(nums, lambda x: x.isNotNull()), lambda x: x.cast("long"))


def canonical_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", "")


def canonical_key_unicode(c: Column) -> Column:
    """As ``canonical_key`` but letters and digits of every script are kept."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", "")


def upper_key(c: Column, spaces_only: bool = False) -> Column:
    return F.regexp_replace(F.upper(text(c)), " " if spaces_only else "[^A-Z0-9]+", "")


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    dashes = {ord(ch): "-" for ch in "–—−"}

    def one(v: str) -> str:
        t = unicodedata.normalize("NFKC", v).translate(dashes)
        return re.sub(r"\s+", " ", t.strip()).casefold()

    return s.fillna("").map({v: one(v) for v in s.fillna("").unique()})


def compound_name_key(c: Column) -> Column:
    """Compatibility-normalised, dash- and space-normalised, case-folded name; punctuation is kept.

    Neither Catalyst nor the JVM functions it exposes offer NFKC, hence the Arrow function.
    """
    return _fold(c.cast("string"))


def slug(c: Column, lower: bool = False, empty: str = "item") -> Column:
    t = F.regexp_replace(text(c), "[^A-Za-z0-9]+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    t = F.lower(t) if lower else t
    return F.when(t == "", F.lit(empty)).otherwise(t)


def _unit_text(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.translate(text(c), "μµ", "uu")), " ", "")


def normalize_unit(c: Column) -> Column:
    t = _unit_text(c)
    return F.coalesce(F.element_at(_lit_map(V.UNIT_ALIASES), t), t)


def unit_scale(c: Column) -> Column:
    """mol/l in one unit, NULL for an unknown unit."""
    known = dict(V.UNIT_TO_MOLAR, **{alias: V.UNIT_TO_MOLAR[u] for alias, u in V.UNIT_ALIASES.items()})
    return F.element_at(_lit_map(known), _unit_text(c))


def to_molar(value: Column, unit: Column) -> Column:
    """Positive value in mol/l; ``value`` is a clean double (``to_finite`` at ingest)."""
    return F.when(value > 0, value * unit_scale(unit))


def pactivity(value: Column, unit: Column) -> Column:
    """-log10 of the molar value; Catalyst's log10 already answers NULL for zero and below."""
    return -F.log10(value * unit_scale(unit))


def relation_class(c: Column) -> Column:
    known = {w: "EXACT" for w in V.EXACT_RELATIONS} | {w: "GT_BOUND" for w in V.GT_RELATIONS} | {w: "LT_BOUND" for w in V.LT_RELATIONS}
    known["BOUNDED"] = "BOUNDED_DIRECTION_UNKNOWN"
    return F.coalesce(F.element_at(_lit_map(known), F.upper(text(c))), F.lit("UNKNOWN"))


def detect_relation_in_text(c: Column) -> Column:
    """Relation sign visible in free text; two-character signs win, a sign after a letter does not count."""
    t = text(c)
    return (
        F.when(t.rlike(r">\s*="), ">=")
        .when(t.rlike(r"<\s*="), "<=")
        .when(t.rlike(r"(^|[^A-Za-z])>\s*[0-9.]"), ">")
        .when(t.rlike(r"(^|[^A-Za-z])<\s*[0-9.]"), "<")
        .otherwise("")
    )


def parse_number_in_text(c: Column) -> Column:
    t = F.regexp_replace(text(c), ",", "")
    return to_finite(F.regexp_extract(t, r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?", 0))


def extract_record_id(c: Column, prefix: str) -> Column:
    """Digits of ``<prefix> Ki<digits>`` in an assay text, a trailing ``.0`` removed."""
    raw = F.regexp_extract(text(c), rf"(?i){prefix}\s*Ki[_\s:-]*([0-9]+(?:\.0+)?)", 1)
    return F.when(raw != "", F.round(to_finite(raw)).cast("long").cast("string"))


def species_name(name: Column, taxon: Column, cls: Column) -> Column:
    """Name that goes with a class already worked out (``species_class``)."""
    raw = text(name)
    return (
        F.when(cls == "HUMAN", "Homo sapiens").when(cls == "UNRESOLVED", "UNRESOLVED").when(raw != "", raw)
        .otherwise(F.concat(F.lit("taxon:"), F.round(taxon).cast("long").cast("string")))
    )


def species_taxon(name: Column, taxon: Column, cls: Column) -> Column:
    tx = F.round(taxon).cast("long")
    by_taxon = tx.isin(V.MAMMAL_TAXA)
    named = F.element_at(_lit_map(V.TAXON_BY_NAME), F.lower(text(name))).cast("long")
    return F.when(cls == "HUMAN", F.lit(V.HUMAN_TAXON).cast("long")).when(by_taxon, tx).otherwise(F.coalesce(named, tx))


def classify_species(df: DataFrame, name: str, taxon: str | None, prefix: str) -> DataFrame:
    """Adds ``<prefix>class``, ``<prefix>species`` and ``<prefix>taxon``; the class is worked out once per row."""
    tx = F.col(taxon) if taxon else F.lit(None).cast("double")
    staged = df.withColumn(f"{prefix}class", species_class(F.col(name), tx))
    cls = F.col(f"{prefix}class")
    return staged.withColumns({
        f"{prefix}species": species_name(F.col(name), tx, cls), f"{prefix}taxon": species_taxon(F.col(name), tx, cls),
    })


def species_class(name: Column, taxon: Column) -> Column:
    """HUMAN / MAMMALIAN_NONHUMAN / NON_MAMMALIAN / UNRESOLVED: taxon, then exact name, then words (mammals first)."""
    def words(ws):
        return "|".join(re.escape(w) for w in ws)

    low = F.lower(text(name))
    stated, named = F.round(taxon).cast("int"), F.element_at(_lit_map(V.TAXON_BY_NAME), low).cast("int")

    def of(tx):
        return F.when(tx == V.HUMAN_TAXON, "HUMAN").when(tx.isin(V.MAMMAL_TAXA), "MAMMALIAN_NONHUMAN")

    return F.coalesce(
        of(stated),
        of(named),
        F.when(named.isNotNull(), "NON_MAMMALIAN"),
        F.when(low.rlike("human|homo sapiens"), "HUMAN").when(low.rlike(words(V.MAMMAL_TOKENS)), "MAMMALIAN_NONHUMAN")
        .when(low.rlike(words(V.OTHER_TOKENS)), "NON_MAMMALIAN"),
        F.lit("UNRESOLVED"),
    )


def normalize_activity(value: Column, unit: Column, relation: Column, measured: Column, evidence: Column) -> Column:
    cls = relation_class(relation)
    return F.struct(
        value.alias("reported_value"),
        normalize_unit(unit).alias("reported_unit"),
        text(relation).alias("relation_operator"),
        cls.alias("relation_class"),
        to_molar(value, unit).alias("molar"),
        pactivity(value, unit).alias("pactivity"),
        cls.isin(V.BOUNDED_CLASSES).alias("is_bounded"),
        measured.cast("string").alias("measured_or_modeled"),
        evidence.cast("string").alias("evidence_status"),
    )


def working_pactivity(supplied_p: Column, std_value: Column, std_unit: Column, orig_value: Column, orig_unit: Column) -> dict[str, Column]:
    """pactivity, molar, origin and invalid flag: standardised value first, then the original, then the supplied number.

    Inputs are clean doubles. The parts are separate columns, so a filter on one of them does not drag the others along.
    """
    std = F.when(normalize_unit(std_unit) == "M", std_value)
    orig = orig_value * unit_scale(orig_unit)
    molar = F.coalesce(F.when(std > 0, std), F.when(orig > 0, orig))
    named = F.when(std > 0, "STANDARDIZED_M").when(orig > 0, "ORIGINAL_VALUE")
    has_p = supplied_p.isNotNull()
    return {
        "pactivity": F.coalesce(supplied_p, -F.log10(std), -F.log10(orig)),
        "molar": F.coalesce(molar, F.pow(F.lit(10.0), -supplied_p)),
        "origin": F.when(named.isNull(), F.when(has_p, "SUPPLIED_PACTIVITY_ONLY").otherwise("NO_NUMERICAL_ACTIVITY")).otherwise(
            F.concat(F.when(has_p, "SUPPLIED_PACTIVITY_AND_").otherwise("RECOMPUTED_FROM_"), named)),
        "invalid": molar.isNull() & ~has_p & (F.coalesce(std_value <= 0, F.lit(False)) | F.coalesce(orig_value <= 0, F.lit(False))),
    }


def activity_lane(activity_type: Column, origin: Column, p: Column) -> Column:
    kind, org = F.upper(text(activity_type)), F.upper(text(origin))
    return (
        F.when(kind.contains("ASSIGNED") | kind.contains("SCENARIO"), "ASSIGNED_SCENARIO")
        .when(org.isin("MODELED_OR_IMPUTED", "MODELED", "MODELLED", "IMPUTED"), "MODELED_OR_IMPUTED")
        .when((org == "MEASURED") & p.isNotNull(), "MEASURED_NUMERICAL")
        .when(org == "MEASURED", "MEASURED_NONNUMERICAL")
        .otherwise("OTHER")
    )


def is_exact_target(target: Column, status: Column, grain: Column) -> Column:
    st, gr = F.upper(text(status)), F.upper(text(grain))
    barred = st.contains("UNRESOLVED") | gr.contains("UNRESOLVED") | gr.contains("FAMILY") | gr.contains("GENERIC")
    return (text(target) != "") & ~barred & (st.isin("MAPPED_EXACT_TARGET", "EXACT_TARGET") | gr.contains("EXACT"))


def endpoint_priority(c: Column) -> Column:
    return F.element_at(_lit_map(V.ENDPOINT_PRIORITY), F.upper(text(c)))


def invert_relation(rel_class: Column) -> Column:
    """Relation of -log10(x) from the class of x: the direction turns round."""
    t = text(rel_class)
    return F.when(t == "EXACT", "=").when(t == "GT_BOUND", "<").when(t == "LT_BOUND", ">").otherwise("?")


def propagate_bound(p_rel: Column, z: Column) -> Column:
    """struct(relation, status) of p * z: a negative factor turns the bound, a zero factor makes it exact."""
    zz, up = z, z > 0

    def out(rel, status):
        return F.struct(rel.alias("relation"), status.alias("status"))

    lower = (F.lit(">"), F.lit("BOUNDED_LOWER"))
    upper = (F.lit("<"), F.lit("BOUNDED_UPPER"))
    return (
        F.when(zz.isNull(), out(F.lit("?"), F.lit("MISSING_EXPRESSION")))
        .when(p_rel == "=", out(F.lit("="), F.lit("EXACT")))
        .when(F.abs(zz) <= 1e-15, out(F.lit("="), F.lit("EXACT_ZERO_FROM_EXPRESSION_Z_ZERO")))
        .when(((p_rel == "<") & up) | ((p_rel == ">") & ~up), out(*upper))
        .when(p_rel.isin("<", ">"), out(*lower))
        .otherwise(out(F.lit("?"), F.lit("RELATION_UNRESOLVED")))
    )


def general_number(c: Column, digits: int) -> Column:
    """Shortest text of a number at ``digits`` significant digits (trailing zeros dropped)."""
    padded = F.format_string(f"%.{digits}g", c)
    return F.regexp_replace(F.regexp_replace(padded, r"(\.[0-9]*?)0+(e.*)?$", "$1$2"), r"\.(e|$)", "$1")


def bound_interpretation(status: Column, rel: Column, value: Column, digits: int = 15) -> Column:
    """Sentence for one score, the number at ``digits`` significant digits."""
    number = general_number(value, digits)
    return (
        F.when(status == "EXACT", "HR exact conditional on selected activity and expression Z.")
        .when(status == "EXACT_ZERO_FROM_EXPRESSION_Z_ZERO", "HR equals zero because expression Z equals zero.")
        .when(
            status.startswith("BOUNDED"),
            F.concat(F.lit("HR "), rel, F.lit(" "), number, F.lit("; numeric value is a boundary, not an exact HR score.")),
        )
        .otherwise("HR relation unresolved.")
    )


# Coefficients of the published algorithm AS 241 (PPND16), as ratios of polynomials in ascending powers.
_AS241 = {
    "a": [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
          4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    "b": [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
          3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
    "c": [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
          1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    "d": [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
          1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
    "e": [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
          2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    "f": [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4,
          1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
}


def _poly(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[-1])
    for k in reversed(coeffs[:-1]):
        acc = acc * x + F.lit(k)
    return acc


def norm_ppf(p: Column, eps: float = 1e-6) -> Column:
    """Standard normal quantile after clipping to [eps, 1 - eps] (AS 241, about 1e-16 relative)."""
    p = F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps)))
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    central = q * _poly(_AS241["a"], r0) / _poly(_AS241["b"], r0)
    tail = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    near, far = tail - 1.6, tail - 5.0
    outer = F.when(tail <= 5, _poly(_AS241["c"], near) / _poly(_AS241["d"], near)).otherwise(
        _poly(_AS241["e"], far) / _poly(_AS241["f"], far)
    )
    return F.when(F.abs(q) <= 0.425, central).otherwise(F.when(q < 0, -outer).otherwise(outer))


def record_match_score(fields: list[Column], target: Column, value: Column, source: Column, token: str) -> Column:
    """Points for how well a source record matches: target text 5, source word 3, value text 3; no record -999."""
    joined = F.upper(F.concat_ws(" | ", *[text(f) for f in fields]))
    absent = F.lit(True)
    for f in fields:
        absent = absent & f.isNull()
    value_text = F.upper(general_number(value, 6))
    return F.when(absent, -999).otherwise(
        F.when((text(target) != "") & joined.contains(F.upper(text(target))), 5).otherwise(0)
        + F.when(F.upper(text(source)).contains(token) & joined.contains(token), 3).otherwise(0)
        + F.when(value.isNotNull() & joined.contains(value_text), 3).otherwise(0)
    )
