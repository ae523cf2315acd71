"""Consensus, de-duplication and resolution cascades: the first rule that answers wins, and its name is kept.

A cascade is a chain of left joins whose answers meet in one ``coalesce``. Consensus tables are two-level aggregates
(distinct values first), so a hot key costs its distinct values, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab as V
from ..session import cut
from .winners import first_rows, on_keys, renamed


# ---------------------------------------------------------------- consensus and duplicates

def consensus_value(df: DataFrame, key: str, values: list[str], resolved: Column | None = None) -> DataFrame:
    """Value(s) per key only where all resolved rows agree; other keys give no row."""
    rows = df.where(resolved) if resolved is not None else df
    distinct = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(key, *values).distinct()
    one = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*values)).alias("_v"))
    return one.where("_n = 1").select(key, "_v.*")


def collapse_identical(df: DataFrame, keys: list[str], compared: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(clean, conflicts): the first row per key where the compared columns agree, and the keys where they do not."""
    rows = cut(df)
    null_text = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in compared]
    prints = [F.xxhash64(t, F.lit(seed)) for t in null_text for seed in (1, 2)]  # texts by 128 bits, so that the aggregate is of fixed width
    agg = rows.groupBy(*keys).agg(*[(F.min(h) != F.max(h)).alias(f"_d{i}") for i, h in enumerate(prints)])
    differ = [F.col(f"_d{2 * i}") | F.col(f"_d{2 * i + 1}") for i in range(len(compared))]
    named = F.filter(F.array(*[F.when(d, c) for d, c in zip(differ, compared)]), lambda x: x.isNotNull())
    verdict = cut(agg.select(*keys, named.alias("_named")))
    fine = verdict.where(F.size("_named") == 0).select(*renamed(verdict, keys))
    clean = first_rows(rows.join(fine, on_keys(keys)).select(*df.columns), keys, [order])
    return clean, verdict.where(F.size("_named") > 0).select(*keys, F.array_join("_named", ", ").alias("conflicting_columns"))


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the order."""
    return first_rows(df, keys, order)


def drop_ambiguous_map(labels: DataFrame, id_col: str, label_cols: list[str]) -> DataFrame:
    """label -> id over several label columns (upper-cased); labels with more than one id are dropped."""
    each = F.explode(F.array(*[F.upper(S.text(F.col(c))) for c in label_cols])).alias("label")
    pairs = labels.select(F.col(id_col).alias("id"), each).where("label <> ''").distinct()
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.first("id").alias("id")).where("_n = 1").drop("_n")


def profile_choice(df: DataFrame, col: str, preferred: str) -> DataFrame:
    """The id to use: the first one containing ``preferred``, else the sole one, else the most frequent (ties by name)."""
    counts = df.where(F.coalesce(F.col(col), F.lit("")) != "").groupBy(F.col(col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.upper("id").contains(preferred.upper())
    return counts.agg(
        F.min(F.when(hit, F.col("id"))).alias("_p"), F.count(F.lit(1)).alias("ids"), F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("_m"),
    ).select(F.coalesce("_p", "_m").alias("id"), F.when(F.col("_p").isNotNull(), "PREFERRED").when(F.col("ids") == 1, "SOLE").otherwise("MODAL").alias("rule"))


def contract_filter(dictionary: DataFrame, flag: str) -> DataFrame:
    """Flagged features with their comparison key; ``feature_order`` carries the order."""
    return dictionary.where(S.truthy(F.col(flag))).withColumn("tissue_key", S.canonical_key(F.col("tissue")))


def measured_split(df: DataFrame) -> dict[str, DataFrame]:
    lane = F.col("lane")
    return {
        "measured": df.where(lane == "MEASURED_NUMERICAL"), "modeled": df.where(lane.isin("MODELED_OR_IMPUTED", "ASSIGNED_SCENARIO")),
        "unresolved_species": df.where(F.col("species_class") == "UNRESOLVED"), "bounded": df.where(F.col("relation_class").isin(V.BOUNDED_CLASSES)),
    }


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Value counts of several columns in one pass: (column, value, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(each.alias("_c")).groupBy("_c.column", "_c.value").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- checked joins

def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str, cardinality: str) -> tuple[DataFrame, DataFrame]:
    """(joined, violations): keys that break the declared one_to_one / many_to_one / one_to_many shape."""
    bad = []
    if cardinality in ("one_to_one", "many_to_one"):
        bad.append(("RIGHT_NOT_UNIQUE", right))
    if cardinality in ("one_to_one", "one_to_many"):
        bad.append(("LEFT_NOT_UNIQUE", left))
    frames = [d.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("violation", F.lit(v)) for v, d in bad]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return left.join(right, on, how), out


def fallback_join(missing: DataFrame, dictionary: DataFrame, id_col: str, gene_col: str) -> DataFrame:
    """Dictionary rows by id; where an id has none, by gene when the gene names one id only and is not composite."""
    d = dictionary.withColumn("_id", F.upper(S.text(F.col(id_col)))).withColumn("_gene", F.upper(S.text(F.col(gene_col)))).drop(id_col, gene_col)
    m = missing.select(F.col(id_col).alias("requested_id"), F.col(gene_col).alias("requested_gene")).distinct()
    m = m.withColumn("_rid", F.upper(S.text(F.col("requested_id")))).withColumn("_rgene", F.upper(S.text(F.col("requested_gene"))))
    ids = d.select("_id").distinct()
    by_id = m.join(d, F.col("_rid") == F.col("_id")).withColumn("method", F.lit("EXACT_ID"))
    left = m.join(ids, F.col("_rid") == F.col("_id"), "left_anti").where(~F.col("_rgene").rlike("[;|,]"))
    clear = d.select("_gene", "_id").distinct().groupBy("_gene").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(F.col("_gene").alias("_g"))
    by_gene = left.join(clear, F.col("_rgene") == F.col("_g"), "left_semi").join(d, F.col("_rgene") == F.col("_gene")).withColumn("method", F.lit("UNAMBIGUOUS_GENE"))
    drop = ["_rid", "_rgene", "_id", "_gene"]
    found = by_id.drop(*drop).unionByName(by_gene.drop(*drop))
    none = m.join(found.select("requested_id").distinct(), "requested_id", "left_anti").select("requested_id", "requested_gene", F.lit("NO_MATCH").alias("method"))
    return found.unionByName(none, allowMissingColumns=True)


def id_or_label_join(a: DataFrame, b: DataFrame, gene: str, tissue_id: str, tissue_label: str, a_val: str, b_val: str) -> DataFrame:
    """Joins on gene and tissue id when the id sets overlap at all, otherwise on gene and tissue label."""
    x = a.select(gene, F.col(tissue_id).alias("_ai"), F.col(tissue_label).alias("_al"), F.col(a_val).alias("value_a"))
    y = b.select(gene, F.col(tissue_id).alias("_bi"), F.col(tissue_label).alias("_bl"), F.col(b_val).alias("value_b"))
    overlap = x.select("_ai").distinct().join(y.select("_bi").distinct(), F.col("_ai") == F.col("_bi")).limit(1)
    use_id = overlap.agg((F.count(F.lit(1)) > 0).alias("_use_id"))
    kx = x.join(F.broadcast(use_id), F.lit(True)).withColumn("_k", F.when(F.col("_use_id"), F.col("_ai")).otherwise(F.col("_al")))
    ky = y.join(F.broadcast(use_id.withColumnRenamed("_use_id", "_u")), F.lit(True)).withColumn("_k", F.when(F.col("_u"), F.col("_bi")).otherwise(F.col("_bl")))
    j = kx.join(ky, [gene, "_k"])
    mode = F.when(F.col("_use_id"), "GENE_PLUS_TISSUE_ID").otherwise("GENE_PLUS_TISSUE_LABEL")
    return j.select(gene, F.col("_k").alias("tissue_key"), "value_a", "value_b", F.abs(F.col("value_a") - F.col("value_b")).alias("abs_delta"), mode.alias("join_mode"))


def gated_upsert(base: DataFrame, new: DataFrame, keys: list[str], values: list[str], tol: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """(table, violations): the rows of ``new`` replace those of ``base`` only when keys, NULLs and values agree.

    Any violation leaves ``base`` as it is.
    """
    owner = keys[0]
    old = base.join(new.select(owner).distinct(), owner, "left_semi")
    x = old.select(*keys, *[F.col(v).alias(f"o_{v}") for v in values], F.lit(1).alias("_o"))
    y = new.select(*keys, *[F.col(v).alias(f"n_{v}") for v in values], F.lit(1).alias("_n"))
    j = x.join(y, keys, "full_outer")
    why = F.when(F.col("_o").isNull() | F.col("_n").isNull(), "KEY_SET")
    for v in values:
        o, n = F.col(f"o_{v}"), F.col(f"n_{v}")
        why = why.when(o.isNull() != n.isNull(), f"NULL_MASK_{v}").when(F.abs(o - n) > tol, f"VALUE_{v}")
    bad = j.withColumn("violation", why).where("violation is not null").select(*keys, "violation")
    blocked = bad.select(owner).distinct()
    ok_new = new.join(blocked, owner, "left_anti")
    kept = base.join(ok_new.select(owner).distinct(), owner, "left_anti")
    return kept.unionByName(ok_new.select(*base.columns)), bad


# ---------------------------------------------------------------- identities and targets

def resolve_identity(df: DataFrame, name: str, lane: str, registry: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """RESOLVED / AMBIGUOUS / UNRESOLVED per label.

    ``registry``: canonical_id, label, aliases array. ``ambiguous``: alias, candidate_ids array, reason, lanes map. Configured
    ambiguous aliases are looked at first and only a lane rule picks among their candidates. Distinct labels are resolved
    once and joined back.
    """
    asked = df.select(F.col(name).alias("_name"), F.col(lane).alias("_lane")).distinct().withColumn("_key", S.compound_name_key(F.trim(F.coalesce("_name", F.lit("")))))
    amb = ambiguous.select(S.compound_name_key(F.col("alias")).alias("_key"), F.col("candidate_ids").alias("_cand"), F.col("reason").alias("_why"), F.col("lanes").alias("_lanes"))
    alias = registry.select("canonical_id", "label", F.explode(F.concat(F.array("canonical_id", "label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_alias"))
    index = alias.select("canonical_id", S.compound_name_key(F.col("_alias")).alias("_key")).where("_key <> ''").distinct()
    index = index.groupBy("_key").agg(F.array_sort(F.collect_set("canonical_id")).alias("_ids"))
    names = registry.select(F.col("canonical_id").alias("_cid"), F.col("label").alias("canonical_label"))
    j = asked.join(amb, "_key", "left").join(index, "_key", "left")
    by_lane = F.element_at("_lanes", F.col("_lane"))
    special = F.col("_cand").isNotNull()
    sole = F.size("_ids") == 1
    blank = F.col("_key") == ""
    cid = F.when(blank, None).when(special, by_lane).when(sole, F.col("_ids")[0])
    none = F.array().cast("array<string>")
    out = j.select(
        "_name", "_lane", cid.alias("_cid"),
        F.when(blank, "UNRESOLVED").when(cid.isNotNull(), "RESOLVED").when(special | (F.size("_ids") > 1), "AMBIGUOUS").otherwise("UNRESOLVED").alias("status"),
        F.when(blank | cid.isNotNull(), none).when(special, F.col("_cand")).otherwise(F.coalesce("_ids", none)).alias("candidates"),
        # The wording of the reasons is part of the result.
        F.when(blank, "Blank source name").when(special & by_lane.isNotNull(), F.concat(F.lit("Resolved by explicit source lane "), F.col("_lane")))
        .when(special, F.col("_why")).when(sole, "Explicit configured alias").when(F.size("_ids") > 1, "Alias maps to multiple configured identities")
        .otherwise("No explicit governed identity mapping").alias("reason"))
    out = out.join(names, "_cid", "left").select("_name", "_lane", "status", F.col("_cid").alias("canonical_id"), "canonical_label", "candidates", "reason")
    back = df.join(out, F.col(name).eqNullSafe(F.col("_name")) & F.col(lane).eqNullSafe(F.col("_lane")), "left")
    return back.drop("_name", "_lane")


def target_contract(dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contract, conflicts) of distinct (target, gene_symbol, grain)."""
    d = dictionary.select("target", "gene_symbol", "grain").distinct()
    return d, d.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def harmonize_target(df: DataFrame, contract: DataFrame, target: str, gene: str, label: str, grain: str) -> DataFrame:
    """Exact id or gene symbol, case ignored; a grain that does not fit is refused before any matching.

    Adds resolution, resolved_target, resolved_gene, resolved_grain. Distinct requests are resolved once.
    """
    cols = [target, gene, label, grain]
    ask = df.select(*cols).distinct()
    query = F.coalesce(F.nullif(S.text(F.col(target)), F.lit("")), F.nullif(S.text(F.col(gene)), F.lit("")), S.text(F.col(label)))
    ask = ask.withColumn("_key", F.lower(query))
    keyed = contract.select(F.lower("target").alias("_key"), "target", "gene_symbol", "grain").unionByName(
        contract.select(F.lower("gene_symbol").alias("_key"), "target", "gene_symbol", "grain")).distinct()
    hits = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.col("target").alias("t"), F.col("gene_symbol").alias("g"), F.col("grain").alias("r"))).alias("_h"))
    j = ask.join(hits, "_key", "left")
    supplied = S.text(F.col(grain))
    refused = (supplied != "") & ~F.upper(supplied).isin(V.EXACT_GRAINS)
    generic = F.col("_key").isin(V.GENERIC_RECEPTORS)
    status = F.when(refused, "UNSUPPORTED_TARGET_GRAIN").when(generic, "AMBIGUOUS_TARGET_GRAIN").when(F.col("_n") == 1, "RESOLVED").when(F.col("_n") > 1, "AMBIGUOUS_TARGET_MAPPING").otherwise("UNRESOLVED")
    ok = status == "RESOLVED"
    out = j.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(cols)], status.alias("resolution"), F.when(ok, F.col("_h.t")).alias("resolved_target"),
                   F.when(ok, F.col("_h.g")).alias("resolved_gene"),
                   F.when(refused, supplied).when(generic, "GENERIC_RECEPTOR_OR_COMPLEX").when(ok, F.col("_h.r")).when(F.col("_n") > 1, None).otherwise(F.nullif(supplied, F.lit(""))).alias("resolved_grain"))
    cond = None
    for i, c in enumerate(cols):
        e = F.col(c).eqNullSafe(F.col(f"_q{i}"))
        cond = e if cond is None else cond & e
    return df.join(out, cond, "left").drop(*[f"_q{i}" for i in range(len(cols))])


def display_label(df: DataFrame, labels: DataFrame, source: str, display: str | None = None) -> DataFrame:
    """Governed label by key (``labels``: key, label). The display text is used only when its own key is governed."""
    lab = F.broadcast(labels.select(F.col("key").alias("_k"), F.col("label").alias("_l")))
    out = df
    if display:
        shown = F.when(S.text(F.col(display)) != "", F.col(display)).otherwise(F.col(source))
        out = out.join(lab, S.canonical_key(shown) == F.col("_k"), "left").withColumnRenamed("_l", "_dl").withColumnRenamed("_k", "_dk")
    out = out.join(lab, S.canonical_key(F.col(source)) == F.col("_k"), "left")
    text = F.when(S.text(F.col(display)) != "", S.text(F.col(display))).otherwise(S.text(F.col(source))) if display else S.text(F.col(source))
    if display:
        return out.withColumn("tissue_key", F.coalesce("_dk", S.canonical_key(F.col(source)))).withColumn("label", F.coalesce("_dl", "_l", text)).drop("_dl", "_dk", "_l", "_k")
    return out.withColumn("tissue_key", S.canonical_key(F.col(source))).withColumn("label", F.coalesce("_l", text)).drop("_l", "_k")


# ---------------------------------------------------------------- species and relations

def _audit_species(audit: DataFrame, names: list[str], taxa: list[str]) -> DataFrame:
    """First name column that classifies, then the first taxon column that does: (class, species, taxon) as ``_s``."""
    staged = audit
    for i, c in enumerate(names):
        staged = S.classify_species(staged, c, None, f"_n{i}_")
    for i, c in enumerate(taxa):
        staged = S.classify_species(staged.withColumn("_blank", F.lit("")), "_blank", c, f"_t{i}_")
    tries = [f"_n{i}_" for i in range(len(names))] + [f"_t{i}_" for i in range(len(taxa))]
    got = F.coalesce(*[
        F.when(F.col(f"{t}class") != "UNRESOLVED", F.struct(F.col(f"{t}class").alias("cls"), F.col(f"{t}species").alias("species"), F.col(f"{t}taxon").alias("taxon"))) for t in tries])
    return staged.withColumn("_s", got).where("_s is not null")


def raw_record_map(raw: DataFrame, ligand_word: str) -> tuple[DataFrame, DataFrame]:
    """(by_id, by_name) from raw records (record_id, species, receptor, ligand).

    An id seen with two species vanishes; a receptor name counts only when its rows for the ligand (or with none named)
    agree.
    """
    rows = S.classify_species(raw, "species", None, "_r_").where("_r_class <> 'UNRESOLVED'")
    rows = rows.select(F.col("record_id").cast("string").alias("record_id"), S.upper_key(F.col("receptor")).alias("name_key"), F.lower(S.text(F.col("ligand"))).alias("ligand"),
                       F.col("_r_class").alias("cls"), F.col("_r_species").alias("species"), F.col("_r_taxon").alias("taxon"))
    by_id = consensus_value(rows, "record_id", ["cls", "species", "taxon"])
    ligands = rows.groupBy("record_id").agg(F.max((F.col("ligand") == "") | F.col("ligand").contains(ligand_word)).alias("ligand_ok"))
    mine = rows.where((F.col("ligand") == "") | F.col("ligand").contains(ligand_word))
    return by_id.join(ligands, "record_id"), consensus_value(mine, "name_key", ["cls", "species", "taxon"])


def _code(cls, species, taxon):
    """A long for a species triple: triples are few words, and aggregates over them stay of fixed width."""
    return F.xxhash64(cls, species, F.coalesce(F.col(taxon).cast("string") if isinstance(taxon, str) else taxon.cast("string"), F.lit("")))


def _agreed(rows: DataFrame, key: str) -> DataFrame:
    """(key, code) of the keys whose rows all have one code; blank keys give no row."""
    named = rows.where((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & F.col("code").isNotNull())
    return named.groupBy(key).agg(F.min("code").alias("code"), F.max("code").alias("_other")).where("code = _other").drop("_other")


_SPECIES_METHODS = ["TABLE_EXPLICIT", "AUDIT_SOURCE_ASSERTION", "AUDIT_DUPLICATE_GROUP", "RAW_RECORD_ID", "DUPLICATE_GROUP_UNANIMOUS", "RAW_NAME_UNANIMOUS"]


def resolve_species(assertions: DataFrame, audit: DataFrame, raw: DataFrame, source_token: str, record_prefix: str, ligand_word: str,
                    audit_names: list[str], audit_taxa: list[str], key: str = "assertion_id") -> DataFrame:
    """Species of every assertion with the method that answered.

    Order: own fields; audit rows of its ids, when unanimous; audit duplicate group; raw record id; own duplicate group
    (unanimous after the raw ids answered); receptor name. ``assertions`` has assertion_id, all_ids, duplicate_group_id,
    source_database, assay_id, the three reported species fields and the names.

    The assertions are read once and numbered. Every rule yields (row, rank of the rule, code of its answer); the first four are one union,
    of which an aggregate keeps the first answer per row, and the last two see only rows without one. Rows that share a key are answered
    each by its own fields.
    """
    a = S.classify_species(assertions, "species_reported", "taxon_reported", "_1_")
    a = S.classify_species(a, "target_organism", None, "_2_")
    a = S.classify_species(a, "assay_organism", None, "_3_")

    def found(p):
        return F.when(F.col(f"{p}class") != "UNRESOLVED", F.struct(F.col(f"{p}class").alias("cls"), F.col(f"{p}species").alias("species"), F.col(f"{p}taxon").alias("taxon")))

    from_source = F.upper(S.text(F.col("source_database"))).contains(source_token)
    known = ["original_target_name", "target_name", "gene_symbol", "target"]
    row = "_row"
    base = cut(a.withColumn("_own", F.coalesce(found("_1_"), found("_2_"), found("_3_"))).select(
        *assertions.columns, F.monotonically_increasing_id().alias(row), "_own", F.when(F.col("_own").isNotNull(), _code(F.col("_own.cls"), F.col("_own.species"), F.col("_own.taxon"))).alias("_code"),
        F.when(from_source, S.extract_record_id(F.col("assay_id"), record_prefix)).alias("_rec"), F.when(from_source, F.array_distinct(F.array(*[S.upper_key(F.col(c)) for c in known]))).alias("_names")))

    sp = cut(_audit_species(audit, audit_names, audit_taxa).select("source_assertion_id", "duplicate_group_id", "_s.*").withColumn("code", _code(F.col("cls"), F.col("species"), F.col("taxon"))))
    rec_id, rec_name = raw_record_map(raw, ligand_word)
    rec_id = cut(rec_id.where("ligand_ok").withColumn("code", _code(F.col("cls"), F.col("species"), F.col("taxon"))))
    rec_name = cut(rec_name.withColumn("code", _code(F.col("cls"), F.col("species"), F.col("taxon"))))
    triple = ["code", "cls", "species", "taxon"]
    triples = base.where("_own is not null").select(F.col("_code").alias("code"), "_own.*")
    for t in (sp, rec_id, rec_name):
        triples = triples.unionByName(t.select(*triple))

    def answer(df, rank):
        return df.select(row, F.lit(rank).alias("rank"), "code")

    asked = base.where("_code is null")
    ids = asked.select(row, F.explode(F.array_distinct(F.concat(F.array(F.col(key)), S.split_ids(F.col("all_ids"))))).alias("source_assertion_id"))
    one_per_id = dedupe_first(sp.drop("duplicate_group_id"), ["source_assertion_id"], ["cls", "species"]).select("source_assertion_id", "code")
    tries = [
        base.where("_code is not null").select(row, F.col("_code").alias("code")),
        _agreed(ids.join(one_per_id, "source_assertion_id"), row),
        asked.select(row, "duplicate_group_id").join(_agreed(sp, "duplicate_group_id"), "duplicate_group_id"),
        asked.where("_rec is not null").select(row, F.col("_rec").alias("record_id")).join(rec_id.select("record_id", "code"), "record_id"),
    ]
    pool = answer(tries[0], 1)
    for rank, t in enumerate(tries[1:], 2):
        pool = pool.unionByName(answer(t, rank))
    first = cut(pool.groupBy(row).agg(F.min_by("code", "rank").alias("code"), F.min("rank").alias("rank")))

    # Groups whose answered rows agree lend their species to the others; last come receptor names, of which all known ones must agree.
    lent = _agreed(base.select(row, "duplicate_group_id").join(first, row), "duplicate_group_id")
    open_ = base.join(first.select(row), row, "left_anti")
    by_group = cut(answer(open_.select(row, "duplicate_group_id").join(lent, "duplicate_group_id"), 5))
    names = open_.select(row, F.explode("_names").alias("name_key")).join(by_group.select(row), row, "left_anti")
    by_name = answer(_agreed(names.join(rec_name.select("name_key", "code"), "name_key"), row), 6)
    answers = first.select(row, "rank", "code").unionByName(by_group).unionByName(by_name)
    out = base.drop("_own", "_code", "_rec", "_names").join(answers, row, "left").join(triples.dropDuplicates(["code"]).select("code", "cls", F.col("species").alias("_species"), F.col("taxon").alias("_taxon")), "code", "left")
    methods = F.array(*[F.lit(m) for m in _SPECIES_METHODS])
    return out.select(*assertions.columns, F.coalesce("cls", F.lit("UNRESOLVED")).alias("species_class"), F.coalesce("_species", F.lit("UNRESOLVED")).alias("species"),
                      F.col("_taxon").alias("taxon"), F.coalesce(F.get(methods, F.col("rank") - 1), F.lit("")).alias("species_method"))


def recover_relation(assertions: DataFrame, audit: DataFrame, relation_cols: list[str], key: str = "assertion_id") -> DataFrame:
    """Operator, its source and class: an exact one stands, else the audit rows' operator when they agree, else as stated.

    The assertions are written and numbered once; rows that share a key are answered each by its own ids.
    """
    base = cut(assertions.withColumn("_row", F.monotonically_increasing_id()))
    usable = F.coalesce(*[F.when(S.relation_class(F.col(c)).isin("EXACT", "GT_BOUND", "LT_BOUND"), S.text(F.col(c))) for c in relation_cols])
    ops = dedupe_first(audit.select("source_assertion_id", usable.alias("op")).where("op is not null"), ["source_assertion_id"], ["op"])
    open_ = base.where(S.relation_class(F.col("relation")) != "EXACT")
    ids = open_.select("_row", F.explode(F.array_distinct(F.concat(F.array(F.col(key)), S.split_ids(F.col("all_ids"))))).alias("source_assertion_id"))
    per = ids.join(ops, "source_assertion_id").select("_row", "op", S.relation_class(F.col("op")).alias("cls"))
    agreed = per.groupBy("_row").agg((F.min("cls") == F.max("cls")).alias("_ok"), F.min_by("op", F.struct(F.length("op"), F.col("op"))).alias("_op")).where("_ok").drop("_ok")
    j = base.join(agreed, "_row", "left").drop("_row")
    stated = S.relation_class(F.col("relation"))
    exact = stated == "EXACT"
    hit = F.col("_op").isNotNull()
    op = F.when(exact, "=").when(hit, F.col("_op")).when(F.upper(S.text(F.col("relation"))) == "BOUNDED", "BOUNDED").otherwise(S.text(F.col("relation")))
    src = F.when(exact, "TABLE_EXACT").when(hit, "AUDIT_SOURCE_ASSERTION").when(F.upper(S.text(F.col("relation"))) == "BOUNDED", "TABLE_DIRECTION_UNKNOWN").otherwise("TABLE")
    j = j.withColumn("relation_operator", op).withColumn("relation_source", src).drop("_op")
    return j.withColumn("relation_class", S.relation_class(F.col("relation_operator")))


def source_record_relation(df: DataFrame, relation_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Relation of a source record: relation-like fields first, then value texts; the size of a number never decides."""
    tries = []
    for c in relation_cols:
        tries.append(F.when(S.relation_class(F.col(c)).isin("EXACT", "GT_BOUND", "LT_BOUND"), F.struct(S.text(F.col(c)).alias("op"), F.lit(f"SOURCE_FIELD:{c}").alias("src"))))
        tries.append(F.when(S.detect_relation_in_text(F.col(c)) != "", F.struct(S.detect_relation_in_text(F.col(c)).alias("op"), F.lit(f"SOURCE_FIELD_TEXT:{c}").alias("src"))))
    for c in value_cols:
        tries.append(F.when(S.detect_relation_in_text(F.col(c)) != "", F.struct(S.detect_relation_in_text(F.col(c)).alias("op"), F.lit(f"SOURCE_VALUE_TEXT:{c}").alias("src"))))
    got = F.coalesce(*tries)
    return df.withColumn("source_relation", F.coalesce(got["op"], F.lit(""))).withColumn("source_relation_from", F.coalesce(got["src"], F.lit("")))


def explicit_marker(df: DataFrame, value_col: str, cols: list[str], out: str = "explicit_marker") -> DataFrame:
    """One relation marker per row over several fields; CONFLICT when their classes differ."""
    marks = [F.nullif(S.detect_relation_in_text(F.col(value_col)), F.lit(""))]
    for c in cols:
        word = F.when(F.upper(S.text(F.col(c))).isin(V.EXACT_RELATIONS + V.GT_RELATIONS + V.LT_RELATIONS), F.upper(S.text(F.col(c))))
        marks.append(F.coalesce(F.nullif(S.detect_relation_in_text(F.col(c)), F.lit("")), word))
    staged = df.withColumn("_marks", F.filter(F.array(*marks), lambda x: x.isNotNull()))
    classes = F.array_distinct(F.filter(F.transform("_marks", lambda m: S.relation_class(m)), lambda c: c != "UNKNOWN"))
    staged = staged.withColumn("_classes", classes)
    together = F.array_join("_marks", " ")
    symbol = F.coalesce(*[F.when(together.contains(s), s) for s in (">=", "<=", ">", "<", "=")], F.get("_marks", F.lit(0)))
    return staged.withColumn(out, F.when(F.size("_classes") > 1, "CONFLICT").when(F.size("_classes") == 1, symbol).otherwise("")).drop("_marks", "_classes")


def receptor_match(raw: DataFrame, cleaned: DataFrame, target: str, alias_cols: list[str], source_token: str, ligand_word: str, excluded: str) -> DataFrame:
    """Target -> raw rows through any name the target's own source rows carry; rows of excluded ligand names stay out."""
    mine = cleaned.where(F.upper(S.text(F.col("source_database"))).contains(source_token))
    aliases = mine.select(F.col(target).alias("matched_target"), F.explode(F.array(*[S.upper_key(F.col(c)) for c in alias_cols])).alias("_k")).where("_k <> '' and matched_target <> ''").distinct()
    low = F.lower(S.text(F.col("ligand")))
    rows = raw.where(low.contains(ligand_word) & ~low.rlike(excluded)).withColumn("_k", S.upper_key(F.col("receptor")))
    return rows.join(aliases, "_k").drop("_k")


def neighbor_rows(source: DataFrame, requested: DataFrame, row_col: str) -> DataFrame:
    """Rows numbered n-1, n and n+1 around every requested number."""
    wanted = requested.select(F.explode(F.sequence(F.col("requested_row") - 1, F.col("requested_row") + 1)).alias(row_col)).distinct()
    return source.join(wanted, row_col, "left_semi")


def nearest_source_record(requested: DataFrame, source: DataFrame, row_col: str, fields: list[str], token: str) -> DataFrame:
    """Best of the three neighbouring rows: highest match score, then nearest, then lower row number.

    ``requested``: request_id, requested_row, target, expected_value, source_database.
    """
    spread = requested.withColumn(row_col, F.explode(F.sequence(F.col("requested_row") - 1, F.col("requested_row") + 1)))
    j = spread.join(source.select(row_col, *[F.col(f).alias(f"rec_{f}") for f in fields]), row_col)
    score = S.record_match_score([F.col(f"rec_{f}") for f in fields], F.col("target"), F.col("expected_value"), F.col("source_database"), token)
    j = j.withColumn("match_score", score)
    best = F.struct(-F.col("match_score"), F.abs(F.col(row_col) - F.col("requested_row")), F.col(row_col))
    return j.groupBy("request_id").agg(F.min_by(F.struct(row_col, "match_score", *[f"rec_{f}" for f in fields]), best).alias("_r")).select("request_id", "_r.*")


# ---------------------------------------------------------------- expression recovery

def expression_recovery(missing: DataFrame, dictionary: DataFrame, second: DataFrame, n_tissues: int, tol: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """(status per target, recovered rows) for targets without reference values.

    ``dictionary``: target, gene_symbol, tissue, raw, z. ``second``: gene_symbol, tissue, raw (already on governed tissue
    names). The dictionary answers when its panel is complete and its z can be recomputed; otherwise the second source
    does, with z worked out here; composite genes are never split.
    """
    from .scores import zscore_within

    missing, dictionary, second = cut(missing.select("target", "gene_symbol").distinct()), cut(dictionary), cut(second)
    found = cut(fallback_join(missing, dictionary, "target", "gene_symbol").where("method <> 'NO_MATCH'"))
    scored = cut(zscore_within(found, "requested_id", "raw", "_rz"))
    audit = scored.groupBy("requested_id").agg(
        F.first("method").alias("method"), F.count(F.lit(1)).alias("rows"), F.countDistinct("tissue").alias("tissues"), F.count("raw").alias("finite_raw"),
        F.count("z").alias("finite_z"), F.max(F.abs(F.col("_rz") - F.col("z"))).alias("residual"))
    full = (F.col("rows") == n_tissues) & (F.col("tissues") == n_tissues) & (F.col("finite_raw") == n_tissues) & (F.col("finite_z") == n_tissues)
    good = cut(audit.where(full & (F.col("residual") <= tol)).select("requested_id"))
    first_rows = found.join(good, "requested_id", "left_semi").select("requested_id", "requested_gene", "tissue", "raw", "z", F.lit("FROZEN_DICTIONARY").alias("recovery_source"))

    asked = missing.select(F.col("target").alias("requested_id"), F.col("gene_symbol").alias("requested_gene")).distinct()
    pending = cut(asked.join(good, "requested_id", "left_anti").withColumn("composite", F.col("requested_gene").rlike("[;|,]")))
    cell = second.groupBy(F.upper(S.text(F.col("gene_symbol"))).alias("_g"), "tissue").agg(F.min("raw").alias("_lo"), F.max("raw").alias("raw"), F.count("raw").alias("_n"))
    cell = cell.withColumn("_clash", (F.col("_lo") != F.col("raw")) | (F.col("_n") == 0)).drop("_lo")
    got = cut(pending.where("not composite").join(cell, F.upper(S.text(F.col("requested_gene"))) == F.col("_g")))
    size = got.groupBy("requested_id").agg(F.count_if(~F.col("_clash")).alias("tissues"), F.count_if("_clash").alias("clashes"),
                                           (F.max("raw") > F.min("raw")).alias("spread"))
    complete = (F.col("tissues") == n_tissues) & (F.col("clashes") == 0)
    second_status = F.when(F.col("composite"), "COMPOSITE_GENE_NOT_SPLIT").when(F.col("tissues").isNull(), "GENE_NOT_FOUND_IN_SECOND_SOURCE").when(
        complete & F.col("spread"), "RECOVERABLE_SECOND_SOURCE").when(complete, "SECOND_SOURCE_Z_UNDEFINED").otherwise("SECOND_SOURCE_INCOMPLETE_OR_CONFLICTING")
    rest = cut(pending.join(size, "requested_id", "left").withColumn("recovery_status", second_status))
    ok2 = rest.where("recovery_status = 'RECOVERABLE_SECOND_SOURCE'").select("requested_id")
    second_rows = zscore_within(got.join(ok2, "requested_id", "left_semi"), "requested_id", "raw", "z").select(
        "requested_id", "requested_gene", "tissue", "raw", "z", F.lit("SECOND_SOURCE_RECOMPUTED").alias("recovery_source"))
    status = asked.join(good.withColumn("_ok", F.lit(True)), "requested_id", "left").join(rest.select("requested_id", F.col("recovery_status").alias("_s2")), "requested_id", "left")
    status = status.select("requested_id", "requested_gene", F.when(F.col("_ok"), "RECOVERABLE_FROZEN_DICTIONARY").otherwise(F.col("_s2")).alias("recovery_status"))
    return status, first_rows.unionByName(second_rows)
