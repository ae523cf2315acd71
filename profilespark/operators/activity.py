"""Selection of one activity per target and the tables around it.

Every choice is made on fixed-width numbers: hash aggregates find, per endpoint and relation class, the best value, then the endpoint and
class that win, and only the rows that hold the winning value are fetched and ordered by their id. Partial results are combined before every
shuffle, and a target with a large share of the rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab as V
from ..session import cut
from .winners import first_by, on_keys, renamed

BEST_DIGITS = 9  # pActivity is compared at this precision so that unit conversion noise never decides a tie


def _prepared(df: DataFrame, keys: list[str], cols: list[str], p: str, molar: str, order: str, rel: str, endpoint: str, species: str | None) -> DataFrame:
    """The rows with their pool, class, endpoint rank, whether they can be chosen, and the value that decides inside their class."""
    bound = F.col(rel).isin("GT_BOUND", "LT_BOUND")
    able = F.when(F.col(rel) == "EXACT", F.col(p).isNotNull()).otherwise(F.coalesce((F.col(molar) > 0) & F.col(p).isNotNull(), F.lit(False)))
    return df.select(
        *keys, *[F.col(c).alias(f"_c_{c}") for c in cols], F.col(order).alias("_order"), (F.col(species) if species else F.lit("")).alias("_pool"), F.col(rel).alias("_rel"),
        S.endpoint_priority(F.col(endpoint)).alias("_ep"), able.alias("_able"), F.when(bound, F.col(molar)).otherwise(F.round(F.col(p), BEST_DIGITS)).cast("double").alias("_value"))


def _ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, pool and endpoint rank: rows per class, those that can be chosen, and the best value of each class."""
    def usable(cls):
        return (F.col("_rel") == cls) & F.col("_able")

    def best(cls, agg):
        return agg(F.when(usable(cls), F.col("_value")))

    return rows.groupBy(*keys, "_pool", "_ep").agg(
        F.count_if(F.col("_rel") == "EXACT").alias("n_exact"), F.count_if(F.col("_rel").isin(V.BOUNDED_CLASSES)).alias("n_bounded"),
        F.count_if(usable("GT_BOUND")).alias("gt"), F.count_if(usable("LT_BOUND")).alias("lt"), F.count_if(usable("BOUNDED_DIRECTION_UNKNOWN")).alias("un"),
        best("EXACT", F.max).alias("exact_value"), best("GT_BOUND", F.max).alias("gt_value"), best("LT_BOUND", F.min).alias("lt_value"), best("BOUNDED_DIRECTION_UNKNOWN", F.max).alias("un_value"))


_BOUND = ["gt", "lt", "un", "gt_value", "lt_value", "un_value"]


def _pool(where: Column, prefix: str) -> list[Column]:
    """Over the endpoint rows of one pool: is it there, how many rows of either kind, and the first endpoint of each kind with its values."""
    exact = F.when(where & (F.col("n_exact") > 0), F.col("_ep"))
    bounded = F.when(where & (F.col("n_bounded") > 0), F.col("_ep"))
    found = {
        "there": F.max(where), "n_exact": F.sum(F.when(where, F.col("n_exact"))), "n_bounded": F.sum(F.when(where, F.col("n_bounded"))),
        "exact_ep": F.min(exact), "exact_value": F.min_by("exact_value", exact), "bounded_ep": F.min(bounded),
    } | {c: F.min_by(c, bounded) for c in _BOUND}
    return [v.alias(f"{prefix}{k}") for k, v in found.items()]


def _as_struct(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{k}").alias(k) for k in ("there", "n_exact", "n_bounded", "exact_ep", "exact_value", "bounded_ep", *_BOUND)])


def _bound_rule(c: Column) -> Column:
    gt, lt, un = c["gt"], c["lt"], c["un"]
    return (
        F.when(c["bounded_ep"].isNull(), "NO_ELIGIBLE_BOUNDED_ENDPOINT")
        .when(gt + lt + un == 0, "NO_NONZERO_NUMERICAL_BOUNDARY")
        .when((gt > 0) & (lt > 0), "MIXED_BOUND_DIRECTIONS_REVIEW_REQUIRED")
        .when(gt > 0, "GT_TIGHTEST_LOWER_CONCENTRATION_BOUND")
        .when(lt > 0, "LT_TIGHTEST_UPPER_CONCENTRATION_BOUND")
        .otherwise("UNKNOWN_DIRECTION_PROVISIONAL_STRONGEST_BOUNDARY")
    )


def _pick(ep: Column, cls: Column | str, value: Column) -> Column:
    cls = F.lit(cls) if isinstance(cls, str) else cls
    return F.when(value.isNotNull(), F.struct(ep.alias("ep"), cls.alias("rel"), value.alias("value")))


def _bound_pick(c: Column) -> Column:
    """Endpoint, class and value of the bound that the rule takes."""
    cls = F.when(c["gt"] > 0, "GT_BOUND").when(c["lt"] > 0, "LT_BOUND").otherwise("BOUNDED_DIRECTION_UNKNOWN")
    value = F.when(c["gt"] > 0, c["gt_value"]).when(c["lt"] > 0, c["lt_value"]).otherwise(c["un_value"])
    return F.when(~((c["gt"] > 0) & (c["lt"] > 0)), _pick(c["bounded_ep"], cls, value))


def _fetched(rows: DataFrame, choice: DataFrame, keys: list[str], cols: list[str], kept: list[str]) -> DataFrame:
    """Every choice (keys, kept columns, _from, _pick) with the columns of its row: of the rows that hold the picked value, the smallest id."""
    made = choice.where("_pick is not null").select(*renamed(choice, keys), *kept, F.col("_from").alias("_p"), "_pick.*")
    same = on_keys(keys) & F.col("_pool").eqNullSafe(F.col("_p")) & (F.col("_ep") == F.col("ep")) & (F.col("_rel") == F.col("rel")) & (F.col("_value") == F.col("value"))
    found = first_by(rows.where("_able").join(made, same), keys, ["_order"])
    none = choice.where("_pick is null").select(*keys, *kept, *[F.lit(None).cast(dict(rows.dtypes)[f"_c_{c}"]).alias(c) for c in cols])
    return found.select(*keys, *kept, *[F.col(f"_c_{c}").alias(c) for c in cols]).unionByName(none)


def choose_exact(df: DataFrame, keys: list[str], cols: list[str], p="pactivity", molar="molar", order="assertion_id",
                 rel="relation_class", endpoint="activity_type") -> DataFrame:
    """Best exact row per key: endpoint rank, then highest pActivity, then id. No row where none is selectable."""
    rows = cut(_prepared(df.where(F.col(rel) == "EXACT"), keys, cols, p, molar, order, rel, endpoint, None))
    best = _ends(rows, keys).groupBy(*keys).agg(F.min("_ep").alias("ep"), F.min_by("exact_value", "_ep").alias("value"))
    choice = best.select(*keys, F.lit("").alias("_from"), _pick(F.col("ep"), "EXACT", F.col("value")).alias("_pick")).where("_pick is not null")
    return _fetched(rows, choice, keys, cols, [])


def choose_bounded(df: DataFrame, keys: list[str], cols: list[str], p="pactivity", molar="molar", order="assertion_id",
                   rel="relation_class", endpoint="activity_type") -> DataFrame:
    """Tightest bound per key with the rule applied; opposite bounds in one endpoint yield no row but a reason."""
    rows = cut(_prepared(df.where(F.col(rel).isin(V.BOUNDED_CLASSES)), keys, cols, p, molar, order, rel, endpoint, None))
    ends = _ends(rows, keys).groupBy(*keys).agg(*_pool(F.lit(True), "_b_")).select(*keys, _as_struct("_b_").alias("_c"))
    choice = cut(ends.select(*keys, _bound_rule(F.col("_c")).alias("bound_rule"), F.lit("").alias("_from"), _bound_pick(F.col("_c")).alias("_pick")))
    return _fetched(rows, choice, keys, cols, ["bound_rule"])


def select_activity(df: DataFrame, keys: list[str], cols: list[str], p="pactivity", molar="molar", order="assertion_id",
                    rel="relation_class", endpoint="activity_type", species="species_class") -> DataFrame:
    """One row per key from measured rows: human pool before mammal pool, exact before bounded inside the pool.

    Exact rows that yield no choice do not fall through to bounded ones.
    """
    rows = cut(_prepared(df.where(F.col(p).isNotNull()), keys, cols, p, molar, order, rel, endpoint, species))
    pools = {"HUMAN": "_h_", "MAMMALIAN_NONHUMAN": "_m_"}
    both = _ends(rows, keys).groupBy(*keys).agg(*[c for name, prefix in pools.items() for c in _pool(F.coalesce(F.col("_pool") == name, F.lit(False)), prefix)])
    human, mammal = F.col("_h_there"), F.col("_m_there")
    basis = F.when(human, "HUMAN_PRIORITY").when(mammal, "MAMMALIAN_FALLBACK").otherwise("")
    source = F.when(human, "HUMAN").when(mammal, "MAMMALIAN_NONHUMAN")
    out = both.select(*keys, basis.alias("species_basis"), source.alias("_from"), F.when(human, _as_struct("_h_")).when(mammal, _as_struct("_m_")).alias("_p"))
    exact_tried, bounded_tried = F.coalesce(F.col("_p.n_exact") > 0, F.lit(False)), F.coalesce(F.col("_p.n_bounded") > 0, F.lit(False))
    pick = F.when(exact_tried, _pick(F.col("_p.exact_ep"), "EXACT", F.col("_p.exact_value"))).when(bounded_tried, _bound_pick(F.col("_p")))
    rule = F.when(~exact_tried & bounded_tried, _bound_rule(F.col("_p"))).otherwise("")
    kind = F.when(F.col("_pick").isNull(), "").when(F.col("_x"), "EXACT_MEASURED").otherwise("BOUNDED_MEASURED_BOUNDARY")
    choice = cut(out.select(*keys, "species_basis", "_from", rule.alias("bound_selection_rule"), pick.alias("_pick"), exact_tried.alias("_x")).withColumn("selection_kind", kind))
    return _fetched(rows, choice, keys, cols, ["species_basis", "selection_kind", "bound_selection_rule"])
