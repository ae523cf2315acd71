"""Exact quantiles of groups of any size by distributed selection.

A group of more than ``LIMIT`` values is narrowed first: its values are counted per range (``RANGES`` equal parts of its span, by a partial
aggregate), the range that holds the wanted rank replaces the span, and what lies below it is remembered, until at most ``LIMIT`` values or
one single value is left. Then the distinct values of what is left are ranked. No task ever holds a group's values, and only the ranges that
hold a rank are shuffled; the driver sees one number a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

LIMIT = 1 << 16
RANGES = 1024
LARGEST = 1.7976931348623157e308


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on the keys, null keys being equal as they are in a grouping; the columns of ``a`` come first."""
    b = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return a.join(b, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _range() -> Column:
    """The part of (lo, hi) that v lies in; the ends are in the first and the last one, so a span of two values always parts."""
    low, high = F.greatest("lo", F.lit(-LARGEST)), F.least("hi", F.lit(LARGEST))
    share = F.try_divide(F.col("v") / 2 - low / 2, high / 2 - low / 2)
    inner = F.least(F.greatest(F.floor(share * RANGES), F.lit(0)), F.lit(RANGES - 1))
    return F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") >= F.col("hi"), RANGES - 1).otherwise(inner).cast("int")


def _narrowed(values: DataFrame, keys: list[str], wide: DataFrame) -> DataFrame:
    """Every wide span replaced by its range that holds rank ``at``, with the number of values below it."""
    inside = same_keys(values, wide, keys, "inner").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    counts = inside.groupBy(*keys, "at", "below", _range().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    order = Window.partitionBy(*keys).orderBy("part")  # at most RANGES rows a key
    through = F.sum("n").over(order) + F.col("below")
    ranked = counts.withColumn("through", through).withColumn("next", F.lead("lo").over(order))
    held = ranked.where((F.col("through") > F.col("at")) & (F.col("through") - F.col("n") <= F.col("at")))
    return held.select(*keys, "at", (F.col("through") - F.col("n")).alias("below"), "n", "lo", "hi", F.col("next").alias("above"))


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row per key with a column per wanted (value, share): the quantile between the two nearest ranks.

    Nulls and NaN are left out; a key without any value has no row, and null in the columns that it has no value for. Null keys are one
    group. Infinite values rank at the ends.
    """
    names = list(wanted)
    own = [f"_g{i}" for i in range(len(keys))]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), value.cast("double").alias("v")) for i, (value, _) in enumerate(wanted.values())]))
    values = cut(df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], each.alias("_e")).select(*own, "_e.which", "_e.v").where("v is not null and not isnan(v)"))
    groups = [*own, "which"]
    share = F.element_at(F.array(*[F.lit(float(q)) for _, q in wanted.values()]), F.col("which") + 1)
    spans = values.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    spans = cut(spans.withColumn("pos", (F.col("n") - 1) * share).withColumn("at", F.floor("pos")))
    position = spans.select(*groups, (F.col("pos") - F.col("at")).alias("_part"))
    open_ = spans.select(*groups, "at", F.lit(0).cast("long").alias("below"), "n", "lo", "hi", F.lit(None).cast("double").alias("above"))
    wide = (F.col("n") > LIMIT) & (F.col("hi") > F.col("lo"))
    while open_.where(wide).limit(1).count():
        split = _narrowed(values, groups, open_.where(wide).select(*groups, "at", "below", "lo", "hi"))
        outer = open_.where(wide).select(*groups, F.col("above").alias("_above"))
        split = same_keys(split, outer, groups).withColumn("above", F.coalesce("above", "_above")).drop("_above")
        open_ = cut(open_.where(~wide).unionByName(split))
    left = same_keys(values, open_, groups, "inner").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    ties = left.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("m"), F.max("at").alias("at"), F.max("below").alias("below"), F.max("above").alias("above"))
    order = Window.partitionBy(*groups).orderBy("v")
    ranked = ties.withColumn("through", F.sum("m").over(order) + F.col("below")).withColumn("next", F.coalesce(F.lead("v").over(order), F.col("above")))
    held = ranked.where((F.col("through") > F.col("at")) & (F.col("through") - F.col("m") <= F.col("at")))
    upper = F.when(F.col("through") > F.col("at") + 1, F.col("v")).otherwise(F.col("next"))
    picked = same_keys(held.select(*groups, "v", upper.alias("_upper")), position, groups)
    blend = F.when((F.col("_part") == 0) | (F.col("_upper") == F.col("v")), F.col("v")).otherwise((1 - F.col("_part")) * F.col("v") + F.col("_part") * F.col("_upper"))
    out = picked.select(*own, "which", blend.alias("_q")).groupBy(*own).agg(*[F.max(F.when(F.col("which") == i, F.col("_q"))).alias(c) for i, c in enumerate(names)])
    return out.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], *names)


def with_quantiles(aggregated: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """An aggregate of ``df`` by the keys with its quantiles beside it."""
    return same_keys(aggregated, exact_quantiles(df, keys, wanted), keys)
