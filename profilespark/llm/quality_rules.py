"""Quality rules: text statistics as column expressions, and ordered rules learned from labelled statistics by sequential covering.

A rule is a conjunction of thresholds on shares of the text. It is grown one condition at a time on two thirds of the labelled rows, each
time from one aggregate of label counts by feature and step, then cut back on the remaining third, and kept while its smoothed purity
there is high enough. The rows it covers leave, and the next rule is learned from what is left. The rules end as one Spark conditional.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import SPACE_RUN, SPACES, UPPER, plain

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
STEPS = 64  # thresholds lie on a grid of this many steps to one

#: Learned-on features: the share and the factor that brings it to about one.
FEATURES = {
    "symbols": "try_divide(n_symbols, n_words)",
    "repeats": "try_divide(n_repeat_words, n_words)",
    "same_lines": "try_divide(n_dup_lines, n_lines)",
    "capitals": "try_divide(n_capitals, word_chars)",
    "marks": "try_divide(n_marks, n_words)",
    "digits": "try_divide(n_digits, word_chars)",
    "word_length": "try_divide(word_chars, n_words * 16)",
    "distinct": "try_divide(n_distinct, n_words)",
}


def _count(c: Column, characters: str) -> Column:
    return (F.length(c) - F.length(F.translate(c, characters, ""))).cast("long")


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text (null reads as empty), one row per input row, by built-in functions only.

    n_repeat_words counts the words in 8-word windows found twice or more in the text: windows are compared by 64-bit hashes, only texts
    with a repeated window sort theirs, and overlapping windows count each word once.
    """
    t = plain(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    body = F.btrim("text", F.lit(SPACES))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != ""), lambda x: F.xxhash64(x))
    t = t.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"), lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"), _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("text"), UPPER).alias("n_capitals"), _count(F.col("text"), "!?").alias("n_marks"), _count(F.col("text"), "0123456789").alias("n_digits"))
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    counts = ["doc_id", "text_hash", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_digits"]
    t = t.select(
        *counts, F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("windows"))
    counts += ["n_words", "n_distinct", "n_lines", "n_dup_lines"]
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    t = t.select(*counts, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered).otherwise(none).alias("w"))
    twice = F.filter(F.transform("w", lambda x, j: F.when(
        ((j > 0) & (F.get("w", j - 1)["h"] == x["h"])) | F.coalesce(F.get("w", j + 1)["h"] == x["h"], F.lit(False)), x["at"])), lambda p: p.isNotNull())
    covered = F.aggregate(
        F.array_sort(twice), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(p, s["upto"])).alias("n"), (p + WINDOW).alias("upto")), lambda s: s["n"].cast("long"))
    return t.select(*counts, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature`` at least, or (``above`` false) below, ``step`` / STEPS."""

    feature: str
    above: bool
    step: int

    def column(self) -> Column:
        c = F.coalesce(F.expr(FEATURES[self.feature]), F.lit(0.0))
        return c >= self.step / STEPS if self.above else c < self.step / STEPS

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.step / STEPS:.4g}"


@dataclass
class DecisionList:
    """Conjunctions in order; a text that meets one is rejected, any other is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rejects(self) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(True)).otherwise(out)
        return out


def _all(rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _counts(rows: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
    """Bad and good rows by feature and grid step: at most features x (STEPS + 2) rows whatever the input."""
    step = lambda c: F.least(F.lit(STEPS + 1), F.floor(F.coalesce(c, F.lit(0.0)) * STEPS)).cast("int")
    steps = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), step(F.expr(c)).alias("step")) for name, c in FEATURES.items()])).alias("s")
    table = rows.select("bad", steps).groupBy("s.feature", "s.step").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    out: dict[str, list[tuple[int, int, int]]] = {}
    for r in table.collect():
        out.setdefault(r.feature, []).append((r.step, r.bad, r.good))
    return out


def _best(counts, bad: int, good: int) -> tuple[float, Condition | None, int, int]:
    """The threshold with the largest information gain over the rows given; ties go to the first feature and step."""
    share = math.log2((bad + 1) / (bad + good + 2))
    best: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for feature in FEATURES:
        rows = sorted(counts.get(feature, []))
        under_bad = under_good = 0
        for at, (step, b, g) in enumerate(rows):
            if at:
                for above, x, y in ((True, bad - under_bad, good - under_good), (False, under_bad, under_good)):
                    gain = x * (math.log2((x + 1) / (x + y + 2)) - share)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(feature, above, step), x, y)
            under_bad, under_good = under_bad + b, under_good + g
    return best


def learn_rules(labelled: DataFrame, max_rules: int = 12, max_conditions: int = 3, purity: float = 0.9, least: int = 8) -> DecisionList:
    """Decision list from text statistics with a ``bad`` column (0 or 1) and a ``doc_id``.

    A rule stands if it covers at least ``least`` bad rows of the growing part, and (bad + 1) / (covered + 2) reaches ``purity`` over the
    pruning part, or over both parts where fewer than ``least`` rows of the pruning part are covered. No labels: an empty list.
    """
    learned = DecisionList()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    while len(learned.rules) < max_rules:
        left = labelled.where(~learned.rejects())
        rule: list[Condition] = []
        bad = good = x = 0
        while len(rule) < max_conditions:
            counts = _counts(left.where(~held & _all(rule)))
            if not counts:
                break
            bad, good = (sum(r[i] for r in next(iter(counts.values()))) for i in (1, 2))
            gain, condition, x, y = _best(counts, bad, good)
            if condition is None or (rule and good == 0):
                break
            rule.append(condition)
        if not rule:
            break
        prefixes = [F.sum(F.when(h & _all(rule[: k + 1]) & (F.col("bad") == b), 1).otherwise(0)).alias(f"{n}{b}{k}") for k in range(len(rule)) for n, h in (("held", held), ("grow", ~held)) for b in (0, 1)]
        seen = left.agg(*prefixes).first()
        judged = []
        for k in range(len(rule)):
            b, g = seen[f"held1{k}"] or 0, seen[f"held0{k}"] or 0
            grown = seen[f"grow1{k}"] or 0
            if b + g < least:
                b, g = b + grown, g + (seen[f"grow0{k}"] or 0)
            judged.append(((b - g) / max(1, b + g), -k, (b + 1) / (b + g + 2), grown))
        value, k, smoothed, grown = max(judged)
        if smoothed < purity or grown < least:
            break
        learned.rules.append(tuple(rule[: 1 - k]))
    return learned


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Statistics of every document with base_failed and kept.

    ``labels`` has the same id column and ``quality`` (1 good, 0 bad, null ignored). Null texts read as empty and fail the base rule, as
    does any text under 20 words. Labels without a document, repeated rows and further columns do no harm; a null id is judged like any
    other row but never learned from. Without documents the result is empty, without labels only the base rule decides.
    """
    stats = cut(text_statistics(docs, doc_id, text).withColumn("base_failed", base_failed()))
    marks = plain(labels, doc_id=doc_id, quality=quality).where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = cut(stats.where("not base_failed").join(marks, "doc_id").withColumn("bad", (F.col("quality") == 0).cast("int")))
    return stats.withColumn("kept", ~F.col("base_failed") & ~learn_rules(labelled).rejects())


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document; see ``judged``."""
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns; rows are matched by id and text, so repeated ids are judged apart."""
    good = judged(docs, labels).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    key = docs["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == good["_hash"])
    return docs.join(good, key, "left_semi")
