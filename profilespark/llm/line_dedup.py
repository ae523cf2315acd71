"""Line deduplication under a small edit distance, by built-in functions only.

Lines at most ``edits`` edits apart agree exactly on one of ``edits`` + 1 segments of the shorter one (segment partition). Each distinct
line is indexed by the segments of its own length and probes, for its own and each shorter length within reach, the substrings that an
alignment with few enough edits on both sides can put against a segment. Pairs under a key pass a bound from
letter counts, then a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import SPACES, cut_by, plain

EDITS = 2
MIN_CHARS = 20
LETTERS = "eantoirhsld."


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, line_no from 0, line) for every line with a word; null texts have none."""
    t = plain(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return t.where(F.ltrim("line", F.lit(SPACES)) != "")  # ends at the first other character; a translation would read the whole line


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of a line of ``length``; the last segments take the remainder."""
    longer = length % (edits + 1)
    base = ((length - longer) / (edits + 1)).cast("int")
    return base * i + F.greatest(F.lit(0), longer - (edits + 1 - i)), base + F.when(longer >= edits + 1 - i, 1).otherwise(0)


def _key(i: int, length: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(i), length, F.substring(F.col("line"), start + 1, size))


def index_keys(edits: int) -> Column:
    """One key per segment."""
    n = F.col("chars")
    return F.array(*[_key(i, n, *_segment(n, i, edits)) for i in range(edits + 1)])


def probe_keys(edits: int) -> Column:
    """Keys of the further substrings that can meet a segment of an equally long or shorter line."""
    out, n = [], F.col("chars")
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            start, size = _segment(n - shorter, i, edits)
            for off in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                if shorter or off:
                    out.append(_key(i, n - shorter, start + off, size))
    return F.array(*out)


def letter_counts() -> Column:
    """Counts of twelve frequent characters, modulo 32, in one number."""
    count = lambda c: (F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))).bitwiseAND(F.lit(31)).cast("long")
    return sum((F.shiftleft(count(c), 5 * k) for k, c in enumerate(LETTERS)), F.lit(0).cast("long"))


def _letters_apart(x: str, y: str) -> Column:
    """At most twice the edits between the lines: an edit changes two counts by one at most, and a remainder by no more than its count."""
    part = lambda c, k: F.shiftright(F.col(c), 5 * k).bitwiseAND(F.lit(31))
    apart = lambda k: F.abs(part(x, k) - part(y, k))
    return sum((F.least(apart(k), 32 - apart(k)) for k in range(len(LETTERS))), F.lit(0))


def banded_distance(a: str, b: str, edits: int) -> Column:
    """Edit distance of two columns of character arrays if it is at most ``edits``, else some larger number; ``a`` is not the shorter
    one, not over ``edits`` longer than ``b``, and has at least ``edits`` characters.

    A word of 2 x edits + 1 bits holds the vertical differences of the band around the diagonal; each character of ``b`` moves it one
    row down. The distance is followed along the lowest diagonal of the band to the last row, then along that row.
    """
    band = 2 * edits + 1
    full = (1 << band) - 1
    n = F.size(a)

    def step(s, j):
        matches = sum(F.when((j - edits + t >= 1) & (F.get(F.col(a), j - edits + t - 1) == F.get(F.col(b), j - 1)), 1 << t).otherwise(0) for t in range(band))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), matches.alias("eq"), j.alias("j"))

    def diagonal(s):
        zero = (((s["eq"].bitwiseAND(s["vp"])) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(s["eq"]).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), s["j"].alias("j"), zero.alias("zero"))

    def sides(s):
        up = s["vn"].bitwiseOR(F.lit(full) - s["zero"].bitwiseOR(s["vp"]))
        return F.struct(s["d"].alias("d"), s["j"].alias("j"), s["zero"].alias("zero"), up.alias("up"), s["zero"].bitwiseAND(s["vp"]).alias("down"))

    def settle(s):
        low, row = F.shiftright(s["zero"], 1), n - s["j"] + edits
        last = F.when(s["j"] + edits <= n, 1 - F.shiftright(s["zero"], band - 1)).otherwise(F.getbit(s["up"], F.greatest(row, F.lit(0))).cast("int") - F.getbit(s["down"], F.greatest(row, F.lit(0))).cast("int"))
        return F.struct((s["down"].bitwiseOR(F.lit(full) - low.bitwiseOR(s["up"]))).alias("vp"), low.bitwiseAND(s["up"]).alias("vn"), (s["d"] + last).alias("d"))

    def let(value, fn):
        return F.get(F.transform(F.array(value), fn), F.lit(0))

    first = F.struct(F.lit(full >> edits << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.size(b)), first, lambda s, j: let(let(let(step(s, j), diagonal), sides), settle), lambda s: s["d"])


def _common_prefix(a: Column, b: Column, most: Column) -> Column:
    """Characters that two strings share at their start, up to ``most``, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(26, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, step: F.when((p + step <= most) & (F.substring(a, p + 1, step) == F.substring(b, p + 1, step)), p + step).otherwise(p))


def _middles(pairs: DataFrame, edits: int) -> DataFrame:
    """Columns a and b without the start and end that they share, but for ``edits`` characters that stay in front."""
    ahead = pairs.withColumn("p", F.greatest(F.lit(0), _common_prefix(F.col("a"), F.col("b"), F.length("b")) - edits))
    rest = ahead.withColumns({c: F.substring(F.col(c), F.col("p") + 1, F.length(c)) for c in ("a", "b")})
    behind = rest.withColumn("s", _common_prefix(F.reverse("a"), F.reverse("b"), F.length("b") - edits))
    return behind.withColumns({c: F.split(F.substring(F.col(c), F.lit(1), F.length(c) - F.col("s")), "") for c in ("a", "b")})


def near_lines(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(line_hash, near_hash, distance) both ways for the pairs of distinct lines of at least ``min_chars`` characters within ``edits``.

    ``lines`` has line_hash (distinct), line, chars and letters, and is read several times.
    """
    if min_chars < 3 * (edits + 1):
        raise ValueError("lines must have at least three characters for each segment")
    able = lines.where(F.col("chars") >= min_chars)
    index = able.select("line_hash", "letters", index_keys(edits).alias("keys")).select(F.col("line_hash").alias("ix"), F.col("letters").alias("ix_letters"), F.explode("keys").alias("key"))
    probe = able.select("line_hash", "letters", probe_keys(edits).alias("keys")).select(F.col("line_hash").alias("pr"), F.col("letters").alias("pr_letters"), F.explode("keys").alias("key"))
    close_by = _letters_apart("ix_letters", "pr_letters") <= 2 * edits
    same = index.join(index.select(F.col("ix").alias("pr"), F.col("ix_letters").alias("pr_letters"), "key"), "key").where((F.col("pr") > F.col("ix")) & close_by)
    moved = index.join(probe, "key").where((F.col("pr") != F.col("ix")) & close_by)
    both = same.select("pr", "ix").unionByName(moved.select("pr", "ix"))
    pairs = cut(both.select(F.least("pr", "ix").alias("x"), F.greatest("pr", "ix").alias("y")).distinct())
    text = lines.select("line_hash", "line")
    # The few pairs are hashed and the texts stream past them unsorted.
    told = text.withColumnsRenamed({"line_hash": "x", "line": "a"}).join(pairs.hint("shuffle_hash"), "x")
    told = text.withColumnsRenamed({"line_hash": "y", "line": "b"}).join(told.hint("shuffle_hash"), "y")
    longer = F.length("a") >= F.length("b")
    ordered = told.select("x", "y", F.when(longer, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(longer, F.col("b")).otherwise(F.col("a")).alias("b"))
    measured = cut(_middles(ordered, edits).select("x", "y", banded_distance("a", "b", edits).alias("distance")))  # written first: a filter above would be worked into it
    close = measured.where(F.col("distance") <= edits)
    return close.select(F.col("x").alias("line_hash"), F.col("y").alias("near_hash"), "distance").unionByName(close.select(F.col("y").alias("line_hash"), F.col("x").alias("near_hash"), "distance"))


def line_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line with a word: doc_id, text_hash, line_no (from 0), first_doc_id, first_line_no, distance and removed.

    Lines are ordered by document id and line number. The match of a line is the first line equal to it, or (both of at least
    ``min_chars`` characters) within ``edits`` edits of it, whichever stands earlier; a line with an earlier match is removed. Rows that
    share an id share their places: a line that stands first there stays in each. Null texts and blank lines have no rows; a null id orders
    first.
    """
    occurrences = lines_of(docs, doc_id, text)
    place = F.struct("doc_id", "line_no")
    hashed = occurrences.select(F.xxhash64("line").alias("line_hash"), place.alias("place"), "line")
    lines = cut_by(hashed.groupBy("line_hash").agg(F.min("place").alias("first"), F.first("line").alias("line")).withColumns({"chars": F.length("line"), "letters": letter_counts()}), "line_hash")
    near = near_lines(lines, edits, min_chars)
    firsts = lines.select("line_hash", "first")
    best = near.join(firsts.select(F.col("line_hash").alias("near_hash"), F.col("first").alias("near")), "near_hash").groupBy("line_hash").agg(F.min(F.struct("near", "distance")).alias("best"))
    own = firsts.join(best, "line_hash", "left")
    nearer = F.coalesce(F.col("best.near") < F.col("first"), F.lit(False))
    matched = cut(own.select("line_hash", F.when(nearer, F.col("best.near")).otherwise(F.col("first")).alias("match"), F.when(nearer, F.col("best.distance")).otherwise(0).alias("distance")))
    placed = occurrences.select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("line_hash")).join(matched, "line_hash")
    return placed.select("doc_id", "text_hash", "line_no", F.col("match.doc_id").alias("first_doc_id"), F.col("match.line_no").alias("first_line_no"), "distance", (F.col("match") != F.struct("doc_id", "line_no")).alias("removed"))


def drop_lines(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """The documents with the lines that ``matches`` removes cut out of their text; every row and every other column stays as it is."""
    gone = matches.where("removed").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_set("line_no")).alias("_gone"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_hash"]), "left")
    whole, drop = F.split(docs["text"], "\n"), gone["_gone"]
    before = lambda i: F.coalesce(F.get(drop, i - 1), F.lit(-1))
    runs = F.transform(F.sequence(F.lit(0), F.size(drop)), lambda i: F.slice(whole, before(i) + 2, F.coalesce(F.get(drop, i), F.size(whole)) - before(i) - 1))
    kept = F.when(drop.isNull(), docs["text"]).otherwise(F.array_join(F.flatten(runs), "\n"))
    return joined.select(*[kept.alias("text") if c == "text" else docs[c] for c in docs.columns])
