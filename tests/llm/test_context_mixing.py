"""Language-model scores against a bit-by-bit model in plain Python, and their behaviour on odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from profilespark.llm import context_mixing as M

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
CLASH = "doc_id {}, text string, r int, key string, token string, bits double, rare int"


def table(spark, rows, kind="long"):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2.0, 3) for i, t in rows], CLASH.format(kind))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ren", "tos"], rng.integers(1, 4))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "Two wOrds ÄÖ"), (5, "A" * 70000), (6, "é😀 \x00 x\x0by\x1cz"), (7, "b" * 65 + " " + "b" * 66)]


def base(rows):
    """n_tokens, n_known, N and the base score of every row by plain counting."""
    docs = [WORDS.findall((t or "").encode().lower()) + [b"\n"] for _, t in rows]
    rest = [zlib.crc32(str(i).encode()) % 10 if i is not None else 1 for i, _ in rows]
    seen = Counter(w for d, r in zip(docs, rest) if r for w in d)
    n, v = sum(seen.values()), len(seen)
    return [(i, r == 0, len(d), sum(seen[w] > 0 for w in d), n, sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in d)) for (i, _), d, r in zip(rows, docs, rest)]


def close(got, want):
    order = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert tuple(a[:5]) == b[:5] and abs(a[5] - b[5]) < 1e-9 * max(1, abs(b[5]))


def test_base_scores_equal_plain_counts(spark, monkeypatch):
    rows = ODD + [(i, prose(i, 30 + i)) for i in range(10, 60)]
    want = base(rows)
    out = M.mixing_scores(table(spark, rows).repartition(3))
    close(out.collect(), want)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    for hot in (1, 20):  # nearly all words by the join
        monkeypatch.setattr(M, "HOT", hot)
        close(M.mixing_scores(table(spark, rows)).collect(), want)


def by_hand(text: bytes, table: np.ndarray, weights: np.ndarray, rate: float) -> float:
    """-ln p of a text's coded bytes, one bit at a time."""
    data = b" " * M.PAD + b" ".join(text.lower().split()) + b"\n"
    hashed = list(M.contexts(np.frombuffer(data, np.uint8)))
    cost, own = 0.0, None
    for at in range(M.PAD, len(data)):
        if (at - M.PAD) % M.BLOCK == 0:
            own = weights.copy()
        for half in (0, 1):
            nibble, upper = (data[at] >> 4, None) if half == 0 else (data[at] & 15, np.array([data[at] >> 4], np.uint8))
            row = [int(M.rows_at(h[at : at + 1], i, upper)[0]) + int(M.FIRST_ROW[i]) for i, h in enumerate(hashed)]
            node = 1
            for k in (3, 2, 1, 0):
                x = np.array([table[r * 16 + node] for r in row]) / M.STEP
                one = 1 / (1 + math.exp(-(own[half * 4 + 3 - k] * x).sum()))
                bit = nibble >> k & 1
                cost -= math.log(min(max(1 - abs(bit - one), M.LEAST), 1 - M.LEAST))
                own[half * 4 + 3 - k] += rate * (bit - one) * x
                node = 2 * node + bit
    return cost


def test_blocks_side_by_side_equal_one_bit_at_a_time():
    rng = np.random.default_rng(1)
    odds = rng.integers(-90, 90, int(M.FIRST_ROW[-1]) * 16).astype(np.int8)
    weights = rng.uniform(0.0, 0.4, (M.GATES, M.N_CONTEXTS))
    texts = [prose(2, 400).encode(), b"", b"One", b"x" * 1500, "é ß".encode(), prose(3, 90).encode()]
    flat = M.Flat.of([M.split(t) for t in texts])
    start, size, doc = M.blocks(flat)
    cost = np.bincount(doc, M.mix(flat.data, start, size, odds, weights, 0.01).cost)
    want = [by_hand(t, odds, weights, 0.01) for t in texts]
    assert np.abs(cost - want).max() < 1e-3 * max(want)


def test_a_block_does_not_depend_on_its_neighbours():
    odds = np.random.default_rng(2).integers(-90, 90, int(M.FIRST_ROW[-1]) * 16).astype(np.int8)
    alone, among = (M.Flat.of([M.split(t) for t in ts]) for ts in ([b"some words here"], [b"zz yy", b"some words here", b"q" * 3000]))
    a, b = (M.mix(f.data, *M.blocks(f)[:2], odds, M.first_weights(), 0.01).cost for f in (alone, among))
    assert abs(a[0] - b[1]) < 1e-6 * a[0]  # rounding of four-byte floats aside


def test_tables_hold_all_counts(spark):
    rows = [(i, prose(i % 7, 60)) for i in range(40)] + ODD
    docs = table(spark, rows)
    parts = docs.select("text").repartition(5).mapInArrow(M._count_contexts, M._PARTIAL)
    cells = 0
    for r in parts.collect():
        cells += int(M._table_counts(r["small"], r["cells"], r["counts"]).sum())
    n_bytes = sum(len(b" ".join((t or "").encode().lower().split())) + 1 for _, t in rows)
    assert cells == 2 * M.N_CONTEXTS * n_bytes
    a, b = M.context_table(docs.repartition(1)), M.context_table(docs.repartition(7))
    assert (a == b).all() and a.any()


def test_counts_of_a_range_of_any_size():
    counts = np.zeros(M.RANGE, np.uint64)
    counts[[0, 5, 9, 65535]] = [254, 255, 10**12, 1]
    for full in (counts, np.arange(M.RANGE, dtype=np.uint64) % 300, np.zeros(M.RANGE, np.uint64)):
        row = M._table_row(3, 1, full).to_pylist()[0]
        assert (M._table_counts(row["small"], row["cells"], row["counts"]) == full).all()


def test_odds_of_half_bytes():
    leaves = np.zeros((2, 16), np.uint64)
    leaves[0, 0b1010] = 7
    row = M.odds(leaves)
    high, low = round(M.STEP * math.log((7 + M.ADD) / M.ADD)), round(M.STEP * math.log(M.ADD / (7 + M.ADD)))
    assert [row[0, n] for n in (1, 0b11, 0b110, 0b1101)] == [high, low, high, low] and np.count_nonzero(row) == 4


def test_learning_beats_the_base_and_copies_get_cheap(spark):
    rows = [(i, prose(i, 200)) for i in range(150)]
    got = [r for r in M.mixing_scores(table(spark, rows)).collect() if r["held_out"]]
    assert len(got) > 5 and all(r["bits_per_byte"] < 2.2 for r in got)
    assert all(abs(r["score"] + r["bits_per_byte"] * r["n_bytes"] * math.log10(2)) < 1e-6 * abs(r["score"]) for r in got)


@pytest.mark.parametrize("kind,rows", [("long", []), ("string", [("a", "x y"), (None, None)])])
def test_empty_tables_and_other_ids(spark, kind, rows):
    got = M.mixing_scores(table(spark, rows, kind)).collect()
    assert len(got) == len(rows) and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in got)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = M.mixing_scores(table(spark, [(held, "ab")])).first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["bits_per_byte"] - 8) < 1e-6 and r["base_score"] == 0


def test_a_stage_of_the_table_has_one_python_pass(spark, monkeypatch):
    """Each pass of a stage keeps a worker of its own a core, all of which grow to the size of the scoring."""
    plans, kind = [], type(spark.range(0))
    read = kind.toLocalIterator
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a, **b: plans.append(self._jdf.queryExecution().sparkPlan().toString()) or read(self, *a, **b))
    M.context_table(table(spark, [(1, "one two two"), (2, None)]))
    assert len(plans) == 1
    assert all(stage.count("MapInArrow") <= 1 for stage in plans[0].split("Exchange"))
    assert plans[0].count("MapInArrow") == 3


def test_frequent_long_words_are_told_by_their_digest(spark):
    long = "x" * (M.LONG_WORD + 1)
    rows = [(i, f"a {long} b {long} {'y' * 90}{i}") for i in range(30)]
    close(M.mixing_scores(table(spark, rows)).collect(), base(rows))


def test_powers_are_kept_for_the_slice_only():
    assert len(M._powers(3 * M.POWERS)[0]) == 3 * M.POWERS
    list(M.contexts(np.zeros(M.SLICE + 1000, np.uint8)))
    assert M._powers.cache_info().currsize == 1
