"""The text operators against brute force, and their behaviour on nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from profilespark.llm import knn, licenses, line_dedup, packing, pairwise_ranking, passages, pieces, quality_rules, simhash, url_filter
from profilespark.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = "doc_id long, text string, key int, fp long, line string, length long, ids string, _id long, bad int, hash string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, "y", 4, 5, "z") for i, t in rows], CLASH)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ren", "tos", "vu", "zeb", "pra"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "two words"), (5, "A" * 70000), (6, prose(1, 6000)), (7, "é😀 \x00 x\x0by")]


# ---- packing

def test_plan_equals_one_at_a_time():
    rng = random.Random(3)
    for _ in range(150):
        size = rng.choice([7, 16, 50, 64])
        histogram = {n: rng.randint(1, 9) for n in range(1, size + 1) if rng.random() < 0.6}
        bins = []
        for n in sorted(histogram, reverse=True):
            for _ in range(histogram[n]):
                able = [b for b, left in enumerate(bins) if left >= n]
                if able:
                    bins[min(able, key=bins.__getitem__)] -= n
                else:
                    bins.append(size - n)
        assert packing.best_fit(histogram, size).bins == len(bins)


def packed(rows):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    return len(places)


def test_pack(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    docs = table(spark, ODD)
    rows = packing.pack(docs, BPE).collect()
    packed(rows)
    want = Counter()
    for i, text in ODD:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack(docs.limit(0), BPE).count() == 0
    whole = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), BPE).collect()
    assert packed(whole) <= sum(r.length for r in whole) / 4096 + 2


# ---- URL filter

def test_rules_and_addresses(spark):
    urls = ["http://www.Example.com/en/1", "https://example.com/en/", "https://a.example.com/en/x?q", "http://example.com/de/", "ftp://x.net/es/9#a", "http://x.net/fr", "http://net/fr/", "x.com/en/", None, "http://com", "http://com/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, none).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en/", "example.com/en/", "block") and got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3][2:] == ("com/", "allow") and got[4] == ("x.net", "/es/9", "net/es/", "block")
    assert got[5][2:] == (None, "allow") and got[6][2:] == ("net/fr/", "block")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9] == ("com", "", None, "allow") and got[10][2] == "com/"
    assert got[11][:2] == ("b:", "//c/d")
    assert url_filter.url_verdicts(pages.limit(0), none).count() == 0


def test_template_tree_splits_where_labels_differ(spark):
    rows = [(i, f"http://h.org/{'ads' if i % 3 == 0 else 'news' if i % 3 == 1 else 'blog'}/{i}/{'/'.join('abcdefghij') if i == 5 else ''}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i in range(0, 600, 2)] + [(0, 1), (None, 1), (4, None)], "page_id long, bad int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.url_verdicts(pages, labels, rules=[]).collect()}
    assert all(v == (("block" if i % 3 == 0 else "allow")) for i, (_, v) in got.items())
    assert {t for i, (t, _) in got.items() if i % 3 == 0} == {"/ads/*"}


# ---- passages

def planted():
    rng = random.Random(5)
    passage = prose(77, 60).split()
    rows = [(i, prose(100 + i, rng.randint(30, 300))) for i in range(20)]
    for i in (3, 8, 15):
        words, mine = rows[i][1].split(), list(passage)
        if i == 15:
            mine[20] = "CHANGED"
            del mine[41]
        rows[i] = (i, " ".join(words[:10] + mine + words[10:]))
    return rows + [(40, prose(900, 400)), (41, prose(900, 400)), (42, prose(900, 49))]


def test_passages(spark):
    docs = table(spark, planted() + [(500 + (i or 0), t) for i, t in ODD])
    rows = passages.repeated_passages(docs).collect()
    found = {(r.doc_id, r.source_doc_id) for r in rows}
    assert found == {(8, 3), (15, 3), (41, 40)}
    spans = {r.doc_id: (r.passage_start, r.passage_end) for r in rows}
    assert spans[8] == (10, 70) and spans[15] == (10, 69) and spans[41] == (0, 400)
    kept = {r.doc_id: r.text for r in passages.drop_passages(docs, passages.repeated_passages(docs)).collect()}
    source = dict(planted())
    assert kept[8].split() == source[8].split()[:10] + source[8].split()[70:] and kept[3] == source[3] and kept[41] == "" and kept[501] is None
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_exact_blocks_survive_their_chain(spark):
    """Five exact blocks of 50 words with 22 other words in between: no chain of three or more reaches the similarity."""
    for seed in range(3):
        blocks = [prose(1000 + 10 * seed + i, 50) for i in range(5)]
        rows = [(d, " ".join(w for i, b in enumerate(blocks) for w in (prose(2000 + 100 * seed + 10 * d + i, 22), b))) for d in (1, 2)]
        found = passages.repeated_passages(table(spark, rows)).collect()
        got = {w for r in found for w in range(r.passage_start, r.passage_end)}
        assert got >= {w for i in range(5) for w in range(22 + 72 * i, 72 + 72 * i)}
        assert all(r.doc_id == 2 and r.source_doc_id == 1 and r.similarity >= passages.SIMILARITY for r in found)


def test_every_copy_in_one_document(spark):
    """A document with another's passage three times loses all three copies; one that repeats a passage of its own keeps the first."""
    shared, own, fill = prose(3001, 60).split(), prose(3002, 60).split(), [prose(3010 + i, 80).split() for i in range(8)]
    rows = [(1, fill[0] + shared + fill[1]), (2, fill[2] + shared + fill[3] + shared + fill[4] + shared), (3, fill[5] + own + fill[6] + own + fill[7] + own)]
    docs = table(spark, [(i, " ".join(words)) for i, words in rows])
    found = passages.repeated_passages(docs)
    assert all((r.source_doc_id, r.source_start) < (r.doc_id, r.start_word) for r in found.collect())
    kept = {r.doc_id: r.text.split() for r in passages.drop_passages(docs, found).collect()}
    assert kept == {1: rows[0][1], 2: fill[2] + fill[3] + fill[4], 3: fill[5] + own + fill[6] + fill[7]}


def test_passages_whose_seeds_occur_singly_before(spark):
    """Short pieces of a passage in earlier documents cover all its seeds; exact repeats are held against brute force."""
    rng = random.Random(11)
    for seed in range(3):
        passage, fill = prose(4000 + seed, 64).split(), lambda i, n=40: prose(5000 + 100 * seed + i, n).split()
        rows = [(i, fill(i) + passage[12 * i : 12 * i + 16] + fill(10 + i)) for i in range(5)]
        rows += [(20, fill(20) + passage + fill(21)), (30, fill(22) + passage + fill(23))]
        rows += [(40 + i, fill(30 + i) + passage[(at := rng.randint(0, 64 - 50)) : at + 50] + fill(40 + i)) for i in range(6)]
        got = defaultdict(set)
        for r in passages.repeated_passages(table(spark, [(i, " ".join(words)) for i, words in rows])).collect():
            got[r.doc_id] |= set(range(r.passage_start, r.passage_end))
        before = set()
        for i, words in rows:
            runs = [tuple(words[j : j + 50]) for j in range(len(words) - 49)]
            assert got[i] >= {j + n for j, run in enumerate(runs) if run in before for n in range(50)}, (seed, i)
            before |= set(runs)


def test_copies_need_no_look_at_every_word(spark):
    """In copies the seeds tell the first occurrences of runs: only runs at the ends of a copy, and where the texts part, get a row each."""
    text, other = prose(6001, 1000).split(), prose(6002, 1000).split()
    rows = [(1, text), (2, text), (3, other[:300] + text[200:700] + other[300:]), (4, text[:400] + ["new"] + text[400:])]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in rows], "doc long, text string")
    matched = passages.matches(docs).collect()
    looked = Counter(r.doc for r in matched if r.n == passages.MIN_PIECE)
    assert looked[2] < 30 and looked[3] < 30 and looked[4] < 60
    words = dict(rows)
    assert all(words[r.doc][r.at : r.at + r.n] == words[r.other][r.other_at : r.other_at + r.n] for r in matched)
    found = passages.repeated_passages(docs.withColumnRenamed("doc", "doc_id")).collect()
    assert {(r.doc_id, r.passage_start, r.passage_end) for r in found} == {(2, 0, 1000), (3, 300, 800), (4, 0, 1001)}


def test_passages_with_scattered_changes(spark):
    """Passages of 60 words that alone are shared by two documents, with every n-th word changed or a share of all: which of the pairs are found."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(20_000)}"
    kinds = {"6": 6, "7": 7, "8": 8, "10": 10, "a tenth": 0.1, "a twentieth": 0.05}
    rows, pairs = [], []
    for kind, share in kinds.items():
        for _ in range(25):
            mine, theirs = [word() for _ in range(60)], []
            while sum(a == b for a, b in zip(mine, theirs)) < 48:
                theirs = ["z" + word() if (i % share == share - 1 if share > 1 else rng.random() < share) else w for i, w in enumerate(mine)]
            at = len(rows)
            pairs.append((kind, at))
            rows += [(at + j, " ".join([word() for _ in range(45)] + part + [word() for _ in range(45)])) for j, part in enumerate((mine, theirs))]
    found = {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(table(spark, rows)).collect()}
    assert found <= {(at + 1, at) for _, at in pairs}
    got = Counter(kind for kind, at in pairs if (at + 1, at) in found)
    assert all(got[kind] >= 0.84 * 25 for kind in kinds) and sum(got.values()) >= 0.9 * len(pairs), got


def test_words_by_their_hashes():
    data = [b"", b"  The quick\tBROWN  fox ", b"the", b"\n", "Stra\u00dfe THE\x0bfox \u00c4".encode(), b""]
    found = [code.tolist() for code in passages.word_codes(data)]
    names: dict = {}
    for text, code in zip(data, found):
        assert len(code) == len(text.split())
        assert all(names.setdefault(w, c) == c for w, c in zip(text.lower().split(), code))
    assert len(set(names.values())) == len(names) == 6
    assert passages.word_codes([]) == []


def test_parts_reach_the_similarity():
    rng = random.Random(4)
    for _ in range(100):
        a, b, blocks = [], [], []
        for _ in range(rng.randint(1, 5)):
            run, gap = rng.randint(10, 40), rng.randint(5, 30)
            a += [f"a{len(a) + i}" for i in range(gap)]
            b += [f"b{len(b) + i}" for i in range(gap)]
            blocks.append((len(a), run))
            shared = [f"s{len(a) + i}" for i in range(run)]
            a, b = a + shared, b + shared
        got = passages.parts(a, b, 0.8, 20)
        assert all(n == passages.common_words(a[x0:x1], b[y0:y1]) and n >= 0.8 * max(x1 - x0, y1 - y0) for x0, x1, y0, y1, n in got)
        assert all(any(x0 <= at and at + run <= x1 for x0, x1, *_ in got) for at, run in blocks if run >= 20)


def test_chains_follow_gap_costs():
    near = passages.chain([0, 20, 200], [5, 27, 90], [10, 40, 210], [15, 47, 100], 0.2, 30)
    assert near[0] == [0, 1] and [2] in near
    crossing = passages.chain([0, 10], [50, 0], [8, 18], [58, 8], 0.2, 30)
    assert sorted(map(tuple, crossing)) == [(0,), (1,)]


def test_common_words_is_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [[rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert passages.common_words(a, b) == best[-1][-1]


# ---- top k

def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(knn, "PER_GROUP", 5)
    monkeypatch.setattr(knn, "BLOCK", 3)
    monkeypatch.setattr(knn, "CHUNK", 60)
    monkeypatch.setattr(knn, "SAMPLE", 20)
    rng = np.random.default_rng(1)
    rows = [(i, [round(float(x), 1) for x in rng.normal(size=4)]) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(400, 440)] + [(450, None), (500, [1.0, None, 0.0, 0.0]), (550, [1.0, float("nan"), 0.0, 0.0]), (551, [1.0, float("inf"), 0.0, 0.0]), (600, [2.0, 1.0]), (600, [2.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (601, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v int, pivot int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_k(df).collect()}
    use = {i: [int(np.floor(x * 256)) for x in v] + [0] * (4 - len(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in use:
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(use[q], v)), i) for i, v in use.items() if i != q)[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(ranked)}
    assert got == want
    assert knn.top_k(df.limit(0)).count() == 0 and knn.top_k(df.where("vec_id = 50")).count() == 0


def plain_top_k(use, every=50, top=5):
    """(query, rank) -> (id, score) over all pairs; scores held at the ends of a long."""
    held = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = {}
    for q in (i for i in use if i % every == 0):
        ranked = sorted((-held(sum(a * b for a, b in zip(use[q], v))), i) for i, v in use.items() if i != q)[:top]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(ranked)}
    return want


def test_top_k_copies_only_rows_in_reach(spark, monkeypatch):
    monkeypatch.setattr(knn, "PER_GROUP", 10)
    monkeypatch.setattr(knn, "SAMPLE", 300)
    rng = np.random.default_rng(2)
    middles = np.linalg.qr(rng.normal(size=(16, 12)))[0].T * 4
    vectors = middles[rng.integers(12, size=4000)] + 0.05 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    met = knn.meeting(df)
    assert met.n_groups == 8 and met.rows.select("group", "vec_id").distinct().count() < 0.5 * met.n_rows * met.n_groups
    assert met.asked.select("cell", "vec_id").distinct().count() < 0.5 * 80 * met.n_cells
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_k(df).collect()}
    assert got == plain_top_k({i: np.floor(256 * v).astype(int).tolist() for i, v in enumerate(vectors)})


def test_top_k_of_huge_components_and_other_ids(spark):
    rows = [(str(i), [float((-1) ** i) * 10.0 ** (i % 21), 3.0, 1e300 if i == 7 else 0.5]) for i in range(101)] + [("a", [1.0, 1.0, 1.0])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_k(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    held = lambda x: int(min(max(np.floor(x * 256), -(2.0**63)), 2.0**63)) if abs(x * 256) < 2.0**63 else (2**63 - 1 if x > 0 else -(2**63))
    assert got == plain_top_k({int(i): [held(x) for x in v] for i, v in rows if i != "a"})


# ---- SimHash

def test_golay_keys_meet_within_two_bits():
    golay, rng = simhash.Golay(), np.random.default_rng(4)
    words = rng.integers(0, 1 << 23, 3000)
    keys = [set(r[r < 4096]) for r in golay.keys(words)]
    assert {len(k) for k in keys} == {1, 6}
    for flips in (1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, words.size)
        assert all(a & set(b[b < 4096]) for a, b in zip(keys, golay.keys(other)))


@pytest.mark.parametrize("size", [4096, 30])
def test_links_equal_all_pairs(spark, size):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(12)} | {base[0] ^ 1 << k for k in range(60)}
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r.node: r.component for r in components(simhash.links(frame, size=size)).collect()}
    nodes = {f: int(np.uint64(f).astype(np.int64)) for f in fps}
    group = {f: f for f in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                group[root(a)] = root(b)
    members = defaultdict(set)
    for f in fps:
        members[root(f)].add(nodes[f])
    for part in members.values():
        if len(part) > 1:
            assert {got[n] for n in part} == {min(part)}
        else:
            assert got.get(*part) is None


def test_simhash_groups(spark):
    rows = [*ODD, (20, prose(8, 400)), (21, prose(8, 400) + " more"), (22, prose(8, 400)), (23, prose(9, 400))]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(table(spark, rows)).collect()]
    want = {}
    for i, text in rows:
        words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want[i] = f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"
    assert len(got) == len(rows) and all(f == want[i] for i, f, _ in got)
    part = {i: c for i, _, c in got}
    assert part[1] == part[2] == part[3] == 1 and part[20] == part[21] == part[22] == 20 and part[23] == 23 and part[None] is None
    kept = Counter(r.doc_id for r in simhash.keep_one(table(spark, rows)).collect())
    assert kept == Counter([1, 4, 5, 6, 7, 20, 23, None])
    assert simhash.simhash_groups(table(spark, rows).limit(0)).count() == 0


# ---- licences

def test_licences_of_like_wording(spark):
    gnu = licenses.TEMPLATES["GPL-3.0"]
    says = {"Released under the BSD License.": "BSD notice", "Licensed under CC BY 4.0.": "CC-BY-4.0 notice", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0 notice", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 notice",
            "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0 notice", "Released under the MIT License.": "MIT notice", "Released under the XYZ License.": None, "Licensed under CC BY-NC 2.0.": None, gnu: "GPL-3.0",
            gnu.replace("version 3", "version 2"): "GPL-2.0", gnu.replace("GNU General", "GNU Lesser General"): "LGPL-3.0", gnu.replace("GNU General", "GNU Affero General"): "AGPL-3.0", "Licensed under the Eclipse Public License, Version 2.0.": "EPL-2.0 notice"}
    got = defaultdict(list)
    for r in licenses.license_scan(table(spark, list(enumerate(says)))).collect():
        got[r.doc_id].append(r.license)
    assert {text: got[i] for i, text in enumerate(says)} == {text: [name] if name else [] for text, name in says.items()}


def test_licences(spark):
    mit = licenses.TEMPLATES["MIT"].replace("furnished", "given").replace("sublicense, ", "")
    rows = [*ODD, (10, f"{prose(1, 300)} {mit} {prose(2, 300)}"), (11, "All rights reserved. Released under the MIT License. All rights reserved."), (12, "the licensed person reserved all"), (13, licenses.TEMPLATES["Apache-2.0"])]
    got = defaultdict(list)
    for r in licenses.license_scan(table(spark, rows)).orderBy("doc_id", "start_word").collect():
        got[r.doc_id].append((r.license, r.start_word, r.end_word))
    assert got == {10: [("MIT", 300, 416)], 11: [("All rights reserved", 0, 3), ("MIT notice", 3, 8), ("All rights reserved", 8, 11)], 13: [("Apache-2.0", 0, 72)]}


def test_patience_is_increasing_and_covers_equal_texts():
    rng = random.Random(9)
    for _ in range(100):
        t, x = [[rng.randint(0, 9) for _ in range(rng.randint(0, 25))] for _ in range(2)]
        pairs = licenses.patience(t, x)
        assert all(t[i] == x[j] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        assert len(licenses.patience(t, t)) == len(t)


# ---- SentencePiece

def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    made = [(100 + k, "".join(rng.choice("aabcdeeinst .,'’é😀\n\t中0123AB") if rng.random() < 0.9 else rng.choice(["the", "tion", "   ", "ing"]) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows = [r for r in ODD if len(r[1] or "") < 50000] + made
    coded = pieces.encode(table(spark, rows), PIECES)
    got = [(r.doc_id, r.text, r.ids, r.decoded) for r in pieces.decode(coded, PIECES).collect()]
    assert len(got) == len(rows) and all(ids == library.encode(text or "") and back == (text or "") for _, text, ids, back in got)
    digest = pieces.piece_digest(spark.read.parquet(f"{sf}/documents.parquet"), PIECES).collect()
    assert len(digest) == 200 and all(r.round_trip for r in digest)


def test_unigram_search_equals_brute_force():
    model = pieces.load(PIECES)
    merges, model.merges = model.merges, False
    try:
        for word in ["▁stones", "▁xyzzy", "tion", "▁the", "é😀a"]:
            best = [(0.0, 0)] + [None] * len(word)
            for end in range(1, len(word) + 1):
                able = []
                for k in range(1, min(end, 16) + 1):
                    hit = model.find(pieces._hash(np.array([[ord(c) for c in word[end - k : end]]], np.uint64))[:, -1])[0]
                    if hit >= 0:
                        able.append((best[end - k][0] + model.score_of[hit], k))
                    elif k == 1:
                        able.append((best[end - 1][0] + model.unknown_score, 1))
                best[end] = max(able)
            ids = pieces.viterbi(model, [word])[0]
            whole = [i for i in ids if model.size_of[i]]
            assert sum(model.score_of[i] for i in whole) + model.unknown_score * (len(word) - sum(model.size_of[i] for i in whole)) == best[-1][0]
    finally:
        model.merges = merges


# ---- lines

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_banded_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(800):
        b = [rng.choice("abé😀") for _ in range(rng.randint(5, 14))]
        a = list(b)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(a) + 1)
            a[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
        if len(a) - len(b) <= 2 and len(b) >= 2:
            rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.split("a", "").alias("x"), F.split("b", "").alias("y")).select("a", "b", line_dedup.banded_distance("x", "y", 2).alias("d"))
    for r in got.collect():
        true = edit_distance(r.a, r.b)
        assert r.d == true if true <= 2 else r.d > 2


def test_line_matches(spark):
    rng = random.Random(12)
    base = [prose(300 + k, 8) for k in range(12)]
    rows = []
    for i in range(25):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line))
        rows.append((i, "\n".join([*lines, "", "short", "  "])))
    docs = table(spark, rows + [(90, None), (91, ""), (92, "\n\n"), (93, "short\nshort"), (2, rows[2][1])])
    places = sorted(((i, k), x) for i, t in [*rows, (93, "short\nshort")] for k, x in enumerate(t.split("\n")) if x.strip())
    want = {}
    for place, line in places:
        near = [p for p, x in places if x == line or (min(len(x), len(line)) >= 20 and abs(len(x) - len(line)) <= 2 and edit_distance(x, line) <= 2)]
        want[place] = (*min(near), min(near) < place)
    matches = line_dedup.line_matches(docs)
    got = [((r.doc_id, r.line_no), (r.first_doc_id, r.first_line_no, r.removed)) for r in matches.collect()]
    assert dict(got) == want and len(got) == len(want) + sum(1 for p in want if p[0] == 2)
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs, matches).collect()}
    for i, text in rows:
        assert kept[i] == "\n".join(x for k, x in enumerate(text.split("\n")) if not want.get((i, k), (0, 0, False))[2])
    assert kept[90] is None and kept[91] == "" and kept[92] == "\n\n" and line_dedup.line_matches(docs.limit(0)).count() == 0


# ---- quality rules

def brute_counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_and_learned_rules(spark):
    rng = random.Random(8)
    rows = [*ODD, (8, "a b c d e f g h " * 3 + "x"), (9, "a\na\n\n \n b\nb\na"), (10, ("w " * 40).strip()), (11, prose(4, 30) + " # | <>")]
    rows += [(100 + k, prose(k, rng.randint(25, 60)) + (" $$$ ### ***" * 20 if k % 4 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(100 + k, 0 if k % 4 == 0 else 1, 1) for k in range(0, 400, 3)] + [(8, None, 0), (None, 0, 1), (100, 0, 0)], "doc_id long, quality int, text int")
    got = quality_rules.quality_rules(table(spark, rows), labels).collect()
    assert len(got) == len(rows)
    want = {i: brute_counts(t) for i, t in rows}
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == want[r.doc_id]
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        if (r.doc_id or 0) >= 100:
            assert r.kept == (not r.base_failed and r.doc_id % 4 != 0)
    kept = {r.doc_id for r in quality_rules.keep_good(table(spark, rows), labels).collect()}
    assert kept == {r.doc_id for r in got if r.kept}
    empty = quality_rules.quality_rules(table(spark, rows), labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in empty) and quality_rules.quality_rules(table(spark, rows).limit(0), labels).count() == 0


# ---- quality scores

def test_quality_scores(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    p = pairwise_ranking.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(p) > 500 and (p.predicted == p.quality).mean() > 0.97 and p.score.between(0, 1).all() and ((p.score >= 0.7) == (p.predicted == 1)).all()
    good, bad = p[p.quality == 1].score.to_numpy(), p[p.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    held = docs.select("doc_id", pairwise_ranking.held_out().alias("h")).limit(50).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_quality_scores_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = pairwise_ranking.quality_scores(table(spark, ODD), none).collect()
    assert len(rows) == len(ODD) and all(abs(r.score - 0.7) < 1e-9 and r.predicted == 1 for r in rows)
    assert pairwise_ranking.quality_scores(table(spark, ODD).limit(0), none).count() == 0


def test_quality_learns_from_every_label(spark, sf, monkeypatch):
    """Each labelled document enters a pair, the larger class sets their number, and the threshold is the quantile of all strengths."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, pairwise_ranking.N_FEATURES)).astype(np.float32)
    quality = [int(i % 3 > 0) for i in range(90)]
    marked = spark.createDataFrame([(q, i * 7919 % 90, row.tolist()) for i, (q, row) in enumerate(zip(quality, x))], "quality int, h long, x array<float>")
    monkeypatch.setattr(pairwise_ranking, "PAIRS", 1)
    placed = pairwise_ranking.group_positions(marked, ["quality"], ["h"], "place")
    gaps = np.array([r.x for r in pairwise_ranking.preferences(placed, 60, 30).collect()])
    assert len(gaps) == 60
    good, bad = x[np.array(quality) == 1], x[np.array(quality) == 0]
    assert np.allclose(gaps.sum(axis=0), good.sum(axis=0) - 2 * bad.sum(axis=0), atol=1e-3)
    found = pairwise_ranking.fit(marked)
    strengths = np.sort(found.strength(x.astype(float)))
    assert np.allclose(found.centre, x.mean(axis=0), atol=1e-6) and abs(found.threshold - strengths[28:31].mean()) < 1e-9


# ---- components and pipeline

def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (200, 150), (150, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 150: 150, 200: 150}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    state, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        state = corpus_pipeline.cut(stage(spark, state, sf))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == docs.columns
            seen.append({r.doc_id: r.text for r in state.collect()})
    rules, lines, single, cut_texts = seen
    assert set(rules) == {r.doc_id for r in quality_rules.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert set(lines) == set(rules) and set(cut_texts) == set(single) <= set(lines) and all(rules[i] == before[i] for i in rules)
    shown = set()
    for i in sorted(rules):
        left = lines[i].split("\n") if lines[i] else []
        fresh = [x for x in dict.fromkeys(rules[i].split("\n")) if x not in shown]
        assert [x for x in left if x.strip()] == [x for x in fresh if x.strip() and x in left]
        shown |= set(rules[i].split("\n"))
    assert packed(state.collect()) >= 1
    assert {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, sf).collect()} == {(r.doc_id, r.piece) for r in state.collect()}


def test_quality_labels_meet_packed_features_at_every_size(spark, monkeypatch):
    docs, labels = table(spark, [(i, f"word{i} so so\nline {i % 3}\nline {i % 3}" if i % 5 else "") for i in range(40)]), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    made = []
    monkeypatch.setattr(pairwise_ranking, "cut", lambda df: made.append(df) or df)
    monkeypatch.setattr(pairwise_ranking, "fit", lambda marked: marked)
    rows = pairwise_ranking.learn(docs, labels).collect()
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # the labels are met alike at every size
    moved = [line for line in plan.splitlines() if " Exchange " in line or "SortMergeJoin" in line]
    assert moved and not any("text#" in line for line in moved)
    learned = docs.where(~pairwise_ranking.held_out()).selectExpr("text", "doc_id % 2 AS q", "xxhash64(doc_id) AS h").collect()
    want = sorted((r.h, r.q, pairwise_ranking.features([r.text.encode()]).astype(np.float32)[0].tolist()) for r in learned)
    assert sorted((r.h, r.quality, r.x) for r in rows) == want


def test_blank_lines_are_told_without_reading_whole_lines(spark):
    rows = [(1, "a\n \t\x0b\x0c\r\n\n x \r\n \n\x1c\n  　"), (2, None), (3, ""), (None, "\t\nz")]
    found = line_dedup.lines_of(table(spark, rows))
    want = {(i, n, line) for i, t in rows if t is not None for n, line in enumerate(t.split("\n")) if WORDS.search(line)}
    assert {(r.doc_id, r.line_no, r.line) for r in found.collect()} == want and found.count() == len(want)
    assert "translate" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
