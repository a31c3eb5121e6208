"""Ranked search, hard negatives and HyperMinHash near-duplicates against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelens.llm import hyperminhash, jaccard, negatives, ranked
from citelens.llm.jaccard import Shingler

from .test_table_operators import brute_components

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(SMALL))
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_all, l_all = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 75 + (25 * sum(c.values()) * n_all) // max(1, l_all)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(rnd):
    words = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(4000)] + ["Élan", "ÀB", "x"] * 30
    docs = [(i, " ".join(rnd.choice(words) + rnd.choice(["", ",", "!", "_"]) for _ in range(rnd.choice([0, 3, 40, 200])))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " ,. "), (None, "w1 w2 w3 Élan"), (7, "w1 w1 w2"), (7, "w1 w1 w2"), (503, "hot " * 3000), (504, "éÉ w5-w6;W7")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 30])))) for i in range(12)]
    return docs, [*items, (20, None), (21, " ? "), (22, "hot W7 w7 unknownterm"), (22, "w1 w1 w1"), (None, "w2"), (23, "absent")]


@pytest.mark.parametrize(("docs_a_block", "queries"), [(64, 256), (3, 4)])
def test_search_equals_brute_force(spark, rows, monkeypatch, docs_a_block, queries):
    monkeypatch.setattr(ranked, "QUERIES", queries)
    docs, items = corpus(random.Random(3))
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, block int").repartition(3)
    asked = spark.createDataFrame([(*q, "x") for q in items], "item_id long, text string, rank string")
    index, found = ranked.build(df, block_docs=docs_a_block)
    got = ranked.search(index, found, asked, k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == brute_search(docs, items, 5)


def test_search_of_empty_tables_and_very_long_texts(spark, rows):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], schema)
    asked = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert ranked.search(*ranked.build(none), asked).count() == 0
    long = [(1, " ".join(f"w{i}" for i in range(70_000))), (2, "w1 w2"), (3, "w2")]
    docs = spark.createDataFrame(long, schema)
    assert rows(ranked.search(*ranked.build(docs, block_postings=1000), asked, k=20)) == brute_search(long, [(1, "w1 w2")], 20)
    assert ranked.search(*ranked.build(docs), asked.limit(0)).count() == 0


def test_bounds_hold_and_blocks_are_skipped():
    """A block's bound is at least the score of each of its documents, and no more than the best terms allow."""
    rnd = random.Random(5)
    held = ranked.Corpus(100, 5000)
    piece = ranked._Piece([(0, np.array([3, 5, 9], np.uint64), np.array([1, 2, 1])), (1, np.array([4], np.uint64), np.array([1]))])
    piece.weigh(held, np.array([10, 3, 50, 0]))
    docs = []
    for _ in range(20):
        h = np.array(sorted(rnd.sample(range(1, 12), 5)), np.uint64)
        docs.append((0, 50, h.tobytes(), np.array([rnd.randint(1, 9) for _ in h], np.int32).tobytes()))
    best = collections.defaultdict(int)
    for _, n, h, c in docs:
        for t, x in zip(np.frombuffer(h, np.uint64), held.impacts(np.frombuffer(c, np.int32).astype(np.int64), n), strict=True):
            best[int(t)] = max(best[int(t)], int(x))
    top = np.array(sorted(best), np.uint64)
    bounds = piece.bounds(top.tobytes(), np.array([best[int(t)] for t in top], np.int32).tobytes())
    scores = piece.scores(np.array([0, 1]), docs, held)
    assert (bounds >= scores.max(1)).all() and bounds[0] == sum(w * best[t] for t, w in zip((3, 5, 9), piece.weight[:3], strict=True))
    piece.exact = False
    assert (piece.scores(np.array([0, 1]), docs, held) == scores).all()


def brute_negatives(rows, k=5):
    """rows: (id, label, vector or None)."""
    sound = [(i, l, v) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(256 * x) for x in v] for _, _, v in sound]
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, l, _) in enumerate(sound):
        if i is None or i % 10:
            continue
        scores = [(sum(x * y for x, y in zip(ints[a], ints[b], strict=False)), sound[b][0], b) for b in range(len(sound)) if b != a]
        near = sorted((s for s in scores if sound[s[2]][1] == l), key=key)[:k]
        for ps, pid, _ in near:
            far = sorted((s for s in scores if sound[s[2]][1] != l and 80 * ps <= 100 * s[0] <= 100 * ps), key=key)[:k]
            out += [(i, pid, n + 1, nid, ps, ns) for n, (ns, nid, _) in enumerate(far)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "part", "pivots"), [(1024, 262_144, 128), (4, 40, 12), (2, 7, 3)])
def test_negatives_equal_brute_force(spark, rows, monkeypatch, block, part, pivots):
    """Clusters, so that bounds prune, a hot vector, ties, repeated rows and ids, rows that take no part."""
    monkeypatch.setattr(negatives, "LEAST_PART", 5)
    monkeypatch.setattr(negatives, "STEP", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6)) * 2
    table = [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in centres[i % 8] + rng.normal(size=6) * (0.2 if i % 3 else 1.5)]) for i in range(260)]
    hot = [float(np.float32(x)) for x in centres[0]]
    table += [(i, i % 4, hot) for i in range(300, 380)]
    table += [(10, 0, table[10][2]), (20, table[20][1], table[20][2]), (20, table[20][1], table[20][2]), (None, 1, hot), (None, 2, table[3][2]), (400, 1, [1.0, 2.0]), (401, 1, []), (410, 2, [1.0] * 6)]
    table += [(420, None, hot), (430, 1, None), (440, 1, [1.0, None]), (450, 1, [float("nan")] * 6), (460, 1, [float("inf")] + [0.0] * 5), (470, 9, hot), (480, 1, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 5) for r in table], "vec_id long, label int, embedding array<float>, rank int").repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block=block, part=part, pivots=pivots)
    assert rows(got) == brute_negatives(table)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_empty_tables_and_huge_components(spark, rows):
    schema = "vec_id long, label int, embedding array<double>"
    for some in ([], [(1, 1, [1.0])], [(10, 1, None)], [(10, 1, [1.0])]):
        assert negatives.hard_negatives(spark.createDataFrame(some, schema), F.col("vec_id") % 10 == 0).count() == 0
    big = [(0, 1, [9e4, 1.0]), (1, 1, [8e4, -3.0]), (2, 2, [7.9e4, 5.0]), (3, 2, [7e4, 1e4]), (4, 2, [1e300, -1e300])]
    got = rows(negatives.hard_negatives(spark.createDataFrame(big, schema), F.col("vec_id") % 10 == 0))
    assert got == brute_negatives(big[:4])


def test_bounds_send_candidates_to_few_groups(spark, monkeypatch):
    """On separated clusters most candidates meet only their own group of anchors."""
    rng = np.random.default_rng(2)
    centres = np.eye(8) * 20
    table = [(i, i // 8 % 2, (centres[i % 8] + rng.normal(size=8) * 0.1).tolist()) for i in range(400)]
    df = spark.createDataFrame(table, "vec_id long, label int, embedding array<double>")
    sent = []
    own = negatives._Join._dealt

    def counted(self, anchors, targets):
        out = own(self, anchors, targets)
        sent.append(out.where("kind = 1").count())
        return out

    monkeypatch.setattr(negatives._Join, "_dealt", counted)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block=4, pivots=16)
    assert got.count() > 0 and sent[0] <= 400 * 3 and sum(sent[1::2]) < 400  # of 400 rows and 12 blocks of anchors


def test_registers_estimate_similarity_and_collisions():
    registers = hyperminhash.Registers(96)
    rng = np.random.default_rng(4)
    for shared, own in ((850, 75), (500, 250), (0, 400), (9, 1)):
        h = rng.integers(0, 1 << 63, shared + 2 * own, np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = registers(h[: shared + own]), registers(np.r_[h[:shared], h[shared + own :]])
        true = shared / (shared + 2 * own)
        assert abs((a == b).mean() - true) < 5 * math.sqrt(true * (1 - true) / 96) + 0.02
    coarse = hyperminhash.Registers(64, mantissa=2)
    hits = np.mean([(coarse(rng.integers(0, 1 << 63, 300, np.uint64) * 2) == coarse(rng.integers(0, 1 << 63, 300, np.uint64) * 2)).mean() for _ in range(60)])
    assert abs(hits - hyperminhash.collisions(300, 300, 2)) < 0.02 < hits
    assert (registers(np.array([5], np.uint64)) == registers(np.array([5], np.uint64))).all()


def brute_85(rows):
    return brute_components(rows, 85)


@pytest.mark.parametrize("tile", [2_048, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile):
    for module in (jaccard, hyperminhash):
        monkeypatch.setattr(module, "TILE", tile)
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    texts = [None, "", " \n", "one two", "ONE two", "one two three four five six", "one two three four five six seven"]
    for k in (40, 12, 5, 3, 2, 2):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 120, 300]))]
        for _ in range(k):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts.append(" ".join(t))
    texts += [" ".join(passage + [rnd.choice(words) for _ in range(rnd.randint(5, 40))]) for _ in range(30)]
    data = list(zip(rnd.sample(range(2_000), len(texts)), texts, strict=True))
    least, own = {}, brute_85(data)
    for i, _ in data:
        least[own[i][1]] = min(i, least.get(own[i][1], i))
    df = spark.createDataFrame([(i, t, True) for i, t in [*data, *data[:4]]], "doc_id long, text string, kept boolean").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(df).collect())
    assert got == sorted((i, own[i][0], least[own[i][1]], i == least[own[i][1]]) for i, _ in [*data, *data[:4]])
    assert hyperminhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(80)]
    text, near = " ".join(words), " ".join([*words[:79], "x"])
    df = spark.createDataFrame([(9, text), (None, near), (4, near), (9, "other words altogether here now"), (None, "alone in the world as it is"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(9, 76, 4, False), (None, 76, 4, False), (4, 76, 4, True), (9, 1, 9, True), (None, 3, None, True), (None, 0, None, True)], key=str)
    assert len(Shingler(5)(text)) == 76
