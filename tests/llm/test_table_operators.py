"""URL filters, packing, fixity, media and the Jaccard join, against brute force; the pipeline on the smallest tables."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelens.llm import bpe, fixity, jaccard, jpeg, packing, urls

SF = "/root/testdata/sf0.001"


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "b.example.com", ""), ("allow", "b.example.com", "/x"), ("block", "b.example.com", "/x/y"), ("block", "net", "/é"), ("allow", "example.com", "/en/7"), ("block", "example.com", "/en/7/dup")]
    rnd = random.Random(3)
    some = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7", "http://xexample.com/en/7", "http://com/en/", "x://a.net/é/1?q", "http://b.example.com", "http://b.example.com?x=1", "http://b.example.com/x/y/z#a", "http://example.com/en/7/dup"]
    some += [f"http://{rnd.choice(['', 'a.', 'b.', 'c.b.'])}{rnd.choice(['example.com', 'com', 'other.com', 'a.net'])}/{rnd.choice(['en/', 'en/7', 'x', 'x/y', 'é', ''])}{rnd.choice(['', '/dup', '?a'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "z", "z") for i, u in enumerate(some)] + [(4, some[4], "z", "z")], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame([*rules, (None, "com", ""), ("block", "", "")], "verdict string, host string, path string")
    got = urls.filter_urls(df, table, ["page_id"], salts=5).collect()
    assert len(got) == len(some) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(some[r.page_id], rules), some[r.page_id]
    assert urls.filter_urls(df.limit(0), table, ["page_id"]).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, table.limit(0), ["page_id"]).collect()} == {"allow"}


def test_best_fit_invariants():
    rnd = random.Random(4)
    sizes = [0, 1, 4096, 4097, 20000] + [rnd.randint(0, 3000) for _ in range(500)]
    placed, bins = packing.best_fit(sizes)
    used = {}
    for _, _, n, b, offset in sorted(placed, key=lambda p: (p[3], p[4], p[2])):
        assert offset == used.get(b, 0)
        used[b] = offset + n
    assert all(used[b] <= c and (c == 512 or used[b] > c // 2) for b, c in enumerate(bins))
    for i, n in enumerate(sizes):
        own = sorted((s, k) for item, s, k, _, _ in placed if item == i)
        assert sum(k for _, k in own) == n and [s for s, _ in own] == [j * 4096 for j in range(len(own))]
    assert sum(sizes) / sum(bins) > 0.9


def test_pack_equals_plain_packing(spark):
    rows = [(i, i * 37 % 900, 1) for i in range(60)] + [(None, None, 1), (3, 1, 1), (3, 1, 1), (61, 9000, 1), (62, -5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, bin_id int")
    got = packing.pack(df).collect()
    items = sorted(((max(0, n or 0), i) for i, n, _ in rows), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    assert sum(r.n_tokens for r in got) == sum(n for n, _ in items)
    _, bins = packing.best_fit([n for n, _ in items])
    assert sorted(bins) == sorted({r.bin_id: r.bin_length for r in got}.values())
    again = packing.pack(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.pack(df.limit(0)).count() == 0
    spans = sorted((r.piece, r.start, r.n_tokens) for r in got if r.doc_id == 61)
    assert spans == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 808)]


def test_pack_deals_equal_rows_to_many_groups(spark):
    rows = [(None, 100)] * 500 + [(7, 300)] * 130 + [(i, 50) for i in range(100)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(5), group=40).collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == sum(n for _, n in rows)
    assert len({r.bin_id >> 32 for r in got if r.doc_id is None}) > 4
    held = {}
    for r in got:
        held.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.n_tokens))
    for (_, length), spans in held.items():
        ends = [a + n for a, n in sorted(spans)]
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= length


def test_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = [(1, "A text, as such."), (None, None), (2, ""), (3, "word " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    encode = bpe.coder(ranks, public_tokenizers.PATTERN).encode_ordinary
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df, ranks, public_tokenizers.PATTERN).collect()}
    assert got == {i: len(encode(t or "")) for i, t in rows}


def test_audit_locates_every_change(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "p" * (i * 911 % 9000), "x") for i in range(300)] + [(None, None, None, "x")], "page_id long, url string, html string, status string")
    a = fixity.archive_pages(pages, 100).cache()
    assert fixity.audit(a, a).count() == 0
    bad = F.when(F.col("page_id") == 17, F.expr("overlay(record PLACING X'00' FROM 30)")).when(F.col("page_id") == 250, F.lit(None).cast("binary")).otherwise(F.col("record"))
    b = a.withColumn("record", bad).where("page_id IS NULL OR page_id <> 101").unionByName(a.where("page_id = 5").withColumn("offset", F.lit(99_999_999).cast("long")))
    where = {r.page_id: (r.archive, r.offset) for r in a.collect()}
    got = {(r.archive, r.offset): r.status for r in fixity.audit(a, b).collect()}
    assert got == {where[17]: "corrupt", where[250]: "corrupt", where[101]: "missing", (0, 99_999_999): "extra"}
    assert fixity.audit(a, a.limit(0)).count() == 301 and fixity.audit(a.limit(0), a.limit(0)).count() == 0
    raw = bytes(a.where("page_id = 3").first().record)
    assert raw.startswith(b"WARC/1.1\r\n") and f"Content-Length: {3 * 911}".encode() in raw


@pytest.mark.parametrize("n", [1, 2, 3, 40, 8195])
def test_jpeg_round_trip(n):
    payload = os.urandom(jpeg.UNIT * n)
    media = jpeg.write_bytes(payload)
    d = jpeg.Decoder(media)
    assert d.payload() == payload and d.rgb().shape == (d.height, d.width, 3)
    if n <= 40:
        slow = jpeg.Decoder(media, whole=False)
        assert slow.payload() == payload and (slow.rgb() == d.rgb()).all()


def sparse_jpeg(coefficients, sampling, width, height):
    """A progressive JPEG by a plain bit-by-bit writer: zero runs, end-of-band runs, new and old coefficients in refinement."""
    codes = {s: f"{i:08b}" for i, s in enumerate(range(255))}  # 8-bit codes for the first 255 symbols
    table = bytes([*[0] * 7, 255, *[0] * 8]) + bytes(range(255))
    most = max(h for h, _ in sampling), max(v for _, v in sampling)
    mcus = -(-width // (8 * most[0])), -(-height // (8 * most[1]))

    def value(v):
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    def down(v, al):
        return v >> al if v >= 0 else -(-v >> al)

    def entropy(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    out = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + bytes(range(1, 65)))
    out += jpeg._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
    out += jpeg._segment(0xC4, b"\x00" + table) + jpeg._segment(0xC4, b"\x10" + table)
    order = [(c, y * v + j, x * h + i) for y in range(mcus[1]) for x in range(mcus[0]) for c, (h, v) in enumerate(sampling) for j in range(v) for i in range(h)]
    last, first, refine = {}, "", ""
    for c, y, x in order:
        dc = int(coefficients[c][y, x, 0])
        size, bits = value((dc >> 1) - last.get(c, 0))
        last[c] = dc >> 1
        first += codes[size] + bits
        refine += str(dc & 1)
    sos = lambda cs, lo, hi, a: jpeg._segment(0xDA, bytes([len(cs), *[x for c in cs for x in (c + 1, 0)], lo, hi, a]))
    every = list(range(len(sampling)))
    out += sos(every, 0, 0, 0x01) + entropy(first) + sos(every, 0, 0, 0x10) + entropy(refine)
    for c, (h, v) in enumerate(sampling):
        used = -(-height * v // (8 * most[1])), -(-width * h // (8 * most[0]))
        blocks = [coefficients[c][y, x] for y in range(used[0]) for x in range(used[1])]
        for al in (1, 0):
            bits, run = "", 0
            for b in blocks:
                b = [int(x) for x in b]
                if al:  # first scan, values halved
                    some = [(k, down(b[k], 1)) for k in range(1, 64) if down(b[k], 1)]
                    if not some:
                        run += 1
                        continue
                    if run:
                        r = run.bit_length() - 1
                        bits += codes[r << 4] + (f"{run - (1 << r):0{r}b}" if r else "")
                        run = 0
                    k0 = 1
                    for k, x in some:
                        while k - k0 > 15:
                            bits += codes[0xF0]
                            k0 += 16
                        size, extra = value(x)
                        bits += codes[(k - k0) << 4 | size] + extra
                        k0 = k + 1
                    if k0 <= 63:
                        run = 1
                else:  # refinement, one end-of-band per block
                    zeros, pending = 0, ""
                    new = [k for k in range(1, 64) if abs(b[k]) == 1]
                    for k in range(1, 64):
                        if abs(b[k]) > 1:
                            pending += str(abs(b[k]) & 1)
                        elif abs(b[k]) == 1:
                            bits += codes[zeros << 4 | 1] + ("1" if b[k] > 0 else "0") + pending
                            zeros, pending = 0, ""
                        else:
                            zeros += 1
                            if zeros == 16 and any(j > k for j in new):
                                bits += codes[0xF0] + pending
                                zeros, pending = 0, ""
                    if not new or new[-1] < 63:
                        bits += codes[0] + pending
            if run:
                r = run.bit_length() - 1
                bits += codes[r << 4] + (f"{run - (1 << r):0{r}b}" if r else "")
            out += sos([c], 1, 63, 0x01 if al else 0x10) + entropy(bits)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_jpeg_of_sparse_images(sampling):
    rnd = np.random.default_rng(5)
    width, height = 37, 21
    most = max(h for h, _ in sampling), max(v for _, v in sampling)
    mcus = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    coefficients = []
    for h, v in sampling:
        c = rnd.integers(-40, 40, (mcus[1] * v, mcus[0] * h, 64)) * (rnd.random((mcus[1] * v, mcus[0] * h, 64)) < 0.1)
        c[rnd.random(c.shape[:2]) < 0.3, 1:] = 0
        coefficients.append(c)
    d = jpeg.Decoder(sparse_jpeg(coefficients, sampling, width, height))
    for c, (h, v), own in zip(coefficients, sampling, d.coefficients, strict=True):
        used = -(-height * v // (8 * most[1])), -(-width * h // (8 * most[0]))
        assert (own[: used[0], : used[1]] == c[: used[0], : used[1]]).all()
    rgb = d.rgb()
    assert rgb.shape == (height, width, 3)
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    block = np.zeros(64)
    block[jpeg.zigzag()] = coefficients[0][0, 0] * np.arange(1, 65)
    y = np.clip(np.round(basis.T @ block.reshape(8, 8) @ basis + 128), 0, 255)
    if len(sampling) == 1:
        assert abs(rgb[:8, :8, 0].astype(int) - y).max() <= 1


def test_media_table(spark):
    rows = [(1, None, b"x"), (2, "", b"x"), (3, "é" * 700, b"x"), (3, "é" * 700, b"x"), (None, "t", b"x")]
    media = jpeg.store_texts(spark.createDataFrame(rows, "doc_id long, text string, media binary"))
    got = jpeg.load_media(media, ["doc_id", "n_bytes"]).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, len(r.payload), len(r.rgb)) for r in got) == [(0, 1, 192, 192), (1, 0, 192, 192), (2, 0, 192, 192), (3, 1400, 1536, 1536), (3, 1400, 1536, 1536)]
    broken = spark.createDataFrame([(b"junk",), (None,), (b"\xff\xd8",)], "media binary")
    assert [r.payload for r in jpeg.load_media(broken, []).collect()] == [None] * 3
    assert jpeg.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_media_query_stores_tensors(spark):
    from citelens.llm import queries

    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(3)
    want = {r.doc_id: hashlib.sha256(r.rgb).hexdigest() for r in jpeg.load_media(jpeg.store_texts(docs), ["doc_id"]).collect()}
    got = {r.doc_id: r.rgb_sha256 for r in queries.op6_media_columns(spark, SF).collect()}
    assert want and all(got[i] == h for i, h in want.items()) and None not in got.values()


def brute_components(rows, percent=80):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_equals_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    shared = [rnd.choice(words) for _ in range(60)]
    texts = [None, "", " \n", "one two", "ONE two", "one two three", "É un deux trois quatre", "é un deux trois quatre"]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.randint(1, 6)):
            t = list(base)
            for _ in range(rnd.randint(0, 5)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts.append(" ".join(t + (shared if rnd.random() < 0.3 else [])))
    family = [rnd.choice(words) for _ in range(200)]
    for k in range(40):
        t = list(family)
        t[k * 5] = "changed"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(rows)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_small_tiles_and_rounds_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    rnd = random.Random(7)
    family = [f"w{rnd.randrange(90)}" for _ in range(60)]
    rows = []
    for i in range(40):
        t = list(family)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(60)] = f"x{rnd.randrange(50)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == brute_components(rows)


def test_jaccard_counts_every_row_in_any_order(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:59], "x"]), " ".join(f"v{i}" for i in range(60))
    rows = [(7, text), (3, text), (9, near), (5, other), (None, near + " x1"), (2, near + " x1 x2"), (5, near), (None, other), (None, other + " y"), (None, other + " y"), (4, other + " y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for some in (df.coalesce(1), df.repartition(7)):
        got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(some).collect()}
        assert got == {(7, 2), (3, 2), (9, 2), (2, 2), (None, 2), (5, 4), (None, 4), (4, 4), (5, 2)}


@pytest.mark.parametrize(("tile", "shingles"), [(2_048, 1 << 20), (6, 300)])
def test_jaccard_with_hot_groups_and_large_families(spark, monkeypatch, tile, shingles):
    """A passage that most texts are made of, families beyond a tile, repeated and null ids, in two orders."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", shingles)
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = [passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(50)]
    for k in (30, 4, 2):
        base = [rnd.choice(words) for _ in range(50)]
        for _ in range(k):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(50)] = rnd.choice(words)
            texts.append(" ".join(t))
    texts += [None, "", "one", "one", "two words"]
    rows = list(zip(rnd.sample(range(2_000), len(texts)), texts, strict=True))
    own = brute_components(rows)
    twice = [*rows, *rows[:5]]
    for some in (sorted(twice, key=lambda r: -r[0]), rnd.sample(twice, len(twice))):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
        least = {}
        for i, _ in rows:
            least[own[i][1]] = min(i, least.get(own[i][1], i))
        assert got == sorted((i, own[i][0], least[own[i][1]]) for i, _ in twice)


def test_pruned_groups_keep_every_pair():
    """The rule that drops members, and its short form for pairs, against all pairs of sizes and places."""
    rnd = random.Random(12)
    for _ in range(300):
        k = rnd.randint(2, 8)
        f, n = np.arange(k), np.array([rnd.randint(5, 12) for _ in range(k)])
        late = np.array([rnd.random() < 0.5 for _ in range(k)])
        want = set()
        for a in range(k):
            for b in range(k):
                if a != b and n[a] <= n[b] and 100 * n[a] >= 80 * n[b] and not late[a]:
                    want |= {a, b}
        assert set(jaccard._paired(f, n, late, 80).tolist()) == want


def test_results_replace_columns_of_their_name(spark):
    df = spark.createDataFrame([("http://a.com/x", "h", 5)], "url string, host string, rule int")
    out = urls.filter_urls(df, urls.rule_table(spark, [("block", "com/")]), ["host", "rule"])
    assert out.columns == ["host", "path", "rule", "verdict"] and tuple(out.first()) == ("a.com", "/x", "com/", "block")
    media = jpeg.store_texts(spark.createDataFrame([(1, "t")], "doc_id long, text string")).withColumn("width", F.lit("own"))
    assert jpeg.load_media(media, ["doc_id", "width"]).first().width == 8
    again = fixity.archive_pages(spark.createDataFrame([(None, "u", "p")] * 40 + [(1, "u", "p")] * 30, "page_id long, url string, html string"))
    assert fixity.audit(again, again.repartition(3)).count() == 0 and fixity.audit(again, again.where("page_id IS NOT NULL")).count() > 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60)], "a long, b long")
    got = {r.f: r.c for r in jaccard.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 50: 40, 60: 40}


def test_pipeline_stages(spark):
    from citelens.llm import queries

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF).cache()
        assert out.columns == docs.columns and out.count() <= seen.count(), name
        seen = out
    layout = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    assert {r.doc_id for r in layout} == {r.doc_id for r in seen.collect()}
    tokens = packing.token_counts(seen, *queries.vocabulary())
    assert sum(r.n_tokens for r in layout) == sum(r.n_tokens for r in tokens.collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
