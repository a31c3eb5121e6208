"""N-gram Jaccard join by size-banded tiles with bitmap signatures, exact.

1. Each text's set of n-word shingles is hashed to sorted 64-bit integers. Equal sets are one node from here on.
2. A node's prefix is its share of shingles that any partner must hit once: n - ceil(t n) + 1 of them, rarest first. Frequent
   shingles (counted over all texts; the table is of fixed size and only orders) come last, so that passages many texts share
   seldom meet in a prefix. Nodes that share a prefix shingle form a group, less those that no other member can link with
   (by size, or because the pair meets in an earlier group). Groups of nearly the same nodes are united. Every group is a
   tile; one too large comes in parts, dealt over tasks.
3. In every tile, bitmaps of hashed shingles bound the overlap of pairs from above. A tile passes on a spanning forest of the
   pairs that may link, never all of them; what the forests connect is a cluster.
4. Each cluster is a tile that gets the sorted arrays of its nodes, once. Pairs that the bitmaps allow are intersected; nodes
   that link are one component from then on. Again only a spanning forest leaves the tile.
5. A cluster or group beyond a tile is settled in parts first, then between one node per component, and whatever still
   spans components by pairs of blocks within the size band: no pair stays untried, and most need no trial.

Components come from rounds of large-star and small-star steps. Nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise

HEAVY = 262_144  # entries of the table of frequent shingles: 4 MB
TILE = 2_048  # members of a block; a tile is one block or two
TILE_SHINGLES = 1 << 20  # shingles of a block of arrays: 8 MB
KEY_BITS = (1 << 40) - 1  # of a prefix shingle, to group by
BROADCAST_IDS = 500_000  # above, texts to verify are found by a shuffled join
PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, kept for the words of one task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:  # only a memo
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sorted distinct 64-bit hashes of a text's n-word shingles. ASCII letters are lower-cased, words split at ASCII white
    space. A text with fewer words is one shingle; without words the set is empty."""

    def __init__(self, n: int = 5) -> None:
        self.n, self.known = n, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * PRIME
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(h ^ (h >> np.uint64(32)))


def bitmap(h: np.ndarray) -> bytes:
    """A bit per hashed shingle, in the least power of two of bits that is at least 256 and four times the set's size."""
    bits = max(256, 1 << (4 * len(h) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(raw: bytes, size: int) -> np.ndarray:
    """A bitmap as words of 64 bits, folded to ``size`` bytes: the bitmap the set would have at that length."""
    a = np.frombuffer(raw, np.uint64).reshape(-1, size // 8)
    return np.bitwise_or.reduce(a, axis=0)


def least_overlap(a, b, percent: int):
    """The smallest intersection with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _heavy(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent shingles, at most HEAVY. Every text is counted, a repeated one once a task; a task
    passes on what it saw three times or more in some millions of shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size, met = Shingler(n), [], 0, set()

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c > 2].view(np.int64)), pa.array(c[c > 2])], names=["h", "c"])

        for b in batches:
            for t, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key in met:
                    continue
                met.add(key)
                held.append(shingles(t))
                size += len(held[-1])
                if size > 4_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    seen = docs.select("text", F.xxhash64("text")).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    top = seen.orderBy(F.desc("c"), "h").limit(HEAVY).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _sets(docs: DataFrame, n: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc, t, f, n, bits, prefix): t is a hash of the text, f identifies the set (null if empty); bits and prefix are empty on
    a set that its task met before."""
    hashes, counts = heavy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, met = Shingler(n), set(), {}
        for b in batches:
            out = []
            for key, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key in met:
                    out.append((*met[key], b"", []))
                    continue
                h = shingles(t)
                f = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None
                met[key] = f, len(h)
                if f is None or f in seen:
                    out.append((f, len(h), b"", []))
                    continue
                seen.add(f)
                p = len(h) - -(-percent * len(h) // 100) + 1
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    common = hashes[at] == h
                    if common.any():
                        late, c = h[common], counts[at[common]]
                        first = h[~common][:p]
                        h_p = np.concatenate([first, late[np.lexsort((late, c))][: p - len(first)]])
                    else:
                        h_p = h[:p]
                else:
                    h_p = h[:p]
                out.append((f, len(h), bitmap(h), h_p.view(np.int64)))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc", "t", "f", "n", "bits", "prefix"])

    return docs.select("doc", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc long, t long, f long, n long, bits binary, prefix array<long>")


def components(edges: DataFrame) -> DataFrame | None:
    """(f, c): the least id in each node's component, for the nodes of ``edges`` (a, b), by alternating stars; None without
    edges."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if not state[0]:
            return None
        if tuple(state) == before:
            break
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        now, old = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"), now
        discard(old)
    return now.select(F.col("u").alias("f"), F.col("v").alias("c")).unionByName(now.select(F.col("v").alias("f"), F.col("v").alias("c")).distinct())


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components after more links: only components that the links join are looked at again. None as long as there are none."""
    if labels is None:
        return components(links)
    of = lambda end: labels.select(F.col("f").alias(end), F.col("c").alias(f"c{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(ends.where("a <> b"))
    if joined is None:
        return labels
    moved = labels.join(joined.select(F.col("f").alias("c"), F.col("c").alias("d")), "c", "left").select("f", F.coalesce("d", "c").alias("c"))
    return materialise(moved.unionByName(joined.join(labels, "f", "left_anti")), "labels")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal first ``keys`` columns, of a stream sorted by them."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _paired(f: np.ndarray, n: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    """The members of a group that some other member may need here, sorted. In order of rarity, the first shingle that two linked
    sets share lies in the smaller one's first n - ceil(2 t n / (1 + t)) + 1; a set that has the group's shingle later, ``late``,
    is here for smaller or equal ones only, and either way for the size band."""
    order = np.lexsort((f, n))
    f, n, early = f[order], n[order], ~late[order]
    before = np.r_[0, np.cumsum(early)]
    least = np.searchsorted(n, -(-percent * n // 100))
    smaller = before[np.searchsorted(n, n, side="right")] - before[least] - early
    larger = np.searchsorted(n, 100 * n // percent, side="right") - np.searchsorted(n, n) - 1
    return np.sort(f[(smaller > 0) | (early & (larger > 0))])


def _merged_groups(groups: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Groups of one least member, largest first, united while they overlap so much that a tile gains little by it: a passage
    or family makes a group per shingle, of nearly the same sets."""
    now = None
    for g in sorted(groups, key=lambda g: (-len(g), g.tobytes())):
        both = g if now is None else np.union1d(now, g)
        if now is None or len(both) <= min(TILE, max(1.5 * len(now), 32)):
            now = both
        else:
            yield now
            now = g
    if now is not None:
        yield now


def _packed_groups(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"least": pa.int64(), "fs": pa.list_(pa.int64()), "big": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def united(groups: DataFrame) -> DataFrame:
    """(lid, fs, big): groups (least, fs, big), of which those of nearly the same sets are one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1):
            whole = _merged_groups([np.array(fs, np.int64) for _, fs, big in rows if big is None])
            yield _packed_groups([(rows[0][0], fs, None) for fs in whole] + [r for r in rows if r[2] is not None])

    tiles = groups.repartition("least").sortWithinPartitions("least").mapInArrow(merge, "least long, fs array<long>, big long")
    return tiles.select(F.xxhash64("fs", "big").alias("lid"), "fs", "big")


def _groups(sets: DataFrame, heavy: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """(lid, fs, big): groups of at most TILE sets that share a prefix shingle. A larger group comes in such parts, with its
    shingle in ``big``; a shingle known to be frequent is dealt to tasks by part from the start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, np.ndarray] = {}
        parts: list[tuple] = []

        def close(g: int, s: int, f: np.ndarray, w: np.ndarray) -> None:
            first = np.r_[True, f[1:] != f[:-1]]
            fs = f[first] if s >= 0 else _paired(f[first], w[first] >> 1, (w[first] & 1) == 1, percent)
            if s < 0 and len(fs) <= TILE:
                if len(fs) > 1:
                    found[fs.tobytes()] = fs
                return
            parts.extend((fs[i], fs[i : i + TILE], g) for i in range(0, len(fs), TILE))

        def flush() -> pa.RecordBatch:
            rows = [(fs[0], fs, None) for fs in found.values()] + parts
            found.clear()
            parts.clear()
            return _packed_groups(rows)

        rest = (np.zeros(0, np.int64),) * 4
        for b in batches:
            g, s, f, w = (np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate(rest))
            starts = np.r_[0, np.flatnonzero((g[1:] != g[:-1]) | (s[1:] != s[:-1])) + 1]
            size, whole = np.diff(starts), s[starts[:-1]] < 0
            two = starts[:-1][whole & (size == 2)]  # most groups are pairs: the same rule, for all of them at once
            small, large = np.where(w[two] >> 1 <= w[two + 1] >> 1, (two, two + 1), (two + 1, two))
            meets = (100 * (w[small] >> 1) >= percent * (w[large] >> 1)) & ((w[small] & 1 == 0) | ((w[large] & 1 == 0) & (w[small] >> 1 == w[large] >> 1)))
            for i in two[meets & (f[two] != f[two + 1])]:
                found[f[i : i + 2].tobytes()] = f[i : i + 2]
            for i in np.flatnonzero((size > 2) | ~whole):
                own = slice(starts[i], starts[i + 1])
                close(g[starts[i]], s[starts[i]], f[own], w[own])
            last = starts[-1] if len(g) else 0
            rest = g[last:], s[last:], f[last:], w[last:]
            if len(found) + len(parts) > 20_000:
                yield flush()
        if len(rest[0]):
            close(rest[0][0], rest[1][0], rest[2], rest[3])
        yield flush()

    n, early = F.col("n"), F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    rows = sets.select(F.posexplode("prefix").alias("at", "g"), "f", (2 * n + F.when(F.col("at") >= early, 1).otherwise(0)).alias("w"))
    part = F.lit(-1).cast("long")
    often = [(int(h),) for h, c in zip(heavy[0].view(np.int64), heavy[1], strict=True) if c > TILE]
    hot = []
    if often:  # at most HEAVY entries; of them those whose group is larger than a tile, as most are in few prefixes
        known = F.broadcast(sets.sparkSession.createDataFrame(often, "g long"))
        hot = sets.select(F.explode("prefix").alias("g")).join(known, "g").groupBy("g").agg(F.ceil(F.count("*") / TILE).alias("parts")).where("parts > 1").collect()
    if hot:
        rows = rows.join(F.broadcast(sets.sparkSession.createDataFrame(hot, "g long, parts long")), "g", "left")
        part = F.coalesce(F.pmod(F.xxhash64("f", "g"), "parts"), part)
    # 40 bits tell shingles apart well enough here and shuffle three bytes less a row. Two shingles that share them make one group, in
    # which a set may come twice: sorted by w, it counts as the one that meets more sets, so no pair is lost.
    short = F.when(part < 0, F.col("g").bitwiseAND(F.lit(KEY_BITS).cast("long"))).otherwise(F.col("g"))
    rows = rows.select(short.alias("g"), part.alias("s"), "f", "w")
    some = rows.repartition("g", "s").sortWithinPartitions("g", "s", "f", "w").mapInArrow(run, "least long, fs array<long>, big long")
    return united(some)


class Tile:
    """The sets of one tile, in order of size: rows (f, c, bits) and, for exact work, the sorted arrays."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]], percent: int, arrays: dict[int, np.ndarray] | None = None) -> None:
        rows.sort(key=lambda r: (r[2], r[0]))
        self.f, self.n, self.bits = [r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
        self.sizes = np.array(self.n, np.int64)
        self.comps = np.array([r[1] for r in rows], np.int64)
        self.percent, self.arrays = percent, arrays
        self._prepare()

    def _prepare(self) -> None:
        self.folded: dict[int, tuple[int, np.ndarray]] = {}
        if len(self.f) > 12:
            # Bitmaps grow with n: each length has one matrix, of its nodes and of the larger ones within their size band.
            last = {len(b): n for n, b in zip(self.n, self.bits, strict=True)}
            for i, raw in enumerate(self.bits):
                if (size := len(raw)) not in self.folded:
                    end = int(np.searchsorted(self.sizes, 100 * last[size] // self.percent, side="right"))
                    self.folded[size] = i, np.stack([fold(b, size) for b in self.bits[i:end]])

    def forest(self) -> Iterator[tuple[int, int]]:
        """Edges that connect whatever is connected by pairs across components that may link, by their bitmaps; with
        arrays, by pairs that do link. A spanning forest: fewer edges than nodes."""
        tree = self.comps if self.arrays is not None else np.arange(len(self.f))
        for i in range(len(self.f) - 1):
            end = int(np.searchsorted(self.sizes, 100 * self.n[i] // self.percent, side="right"))
            at = i + 1 + np.flatnonzero((tree[i + 1 : end] != tree[i]) & (self.comps[i + 1 : end] != self.comps[i]))
            if len(at):
                at = self._allowed(i, at)
            if len(at) and self.arrays is not None:
                at = self._linked(i, at)
            for j in at:
                if tree[j] != tree[i]:
                    tree[tree == tree[j]] = tree[i]
                    yield self.f[i], self.f[int(j)]

    def _allowed(self, i: int, at: np.ndarray) -> np.ndarray:
        """Of the partners, those whose bitmaps allow a link: an element whose bit the other lacks is not shared."""
        size = len(self.bits[i])
        if self.folded:
            first, matrix = self.folded[size]
            own, other = matrix[i - first], matrix[at - first]
            lone, others = np.bitwise_count(own & ~other).sum(1, dtype=np.int64), np.bitwise_count(other & ~own).sum(1, dtype=np.int64)
        else:
            own = int.from_bytes(self.bits[i], "little")
            ints = [int.from_bytes(fold(self.bits[j], size).tobytes(), "little") for j in at]
            lone, others = np.array([(own & ~o).bit_count() for o in ints]), np.array([(o & ~own).bit_count() for o in ints])
        bound = np.minimum(self.n[i] - lone, self.sizes[at] - others)
        return at[bound >= least_overlap(self.n[i], self.sizes[at], self.percent)]

    def _linked(self, i: int, at: np.ndarray) -> np.ndarray:
        """Of the partners, those that link: the sorted arrays are intersected."""
        own, others = self.arrays[self.f[i]], [self.arrays[self.f[j]] for j in at]
        flat = np.concatenate(others)
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        shared = np.add.reduceat(hit, np.r_[0, np.cumsum([len(o) for o in others])[:-1]], dtype=np.int64)
        return at[shared >= least_overlap(self.n[i], self.sizes[at], self.percent)]


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with an ``f``, and its component ``c`` so far."""
    if labels is None:
        return rows.withColumn("c", F.col("f"))
    return rows.join(labels, "f", "left").withColumn("c", F.coalesce("c", "f"))


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The keys whose rows lie in several components."""
    return rows.groupBy(key).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select(key)


def _candidates(members: DataFrame, nodes: DataFrame, percent: int, kind: type[Tile]) -> DataFrame:
    """(a, b): for every tile of members (lid, f, c) a forest over the pairs that their bitmaps allow, or what else a tile of
    this kind compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in _runs(batches, 1):
            out += kind([r[1:] for r in rows], percent).forest()
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    rows = members.join(nodes.select("f", "n", "bits"), "f").select("lid", "f", "c", "n", "bits")
    return rows.repartition("lid").sortWithinPartitions("lid").mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _arrays(docs: DataFrame, nodes: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(lid, f, c, h): members (lid, f, c) with the sorted shingles of each set, from one text, found by its id and hash (either
    alone may stand for several). Rows that repeat both come more than once."""
    ends = materialise(members.join(nodes.select("f", F.col("row.doc").alias("d"), F.col("row.t").alias("t")), "f"), "ends")
    own = (F.xxhash64("text") == F.col("t")) & F.col("doc").eqNullSafe(F.col("d"))
    texts = docs.join(F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends, own).select("lid", "f", "c", "text")
    cache: dict[str, Shingler] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles = cache.setdefault("s", Shingler(n))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([shingles(t).tobytes() for t in batch.column(3).to_pylist()], pa.binary())], names=["lid", "f", "c", "h"])

    return map_rows(texts, run, "lid long, f long, c long, h binary")


def _verified(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): for every tile of rows (lid, f, c, h) a forest over the pairs across components that link. A tile arrives with
    its arrays and is settled at once: linked sets are one component from then on, and pairs within one are not tried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for held in _runs(batches, 1):
            own = {f: np.frombuffer(h, np.uint64) for _, f, _, h in held}
            comps = {f: c for _, f, c, _ in held}
            out += Tile([(f, comps[f], len(h), bitmap(h)) for f, h in own.items()], percent, own).forest()
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return rows.repartition("lid").sortWithinPartitions("lid").mapInArrow(run, "a long, b long")


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(lid, f, c): rows (key, f, c, n) of large groups as tiles of two blocks. A group is cut, in order of size, into blocks of
    about TILE sets and TILE_SHINGLES shingles; every pair of blocks within the size band is a tile if it spans components.
    Blocks follow from counts by size, so no task sees a whole group."""
    by_size = rows.groupBy("key", "n").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_size.select("key", "n", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum(F.col("rows") * F.col("n")).over(before), F.lit(0)).alias("weight"))
    place = F.pmod(F.xxhash64("f"), "rows")
    block = F.floor((F.col("at") + place) / TILE) + F.floor((F.col("weight") + place * F.col("n")) / TILE_SHINGLES)
    dealt = rows.join(starts, ["key", "n"]).select("key", "f", "c", "n", block.alias("block"))
    blocks = dealt.groupBy("key", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    listed = blocks.groupBy("key").agg(F.collect_list(F.struct("block", "lo")).alias("all"))
    partners = F.filter("all", lambda x: (x["block"] >= F.col("block")) & (x["lo"] * percent <= F.col("hi") * 100))
    pairs = blocks.join(listed, "key").select("key", F.col("block").alias("i"), F.explode(F.transform(partners, lambda x: x["block"])).alias("j"))
    tiles = pairs.select("key", F.xxhash64("key", "i", "j").alias("lid"), F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    members = dealt.join(tiles, ["key", "block"]).select("lid", "f", "c")
    return members.join(_several(members, "lid"), "lid").select("lid", "f", "c")


def _settle(members: DataFrame, nodes: DataFrame, docs: DataFrame, labels: DataFrame | None, n: int, percent: int, kind: type[Tile]) -> DataFrame | None:
    """The components after all links within tiles of members (lid, f, c). What bitmaps leave connected is a cluster, and a
    cluster is verified as one tile; one too large for a tile first in parts, then by one set per component, and last, if it
    still spans components, by all pairs of its blocks across them."""
    found = materialise(_candidates(members, nodes, percent, kind), "candidates")
    clusters = components(found)
    if clusters is None:
        return labels
    clusters = materialise(clusters.withColumnRenamed("c", "k").join(nodes.select("f", "n"), "f"), "clusters")
    size = clusters.groupBy("k").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("parts"))
    large = size.where("parts > 1")
    some_large = not large.isEmpty()
    part = F.xxhash64("k", F.pmod(F.xxhash64("f"), "parts"))
    dealt = _labelled(clusters.join(size, "k").select(part.alias("lid"), "f"), labels).select("lid", "f", "c")
    labels = _merged(labels, materialise(_verified(_arrays(docs, nodes, dealt, n), percent), "links"))
    discard(found)
    while some_large:
        now = _labelled(clusters.join(large.select("k"), "k"), labels)
        now = materialise(now.join(_several(now, "k"), "k").select(F.col("k").alias("key"), "f", "c", "n"), "unsettled")
        if now.isEmpty():
            break
        one = now.groupBy("key", "c").agg(F.min(F.struct("n", "f")).alias("x")).select("key", "c", F.col("x.f").alias("f"), F.col("x.n").alias("n"))
        size = one.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("parts"))
        dealt = one.join(size, "key").select(F.xxhash64("key", F.pmod(F.xxhash64("f", F.lit(7)), "parts")).alias("lid"), "f", "c")
        links = materialise(_verified(_arrays(docs, nodes, dealt, n), percent), "links")
        last = links.isEmpty()
        if last:
            links = materialise(_verified(_arrays(docs, nodes, _block_pairs(now, percent), n), percent), "links")
        labels = _merged(labels, links)
        if last:
            break
    return labels


def nodes_of(sets: DataFrame) -> DataFrame:
    """(f, row, n, bits): the distinct sets, each with one row that has its text."""
    row = F.struct(F.col("doc").isNull().alias("null"), "doc", "t")
    return materialise(sets.where(F.length("bits") > 0).groupBy("f").agg(F.min(row).alias("row"), F.max("n").alias("n"), F.first("bits").alias("bits")), "nodes")


def settled(groups: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int, kind: type[Tile] = Tile) -> DataFrame | None:
    """(f, c): the components that links within the written groups (lid, fs, big) make; None without links. Deletes the groups."""
    labels = _settle(_labelled(groups.select("lid", F.explode("fs").alias("f")), None), nodes, docs, None, n, percent, kind)
    big = groups.where("big IS NOT NULL").select(F.col("big").alias("key"), F.explode("fs").alias("f")).distinct()
    big = _labelled(big, labels)
    big = materialise(big.join(_several(big, "key"), "key").join(nodes.select("f", "n"), "f"), "big")
    if not big.isEmpty():  # groups beyond a tile that still span components: all pairs of blocks across them
        labels = _settle(_block_pairs(big, percent), nodes, docs, labels, n, percent, kind)
    discard(groups, big)
    return labels


def least_ids(sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc, n_shingles, component_id) of every row of ``sets``. The least id of a set counts every row of it: bits are on the
    first that a task met, of any id."""
    ids = sets.where("f IS NOT NULL").groupBy("f").agg(F.min("doc").alias("doc"))
    of = _labelled(ids, labels)
    least = of.groupBy("c").agg(F.min("doc").alias("component_id"))
    named = of.join(least, "c").select("f", "component_id")
    return sets.select("doc", "f", "n").join(named, "f", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(``id_col``, n_shingles, component_id) of every row: the size of its set of n-word shingles, and the least id
    reachable by links 100 |A n B| >= percent |A u B|, itself included.

    A null, empty or blank text has an empty set and links with nothing. Each row is a document of its own: rows stay repeated,
    and links join rows, so that two texts of one id may have two components. A null id stays out of the components' least
    ids. Other columns are not read. Ids are longs. Sets are told apart by a 64-bit hash of their sorted hashes. Memory: a task
    holds one tile: at most 2 x TILE bitmaps, or the arrays of about 2 x TILE_SHINGLES shingles (one set more, however long).
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    heavy = _heavy(docs, n)
    sets = materialise(_sets(docs, n, percent, heavy), "sets")
    nodes = nodes_of(sets)
    groups = materialise(_groups(sets.where(F.length("bits") > 0), heavy, percent), "groups")
    labels = settled(groups, nodes, docs, n, percent)
    return least_ids(sets, labels).withColumnRenamed("doc", id_col)
