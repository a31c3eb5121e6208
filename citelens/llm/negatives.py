"""Hard-negative mining by an exact kNN join over Voronoi cells.

1. Vectors become integers, v = floor(scale x), so scores are exact. Equal rows (id, label, vector) are one row with a count.
2. Norm augmentation turns the largest inner product into the least distance: with M the largest norm of a row, a candidate
   is (v, sqrt(M^2 - |v|^2)) and an anchor (a, 0); then distance^2 = |a|^2 + M^2 - 2 score.
3. Pivots come from a bounded sample of rows (k-means++ seeding, the bound is a parameter). Every anchor belongs to the cell
   of its nearest pivot. Neighbouring cells are put together into groups of up to BLOCK anchors; a larger cell is a group cut
   into blocks.
4. First every candidate meets the anchors of its own group. What an anchor has found bounds the distance at which a further
   row could still matter; a cell's largest such distance and the ring its anchors lie in bound the candidates. Each
   candidate is then sent to those other groups that it might serve, and to no others.
5. A tile is one block of anchors and one part of its group's candidates, so no cell, however hot, is one task. Its task
   streams the candidates past the anchors and keeps the best few of every anchor; windows merge the tiles.

Positives are the join within a label. Negatives are the same join outside it, with a window of scores for each positive. The
pruning is exact whatever the pivots are: they only decide how much is sent. On vectors without clusters nothing is pruned and
every candidate meets every group of anchors, which a query set against all rows in blocks costs anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise

PIVOTS = 128
SAMPLE = 8_192  # rows that pivots are chosen from
BLOCK = 1_024  # anchors of a tile
PART = 262_144  # candidates of a tile, about
LEAST_PART = 256  # smaller parts are not worth a tile
STEP = 1_024  # candidates multiplied at once
LIMIT = (1 << 26) - 1  # components saturate here, so that sums of 2,047 products fit 64 bits
FAR = 1 << 62
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "row long, w int, score long, id long"


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column as float64, shorter ones padded with zeros."""
    lengths, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < lengths[:, None]] = values
    return out


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """k-means++ seeding over the sample's rows, with a fixed seed; fewer if fewer rows differ."""
    rng = np.random.default_rng(0)
    chosen = [sample[0]]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < most and gap.sum() > 0:
        chosen.append(sample[rng.choice(len(sample), p=gap / gap.sum())])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


class _Space:
    """The pivots in the augmented space."""

    def __init__(self, pivots: np.ndarray, dim: int, most2: int) -> None:
        self.pivots, self.dim, self.most2 = pivots, dim, most2
        self.pivots2 = (pivots**2).sum(1)

    def candidates(self, v: np.ndarray) -> np.ndarray:
        """Distances (rows, pivots)."""
        lift = np.sqrt(np.maximum(0, self.most2 - (v**2).sum(1)))
        return np.sqrt(np.maximum(0, self.most2 + self.pivots2 - 2 * (v @ self.pivots[:, :-1].T + lift[:, None] * self.pivots[:, -1])))

    def anchors(self, a: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + self.pivots2 - 2 * (a @ self.pivots[:, :-1].T)))


def _chain(pivots: np.ndarray) -> list[int]:
    """All cells, each followed by the nearest one not yet listed."""
    left, out = set(range(1, len(pivots))), [0]
    while left:
        rest = sorted(left)
        out.append(rest[int(np.argmin(((pivots[rest] - pivots[out[-1]]) ** 2).sum(1)))])
        left.discard(out[-1])
    return out


def _grouped(order: list[int], counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each cell, blocks of each group)."""
    group, sizes = np.zeros(len(counts), np.int64), [0]
    for c in order:
        if sizes[-1] and sizes[-1] + counts[c] > block:
            sizes.append(0)
        group[c] = len(sizes) - 1
        sizes[-1] += int(counts[c])
    return group, np.maximum(1, -(-np.array(sizes) // block))


class _Best:
    """The anchors of a tile and the best ``k`` rows of each of their windows so far: greatest score, then least id, null last."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> None:
        self.rows, self.labels, self.vectors, self.hi, self.same, self.k = rows, labels, vectors, hi, same, k
        self.least = lo.astype(np.float64)  # the score a row must reach
        self.top = hi.max(1)
        self.norm = float((vectors**2).sum(1).max())
        self.q, self.score, self.id, self.none = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, rows: np.ndarray, ids: np.ndarray, none: np.ndarray, labels: np.ndarray, copies: np.ndarray, v: np.ndarray) -> None:
        if self.norm * float((v**2).sum(1).max()) < 2.0**106:
            scores = self.vectors @ v.T  # every partial sum is an integer below 2^53
        else:
            scores = self.vectors.astype(np.int64) @ v.T.astype(np.int64)
        at = (self.labels[:, None] == labels) == self.same
        at &= (scores >= self.least.min(1)[:, None]) & (scores <= self.top[:, None])
        i, j = np.nonzero(at)
        if not len(i):
            return
        s, m = scores[i, j], np.minimum(copies[j] - (self.rows[i] == rows[j]), self.k)
        if not (m > 0).any():
            return
        new = []
        for w in range(self.hi.shape[1]):
            own = np.flatnonzero((m > 0) & (s >= self.least[i, w]) & (s <= self.hi[i, w]))
            own = np.repeat(own, m[own])
            new.append((i[own] * self.hi.shape[1] + w, s[own].astype(np.int64), ids[j[own]], none[j[own]]))
        q, score, id_, none = (np.concatenate([h, *(x[n] for x in new)]) for n, h in enumerate((self.q, self.score, self.id, self.none)))
        order = np.lexsort((id_, none, -score, q))
        starts = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        full = order[place == self.k - 1]
        self.least[q[full] // self.hi.shape[1], q[full] % self.hi.shape[1]] = score[full]
        order = order[place < self.k]
        self.q, self.score, self.id, self.none = q[order], score[order], id_[order], none[order]

    def found(self) -> pa.RecordBatch:
        width = self.hi.shape[1]
        columns = [pa.array(self.rows[self.q // width]), pa.array((self.q % width).astype(np.int32)), pa.array(self.score), pa.array(self.id, mask=self.none.astype(bool))]
        return pa.RecordBatch.from_arrays(columns, names=["row", "w", "score", "id"])


def _solver(dim: int, same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a stream of tiles, anchors before candidates: the best rows of each tile."""

    def windows(column: pa.ListArray, n: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, best = None, [], None
        for b in batches:
            tiles, kinds = b.column("tile").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(tiles)], strict=True):
                if hi <= lo:
                    continue
                if tiles[lo] != tile:
                    if best is not None:
                        yield best.found()
                    tile, held, best = tiles[lo], [], None
                part = b.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    held.append(part)
                    continue
                if best is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    c = {n: t.column(n).chunk(0) for n in ("row", "label", "v", "lo", "hi")}
                    best = _Best(c["row"].to_numpy(), c["label"].to_numpy(), _matrix(c["v"], dim), windows(c["lo"], t.num_rows), windows(c["hi"], t.num_rows), same, k)
                if best is not None:
                    for at in range(0, part.num_rows, STEP):
                        x = part.slice(at, STEP)
                        ids = x.column("id")
                        best.add(x.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), x.column("label").to_numpy(), x.column("copies").to_numpy(), _matrix(x.column("v"), dim))
        if best is not None:
            yield best.found()

    return run


class _Join:
    """One table of rows and one of anchors, joined several times."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, space: _Space, block: int, part: int) -> None:
        self.rows, self.anchors, self.space, self.part = rows, anchors, space, part
        found = anchors.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("outer"), F.min("d").alias("inner")).collect()
        cells = len(space.pivots)
        self.outer, self.inner, counts = np.full(cells, -np.inf), np.full(cells, np.inf), np.zeros(cells, np.int64)
        for r in found:
            counts[r.cell], self.outer[r.cell], self.inner[r.cell] = r.n, r.outer, r.inner
        self.group, self.blocks = _grouped(_chain(space.pivots), counts, block)

    def _dealt(self, anchors: DataFrame, targets: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """(tile, kind, row, id, label, copies, v, lo, hi): ``targets`` gives the groups (rows, groups) that rows at these
        distances from the pivots go to."""
        space, spark = self.space, self.rows.sparkSession

        def serve(batch: pa.RecordBatch) -> np.ndarray:
            return targets(space.candidates(_matrix(batch.column("v"), space.dim)))

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = serve(batch).sum(0)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["g", "n"])

        sent = np.zeros(len(self.blocks), np.int64)
        for r in map_rows(self.rows.select("v"), count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
            sent[r.g] = r.n
        slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread = -(-slots * sent // max(1, int((sent * self.blocks).sum())))
        parts = np.maximum(1, np.maximum(-(-sent // self.part), np.minimum(spread, -(-sent // LEAST_PART))))
        first = np.r_[0, np.cumsum(self.blocks * parts)]
        group, blocks = self.group, self.blocks

        def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, g = np.nonzero(serve(batch))
            n, place = blocks[g], np.arange(len(g))
            place, b = np.repeat(place, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, g = row[place], g[place]
            tile = first[g] + b * parts[g] + batch.column("spread").to_numpy()[row] % parts[g]
            taken = batch.select(["row", "id", "label", "copies", "v"]).take(pa.array(row))
            return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(np.ones(len(tile), np.int32)), *taken.columns], names=["tile", "kind", *taken.schema.names])

        spread_of = F.pmod(F.xxhash64("row"), F.lit(1 << 40)).alias("spread")
        sent_rows = map_rows(self.rows.select("row", "id", "label", "copies", "v", spread_of), deal, "tile long, kind int, row long, id long, label long, copies long, v array<int>")
        of = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("__g") + 1)
        own = anchors.withColumn("__g", F.element_at(F.array(*[F.lit(int(x)) for x in group]), F.col("cell") + 1))
        base = of(first[:-1]) + F.pmod(F.xxhash64("row"), of(blocks)) * of(parts)
        own = own.select(F.explode(F.transform(F.sequence(F.lit(0), of(parts) - 1), lambda p: p + base)).alias("tile"), F.lit(0).alias("kind"), "row", "id", "label", "copies", "v", "lo", "hi")
        both = own.unionByName(sent_rows, allowMissingColumns=True)
        return both.repartitionById(slots, (F.col("tile") % slots).cast("int")).sortWithinPartitions("tile", "kind")

    def best(self, windows: DataFrame, same: bool, k: int, label: str) -> DataFrame:
        """(row, w, score, id, place): the best ``k`` rows of every window; ``windows`` holds (row, lo array, hi array), of one
        length. A window without a row has none."""
        space, group = self.space, self.group
        slack = 1e-6 * (1 + np.sqrt(space.most2))
        groups = len(self.blocks)
        own = np.zeros((len(group), groups), bool)
        own[np.arange(len(group)), group] = True
        anchors = self.anchors.join(windows, "row")
        solve = _solver(space.dim, same, k)
        first = materialise(self._dealt(anchors, lambda d: own[d.argmin(1)]).mapInArrow(solve, FOUND), f"{label}-own")
        place = F.row_number().over(Window.partitionBy("row", "w").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        if groups == 1:
            return first.withColumn("place", place).where(F.col("place") <= k)
        reached = first.withColumn("place", place).where(F.col("place") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
        raised = anchors.join(reached, "row", "left").withColumn("lo", F.transform("lo", lambda x, w: F.greatest(x, F.coalesce(F.col("reached")[w.cast("int")], x))))
        raised = raised.select("row", "id", "label", "copies", "v", "norm2", "cell", "lo", "hi")
        raised = materialise(raised, f"{label}-anchors")
        open_ = F.array_min(F.transform("lo", lambda x, w: F.when(x <= F.col("hi")[w], x)))
        needs = F.sqrt(F.greatest(F.lit(0.0), F.col("norm2").cast("double") + float(space.most2) - 2 * open_.cast("double")))
        reach = np.full(len(group), -np.inf)
        for r in raised.groupBy("cell").agg(F.max(needs).alias("reach")).where("reach IS NOT NULL").collect():
            reach[r.cell] = r.reach
        inner, outer = self.inner, self.outer

        def others(d: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore"):
                near = (d - outer <= reach + slack) & (inner - d <= reach + slack)
            out = np.zeros((len(d), groups), bool)
            for g in range(groups):
                out[:, g] = near[:, group == g].any(1)
            return out & ~own[d.argmin(1)]

        rest = materialise(self._dealt(raised, others).mapInArrow(solve, FOUND), f"{label}-others")
        discard(raised)
        return first.unionByName(rest).withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, part: int = PART,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where ``is_anchor`` holds, its
    ``positives`` best other rows of its label; for each of those, the ``negatives`` best rows of other labels whose score
    lies between ``low`` and ``high`` percent of the positive's. Scores are inner products of floor(``scale`` x); higher ones
    come first, then smaller ids, null ids last.

    Rows with a null label or vector, or a null, NaN or infinite component take no part. Shorter vectors count as padded with
    zeros, an empty one scores 0 with all. Components saturate at +-LIMIT; vectors have at most 2,047 components. Equal rows
    are rows of their own: each counts as a positive or negative, and each such anchor has its own results. A null
    ``is_anchor`` is false. Ids and labels are longs; other columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    component = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    vec, label = F.col(f"`{vec_col}`"), F.col(f"`{label_col}`").cast("long")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(vec.isNotNull() & label.isNotNull()).where(sound)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.transform(vec, component).alias("v"))
    rows = rows.groupBy("id", "label", "anchor", "v").agg(F.count("*").alias("copies"))
    norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    rows = materialise(rows.withColumn("norm2", norm2).withColumn("row", F.monotonically_increasing_id()), "vectors")
    seen = rows.agg(F.max("norm2").alias("most2"), F.max(F.size("v")).alias("dim"), F.count_if("anchor").alias("anchors")).first()
    if not seen.anchors:
        return spark.createDataFrame([], RESULT)
    dim = max(1, seen.dim)
    drawn = rows.select("v", F.xxhash64("v", "id", "label").alias("h")).orderBy("h").limit(sample).select("v").toArrow()
    v = _matrix(drawn.column("v").combine_chunks(), dim)
    lift = np.sqrt(np.maximum(0, seen.most2 - (v**2).sum(1)))
    space = _Space(_pivots(np.c_[v, lift], pivots), dim, seen.most2)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = space.anchors(_matrix(batch.column("v"), dim))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=[*batch.schema.names, "cell", "d"])

    columns = "row long, id long, label long, copies long, norm2 long, v array<int>"
    anchors = materialise(map_rows(rows.where("anchor").select("row", "id", "label", "copies", "norm2", "v"), place, f"{columns}, cell int, d double"), "anchors")
    join = _Join(rows, anchors, space, block, part)
    wide = anchors.select("row", F.array(F.lit(-FAR)).alias("lo"), F.array(F.lit(FAR)).alias("hi"))
    near = materialise(join.best(wide, True, positives, "positives"), "positives")

    least = F.expr(f"({low} * cast(score as decimal(20,0))) div 100 + if(({low} * cast(score as decimal(20,0))) % 100 > 0, 1, 0)").cast("long")
    most = F.expr(f"({high} * cast(score as decimal(20,0))) div 100 - if(({high} * cast(score as decimal(20,0))) % 100 < 0, 1, 0)").cast("long")
    at = F.struct((F.col("place") - 1).alias("w"), least.alias("lo"), most.alias("hi"))
    listed = near.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct((F.col("place") - 1).alias("w"), at.alias("at")))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(positives - 1))
    bound = lambda end, none: F.transform(every, lambda w: F.coalesce(F.col("m")[w][end], F.lit(none)))
    windows = listed.select("row", bound("lo", FAR).alias("lo"), bound("hi", -FAR).alias("hi"))
    far = join.best(windows, False, negatives, "negatives")
    positive = near.select("row", (F.col("place") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    whose = anchors.select("row", F.col("id").alias("anchor_id"), "copies")
    out = far.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(positive, ["row", "w"]).join(whose, "row")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
