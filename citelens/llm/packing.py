"""Variable-capacity best-fit packing of token lengths into training sequences.

Several sequence lengths are permitted, each at a cost. Items go, longest first, into the open bin they fill best; an item
that fits none opens a bin of the length that costs least per token it can hold; in the end every bin shrinks to the
smallest length its contents fit.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder
from .common import map_rows, materialise

LENGTHS = (512, 1024, 2048, 4096)
GROUP = 2_000


def default_cost(length: int) -> float:
    """Per sequence: a fixed part, its tokens, and attention's share, which grows with the square."""
    return 64 + length + length * length / 16384


def token_counts(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_tokens) of every row: byte-level BPE tokens of the whole text; 0 for null. One narrow pass."""
    some = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = coder(ranks, pattern).encode_ordinary
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], names=["id", "n_tokens"])

    return map_rows(some, run, f"id {some.schema['id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("id", id_col)


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = default_cost) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (item, start, size, bin, offset) in the order of the items, and each bin's length.

    An item over the greatest length is cut into pieces of that length and a rest. An item of size 0 is one piece of size 0.
    """
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    pieces = [(min(top, n - at), i, at) for i, n in enumerate(sizes) for at in (range(0, n, top) if n else (0,))]
    order = sorted(range(len(pieces)), key=lambda k: (-pieces[k][0], k))
    left = sum(n for n, _, _ in pieces)
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    capacity: list[int] = []
    used: list[int] = []
    placed: list[tuple[int, int, int, int, int]] = [None] * len(pieces)  # type: ignore[list-item]
    for k in order:
        n, item, start = pieces[k]
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free = min((c for c in lengths if c >= n), key=lambda c: (cost(c) / max(1, min(c, left)), c))
            b = len(capacity)
            capacity.append(free)
            used.append(0)
        placed[k] = (item, start, n, b, used[b])
        used[b] += n
        left -= n
        bisect.insort(room, (free - n, b))
    return placed, [next(c for c in lengths if c >= u) for u in used]


def pack(df: DataFrame, id_col: str = "doc_id", length: str = "n_tokens", lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = default_cost, group: int = GROUP) -> DataFrame:
    """One row per piece: ``id_col``, piece (from 0), start, n_tokens, bin_id, bin_length, bin_offset. start and n_tokens are
    the piece's span among its row's tokens, bin_offset its place in the bin.

    ``length`` is the column of token counts; null or negative counts as 0. Rows are dealt by a hash of id and length to groups
    of about ``group`` rows, each packed on its own: only ids and lengths are shuffled, a task holds one group, and the waste
    is at most a few part-filled bins per group. Rows of equal id and length, however many, are counted first and dealt in
    runs of at most ``group``; every one is packed. Ties go by id. The result depends on the rows alone, not on their order or
    partitions. Other columns are not read. bin_id is group * 2^32 + number.
    """
    size = F.greatest(F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)), F.lit(0))
    rows = materialise(df.select(F.col(f"`{id_col}`").alias("id"), size.alias("n")).groupBy("id", "n").agg(F.count("*").alias("rows")), "lengths")
    groups = max(1, -(-(rows.agg(F.sum("rows")).first()[0] or 0) // group))
    kind = rows.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("id", "ascending"), ("at", "ascending")])
        g, copies = table.column("g")[0].as_py(), table.column("copies").to_numpy()
        each = np.repeat(np.arange(len(copies)), copies)
        ids = table.column("id").take(pa.array(each))
        placed, capacity = best_fit(table.column("n").to_numpy()[each].tolist(), lengths, cost)
        item, start, n, b, offset = (list(c) for c in zip(*placed, strict=True))
        return pa.table({
            "id": ids.take(pa.array(item)), "piece": pa.array([s // max(lengths) for s in start], pa.int32()), "start": pa.array(start, pa.int64()),
            "n_tokens": pa.array(n, pa.int64()), "bin_id": pa.array([(g << 32) + x for x in b], pa.int64()),
            "bin_length": pa.array([capacity[x] for x in b], pa.int32()), "bin_offset": pa.array(offset, pa.int32()),
        })

    runs = rows.select("id", "n", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(group).cast("long"))).alias("at"))
    dealt = runs.select("id", "n", "at", F.least(F.lit(group).cast("long"), F.col("rows") - F.col("at")).alias("copies"), F.pmod(F.xxhash64("id", "n", "at"), F.lit(groups)).alias("g"))
    out = dealt.groupBy("g").applyInArrow(run, f"id {kind}, piece int, start long, n_tokens long, bin_id long, bin_length int, bin_offset int")
    return out.withColumnRenamed("id", id_col)
