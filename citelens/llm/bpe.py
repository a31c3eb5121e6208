"""Byte-level BPE.

A text is split into words by a pattern; each distinct word is merged once, from single bytes, always taking the adjacent
pair of least rank (leftmost at a tie). Ids are ranks. Decoding looks pieces up and concatenates them, in Spark expressions.

The fold over ranked merges exists twice, with equal results: ``fold_word`` in Spark's higher-order functions over a literal
map of ranks (``encode_folded``), and ``Merger`` in Python (``encode``), which the queries use for its lower cost.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16384
BLOCK_CHARS = 16_000_000
#: Words of more bytes are merged with a heap, with equal results: the fold's work grows with a word's length squared.
FOLD_BYTES = 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_coders: dict[tuple[str, str], tiktoken.Encoding] = {}
_last: list = [None, None, None]


def coder(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    """One per worker and vocabulary (told by a digest of all ranks), since building it takes a while."""
    if _last[0] is not ranks or _last[1] != pattern:
        digest = hashlib.sha256(b"".join(len(k).to_bytes(4, "big") + k + v.to_bytes(4, "big") for k, v in sorted(ranks.items()))).hexdigest()
        if (digest, pattern) not in _coders:
            _coders[digest, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _last[:] = ranks, pattern, _coders[digest, pattern]
    return _last[2]


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal array of small maps by crc32 of the key: Spark's map lookup is a scan, which so stays short.
    Keys hold one character (U+0000 to U+00FF) per byte. ``from_json`` of a literal is folded to a literal by the optimizer."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for raw, rank in ranks.items():
        key = raw.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(ranks: Column, key: Column) -> Column:
    return F.try_element_at(F.get(ranks, (F.crc32(key.cast("binary")) % BUCKETS).cast("int")), key)


def fold_word(word: Column, ranks: Column) -> Column:
    """The ids of one word, a string with one character per byte, as array<int>."""

    def let(value: Column, f) -> Column:
        return F.get(F.transform(F.array(value), f), 0)

    return let(ranks, lambda r: _fold(word, r, let))


def _fold(word: Column, ranks: Column, let) -> Column:
    def pair(a: Column, b: Column) -> Column:
        return _rank(ranks, F.concat(a, b))  # null next to an end

    def state(s: Column) -> Column:
        """Pieces, each one's rank with its right neighbour, and the first place of the least rank (null: none left)."""
        return F.struct(s["parts"].alias("parts"), s["ranks"].alias("ranks"), F.array_position(s["ranks"], F.array_min(s["ranks"])).cast("int").alias("pos"))

    def merge(s: Column, _: Column) -> Column:
        parts, at, pos = s["parts"], s["ranks"], s["pos"]
        here = F.concat(F.get(parts, pos - 1), F.get(parts, pos))
        left = F.when(pos > 1, F.array(pair(F.get(parts, pos - 2), here))).otherwise(F.array().cast("array<int>"))
        merged = F.struct(
            F.concat(F.slice(parts, F.lit(1), pos - 1), F.array(here), F.slice(parts, pos + 2, F.size(parts))).alias("parts"),
            F.concat(F.slice(at, F.lit(1), F.greatest(pos - 2, F.lit(0))), left, F.array(pair(here, F.get(parts, pos + 1))), F.slice(at, pos + 2, F.size(at))).alias("ranks"),
        )
        return F.when(pos.isNull(), s).otherwise(let(merged, state))

    bytes_of = F.filter(F.split(word, ""), lambda c: c != "")
    begin = let(bytes_of, lambda b: F.struct(b.alias("parts"), F.transform(b, lambda c, i: pair(c, F.get(b, i + 1))).alias("ranks")))
    merged = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), let(begin, state), merge, lambda s: s["parts"])
    whole = _rank(ranks, word)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(merged, lambda p: _rank(ranks, p)))


def heap_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids in about n log n steps, for very long words."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = ends[i]
        if j < n and (r := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := ends[i]) >= n or ends[j] != end:
            continue
        alive[j], ends[i] = False, end
        if end < n:
            before[end] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class Merger(dict):
    """The ids of words, merged when first asked for: pairs of least rank first, leftmost at a tie."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 1_000_000:  # only a memo
            self.clear()
        raw = word.encode("utf-8", "replace")
        found = self[word] = heap_word(raw, self.ranks) if len(raw) > FOLD_BYTES else self.merged(raw)
        return found

    def merged(self, raw: bytes) -> list[int]:
        get = self.ranks.get
        whole = get(raw)
        if whole is not None:
            return [whole]
        none = 1 << 31
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>) of every row of ``df``; each match of ``pattern`` is merged separately, no special
    tokens. A null or empty text has no ids; repeated rows stay repeated; other columns are not read. The ranks must hold
    all single bytes. Narrow; a task's distinct words are merged once (a memo of bounded size), in Python: as a
    higher-order-function fold (``encode_folded``, equal results) this costs more than twice the CPU, see the README.
    """
    kind = df.schema[id_col].dataType.simpleString()
    inner = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, merged = regex.compile(pattern).findall, Merger(ranks)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                coded = [np.fromiter(chain.from_iterable(map(merged.__getitem__, find(t))), np.int32) if t else np.zeros(0, np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)))], names=["id", "ids"])

    return inner.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def encode_folded(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with the merges as a fold in Spark expressions. The texts of a task are split into words; a block's
    distinct words travel as one array, the texts as indices into it, and nothing is shuffled. A task's memory is one block
    of at most ``BLOCK_CHARS`` characters, or one longer text."""
    kind = df.schema[id_col].dataType.simpleString()
    inner = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type: list[pa.DataType] = []

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        words: dict[str, int] = {}
        ids: list = []
        spans: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            raw = [w.encode("utf-8", "replace") for w in words]
            long = [heap_word(w, ranks) if len(w) > FOLD_BYTES else None for w in raw]
            columns = [pa.array([ids], pa.list_(id_type[0])), pa.array([[len(x) for x in spans]], pa.list_(pa.int32()))]
            flat = np.concatenate(spans) if spans else np.zeros(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, pa.int32())))
            columns.append(pa.array([[w.decode("latin-1") if n is None else "" for w, n in zip(raw, long, strict=True)]], pa.list_(pa.string())))
            columns.append(pa.array([long], pa.list_(pa.list_(pa.int32()))))
            return pa.RecordBatch.from_arrays(columns, names=["id", "n", "at", "words", "long"])

        for batch in batches:
            if batch.num_rows and not id_type:
                id_type.append(batch.schema.field(0).type)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = find(text) if text else []
                spans.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
                ids.append(i)
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield block()
                    words, ids, spans, size = {}, [], [], 0
        if ids:
            yield block()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n, at, coded = (batch.column(c)[r].values for c in range(4))
                at, flat = at.to_numpy(), coded.flatten().to_numpy()
                starts = coded.offsets.to_numpy() - coded.offsets[0].as_py()
                size = np.diff(starts)
                edges = np.concatenate([[0], np.cumsum(n.to_numpy())])
                step = 512
                for k in range(0, len(ids), step):
                    own = at[edges[k] : edges[min(k + step, len(ids))]]
                    lengths = size[own]
                    total = np.concatenate([[0], np.cumsum(lengths)])
                    take = np.arange(total[-1]) + np.repeat(starts[own] - total[:-1], lengths)
                    offsets = total[edges[k : k + step + 1] - edges[k]] if k + step <= len(ids) else total[edges[k:] - edges[k]]
                    out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[take].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([ids.slice(k, step), out], names=["id", "ids"])

    packed = inner.mapInArrow(blocks, f"id array<{kind}>, n array<int>, at array<int>, words array<string>, long array<array<int>>")
    literal = rank_map(ranks)
    coded = F.zip_with("words", "long", lambda w, known: F.when(known.isNotNull(), known).otherwise(fold_word(w, literal)))
    return packed.select("id", "n", "at", coded.alias("coded")).mapInArrow(expand, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces, concatenated. Joined as hex digits, so that work grows with the length."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    table = F.split(F.lit(" ".join(p.hex() for p in pieces)), " ")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by single spaces."""
    return F.array_join(ids.cast("array<string>"), " ")
