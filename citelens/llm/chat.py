"""Chat formatting, assembled as tokens.

Every turn becomes ``<s>`` role ``[INST]`` text ``[/INST]`` ``</s>``. The four markers are reserved ids spliced between
segments that are encoded separately, so no content can turn into a marker; in the formatted string, control strings that
occur in content are escaped reversibly. Where the loss mask switches on and off follows from prefix sums of segment lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder

START, BODY, STOP, END = MARKERS = ("<s>", "[INST]", "[/INST]", "</s>")
ESCAPE = "~"


def escape(text: str) -> str:
    """``~`` becomes ``~0``; a control string gets ``~1`` after its first character."""
    text = text.replace(ESCAPE, "~0")
    for m in MARKERS:
        text = text.replace(m, f"{m[0]}~1{m[1:]}")
    return text


def unescape(text: str) -> str:
    return text.replace("~1", "").replace("~0", ESCAPE)


def reserved(ranks: dict[bytes, int]) -> dict[str, int]:
    """The first free ids, in the markers' order."""
    return {m: max(ranks.values()) + 1 + i for i, m in enumerate(MARKERS)}


def format_chats(df: DataFrame, ranks: dict[bytes, int], pattern: str, learn: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) -> one row per conv_id: n_turns, formatted string, token_ids, loss_mask (1 on the
    tokens of the texts whose role is ``learn``).

    Turns follow by turn, nulls first; equal turns by role, then text; repeated rows are turns of their own. A null role or
    text counts as empty; null conv_ids form one conversation. Other columns are not read. Texts are encoded before the one
    shuffle (by conv_id), after which a sorted stream is cut into conversations: a task holds one conversation at a time.
    """
    ids = reserved(ranks)
    conv = df.schema["conv_id"].dataType.simpleString()

    names = ["conv_id", "n_turns", "formatted", "token_ids", "loss_mask"]

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = coder(ranks, pattern).encode_ordinary, {}
        ints = pa.list_(pa.int32())
        for b in batches:
            roles = b.column(2).to_pylist()
            for x in set(roles) - known.keys():
                known[x] = encode(escape(x))
            t = [encode(escape(x)) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([known[x] for x in roles], ints), pa.array(t, ints)], names=["conv_id", "turn", "role", "text", "r", "t"])

    def assemble(rows: list[tuple]) -> tuple:
        """Rows (role, text, r, t) of one conversation."""
        one = {m: np.array([i], np.int32) for m, i in ids.items()}
        text = "".join(x for role, body, _, _ in rows for x in (START, escape(role), BODY, escape(body), STOP, END))
        segments = [x for _, _, r, t in rows for x in (one[START], r, one[BODY], t, one[STOP], one[END])]
        on = np.array([x for role, _, _, _ in rows for x in (0, 0, 0, int(role == learn), 0, 0)]) == 1
        ends = np.cumsum([len(s) for s in segments])  # prefix sums: where each segment ends
        switch = np.zeros(int(ends[-1]) + 1, np.int8)
        np.add.at(switch, np.r_[0, ends[:-1]][on], 1)
        np.add.at(switch, ends[on], -1)
        return len(rows), text, np.concatenate(segments), np.cumsum(switch[:-1], dtype=np.int8)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, done, size, kind = None, [], [], 0, None

        def out() -> pa.RecordBatch:
            c, n, text, tokens, mask = zip(*done, strict=True)
            ends = pa.array(np.r_[0, np.cumsum([len(t) for t in tokens])], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (tokens, mask)]
            return pa.RecordBatch.from_arrays([pa.array(c, kind), pa.array(n, pa.int64()), pa.array(text, pa.string()), *lists], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            lists = [(b.column(i).offsets.to_numpy(), b.column(i).values.to_numpy()) for i in (4, 5)]
            for i, (c, role, body) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                if rows and c != key:
                    done.append((key, *assemble(rows)))
                    size, rows = size + len(done[-1][2]), []
                    if size > 4_000_000 or len(done) >= 1000:
                        yield out()
                        done, size = [], 0
                key = c
                rows.append((role, body, *(v[o[i] : o[i + 1]] for o, v in lists)))
        if rows:
            done.append((key, *assemble(rows)))
            yield out()

    flat = df.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turn = flat.schema["turn"].dataType.simpleString()
    coded = flat.mapInArrow(turns, f"conv_id {conv}, turn {turn}, role string, text string, r array<int>, t array<int>")
    dealt = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(gather, f"conv_id {conv}, n_turns long, formatted string, token_ids array<int>, loss_mask array<tinyint>")


class Reader:
    """Reads conversations back from their tokens alone."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ids, self.decode = reserved(ranks), coder(ranks, pattern).decode_bytes
        self.first = min(self.ids.values())

    def __call__(self, tokens: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], str]:
        """The turns (role, text), and all text under the mask."""
        tokens, mask = np.asarray(tokens), np.asarray(mask)
        text = lambda part: unescape(self.decode(part.tolist()).decode())
        at = np.flatnonzero(tokens >= self.first)  # markers; every turn has four
        start, body, stop = (at[tokens[at] == self.ids[m]] for m in (START, BODY, STOP))
        turns = [(text(tokens[a + 1 : b]), text(tokens[b + 1 : c])) for a, b, c in zip(start, body, stop, strict=True)]
        return turns, text(tokens[mask == 1])


def read_back(tokens: list[int], mask: list[int], ranks: dict[bytes, int], pattern: str) -> tuple[list[tuple[str, str]], str]:
    """One conversation through ``Reader``."""
    return Reader(ranks, pattern)(tokens, mask)
