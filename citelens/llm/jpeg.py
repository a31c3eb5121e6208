"""Media columns: progressive JPEG, decoded in numpy, and bytes stored in its coefficients.

The decoder takes progressive Huffman JPEGs (8-bit samples, one to four components, any sampling factors, restart
intervals): spectral-selection and successive-approximation scans accumulate into coefficient arrays, which are dequantised,
inverse-transformed as one matrix product, upsampled and converted to full-resolution RGB.

Entropy decoding is sequential bit by bit in general (``_Bits``). Two kinds of scans are decoded as a whole instead: one in
which every symbol of the table and its extra bits have the same total length (so values stand at a fixed stride), and
refinement of blocks in which every coefficient of the band is non-zero already (plain correction bits after an end-of-band
run). ``write_bytes`` only makes such scans: a byte is one coefficient, lossless, as quantisation steps are 1.
"""

from __future__ import annotations

import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

UNIT = 192  # bytes: one 8x8 block of each of three components
WIDEST = 8191  # blocks in a row: a JPEG is at most 65,535 samples wide


@cache
def zigzag() -> np.ndarray:
    """Natural position (8 row + column) of each zigzag index: diagonals in turn, each second one upwards."""
    return np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[sum(x) % 2 == 0 and 1 or 0]))])


@cache
def kernel() -> np.ndarray:
    """Inverse transform of a zigzag coefficient vector to 64 samples, in units of 2^-13. Integers in doubles: sums are exact."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.round(8192 * np.kron(basis, basis))[zigzag()]


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _entropy(bits: np.ndarray) -> bytes:
    raw = bytearray(np.packbits(bits).tobytes())
    if len(bits) % 8:
        raw[-1] |= (1 << (8 - len(bits) % 8)) - 1  # padded with ones
    return bytes(raw).replace(b"\xff", b"\xff\0")


def _bits_of(values: np.ndarray, n: int) -> np.ndarray:
    return ((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8)


def write_bytes(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are ``payload`` (a positive multiple of UNIT bytes).

    A byte b is the DC value +-(512 + b), signs alternating, or the AC value 256 + b, so that first scans (all but the last
    bit) hold no zeros and sizes that, with codes of fitting length, come to a fixed number of bits. Four spectral bands
    and a refinement scan for each follow the DC scans. A comment segment holds the payload's length.
    """
    n = len(payload) // UNIT
    wide = min(n, WIDEST)
    high = -(-n // wide)
    data = np.zeros((wide * high, 3, 64), np.uint8)
    data[:n] = np.frombuffer(payload, np.uint8).reshape(n, 3, 64)
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes(x for c in (1, 2, 3) for x in (c, 0x11, 0))))
    # DC: code 0 and 10 bits, or code 10 and 9 bits (the first of a component). AC: code 0 and 8 bits. Runs of r bits: 4-bit codes.
    out.append(_segment(0xC4, b"\x00" + bytes([1, 1, *[0] * 14]) + bytes([10, 9])))
    out.append(_segment(0xC4, b"\x10" + bytes([1, *[0] * 15]) + bytes([8])))
    out.append(_segment(0xC4, b"\x11" + bytes([0, 0, 0, 15, *[0] * 12]) + bytes(r << 4 for r in range(15))))

    def scan(components: list[int], table: int, band: tuple[int, int], approximation: int, bits: np.ndarray) -> None:
        out.append(_segment(0xDA, bytes([len(components), *[x for c in components for x in (c + 1, table)], *band, approximation])))
        out.append(_entropy(bits))

    sign = np.where(np.arange(len(data)) % 2, -1, 1)[:, None]
    dc = sign * (512 + data[:, :, 0].astype(np.int32))
    diff = np.diff(dc >> 1, axis=0, prepend=0)
    word = np.where(diff > 0, diff, diff + 1023)
    word[0] = (diff[0]) | (2 << 9)  # size 9, code 10
    scan([0, 1, 2], 0, (0, 0), 0x01, _bits_of(word.ravel(), 11).ravel())
    bands = [(0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)]
    for c, lo, hi in bands:
        part = np.ascontiguousarray(data[:, c, lo : hi + 1])
        bits = np.zeros((part.size, 9), np.uint8)
        bits[:, 1:] = np.unpackbits(128 + (part.ravel() >> 1)).reshape(-1, 8)
        scan([c], 0, (lo, hi), 0x01, bits.ravel())
    scan([0, 1, 2], 0, (0, 0), 0x10, (dc & 1).astype(np.uint8).ravel())
    for c, lo, hi in bands:
        last = data[:, c, lo : hi + 1] & 1
        bits = []
        for at in range(0, len(last), 16384):
            run = last[at : at + 16384]
            r = len(run).bit_length() - 1
            bits += [_bits_of(np.array([r]), 4).ravel(), _bits_of(np.array([len(run) - (1 << r)]), r).ravel(), run.ravel()]
        scan([c], 1, (lo, hi), 0x10, np.concatenate(bits))
    return b"".join([*out, b"\xff\xd9"])


# Reading


class _Bits:
    def __init__(self, raw: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(raw.replace(b"\xff\0", b"\xff"), np.uint8)), 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = 2 * v + b
        self.at += n
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = 2 * code + int(self.bits[self.at])
            self.at += 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _table(body: bytes) -> tuple[int, dict[tuple[int, int], int], int]:
    counts, code, k, out = body[1:17], 0, 17, {}
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = body[k]
            code, k = code + 1, k + 1
        code *= 2
    return body[0], out, k


def _strided(bits: np.ndarray, n: int, table: dict[tuple[int, int], int]) -> np.ndarray | None:
    """n values, if all of a table's codes with their extra bits have one length; None if not, or if a run or end code is among them."""
    lengths = {c[0] + s for c, s in table.items()}
    if len(lengths) != 1 or any(s >> 4 or not s for s in table.values()) or len(bits) < n * (stride := lengths.pop()):
        return None
    rows = bits[: n * stride].reshape(n, stride)
    out = np.zeros(n, np.int32)
    if len(table) == 1:
        size = next(iter(table.values()))
        part = rows[:, stride - size :]
        v = np.packbits(part).astype(np.int32) if size == 8 else part.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        return v if part[:, 0].all() else np.where(part[:, 0] == 1, v, v - (1 << size) + 1)
    for (length, code), size in table.items():
        own = np.all(rows[:, :length] == _bits_of(np.array([code]), length), axis=1)
        part = rows[own, stride - size :]
        v = np.packbits(part, axis=None).astype(np.int32) if size == 8 else part.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        out[own] = np.where(part[:, 0] == 1, v, v - (1 << size) + 1)
    return out


class Decoder:
    """coefficients: per component an array [rows, columns, 64] in zigzag order, padded to whole MCUs."""

    def __init__(self, raw: bytes, whole: bool = True) -> None:
        self.whole = whole  # False: always bit by bit
        self.tables: dict[int, dict] = {}
        self.steps: dict[int, np.ndarray] = {}
        self.comments: list[bytes] = []
        self.interval, at, self.components = 0, 2, []
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            marker, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0] if raw[at + 1] != 0xD9 else 0
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xD9:
                break
            if marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.steps[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    key, table, k = _table(body)
                    self.tables[key] = table
                    body = body[k:]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman JPEG")
            elif marker == 0xDA:
                end = re.compile(rb"\xff[^\0\xd0-\xd7\xff]").search(raw, at)
                stop = end.start() if end else len(raw)
                self._scan(body, raw[at:stop])
                at = stop
                if not end:
                    break

    def _frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8:
            raise ValueError("not of 8-bit samples")
        parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        self.sampling = [(p[1] >> 4, p[1] & 15) for p in parts]
        self.most = tuple(max(s[i] for s in self.sampling) for i in (0, 1))
        self.mcus = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        self.components, self.step_of = [p[0] for p in parts], [p[2] for p in parts]
        self.coefficients = [np.zeros((self.mcus[1] * v, self.mcus[0] * h, 64), np.int32) for h, v in self.sampling]

    def _blocks(self, chosen: list[int]) -> list[tuple[int, np.ndarray]]:
        """(component, flat block numbers in scan order with one column per block of an MCU) for each component of a scan."""
        out = []
        for c in chosen:
            h, v = self.sampling[c]
            rows, columns = self.coefficients[c].shape[:2]
            grid = np.arange(rows * columns).reshape(rows, columns)
            if len(chosen) == 1:
                used = -(-self.height * v // (8 * self.most[1])), -(-self.width * h // (8 * self.most[0]))
                out.append((c, grid[: used[0], : used[1]].reshape(-1, 1)))
            else:
                out.append((c, grid.reshape(rows // v, v, columns // h, h).transpose(0, 2, 1, 3).reshape(-1, h * v)))
        return out

    def _scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        chosen = [self.components.index(head[1 + 2 * i]) for i in range(n)]
        lo, hi, approximation = head[1 + 2 * n : 4 + 2 * n]
        before, shift = approximation >> 4, approximation & 15
        own = {c: head[2 + 2 * i] for i, c in enumerate(chosen)}
        blocks = self._blocks(chosen)
        parts = re.split(rb"\xff[\xd0-\xd7]", data) if self.interval else [data]
        for k, part in enumerate(parts):
            some = [(c, b[k * self.interval : (k + 1) * self.interval] if self.interval else b) for c, b in blocks]
            if not len(some[0][1]):
                continue
            bits = _Bits(part)
            if lo == 0:
                self._dc(bits, some, own, before, shift)
            else:
                flat = self.coefficients[chosen[0]].reshape(-1, 64)
                (self._refine if before else self._ac)(bits, flat, some[0][1].ravel(), self.tables[0x10 | own[chosen[0]] & 15], lo, hi, shift)

    def _dc(self, bits: _Bits, some: list, own: dict[int, int], before: int, shift: int) -> None:
        order = np.concatenate([np.full(b.shape[1], i) for i, (_, b) in enumerate(some)])
        n = len(some[0][1])
        tables = [self.tables.get(own[c] >> 4) for c, _ in some]
        if before:
            found = bits.bits[: n * len(order)].reshape(n, -1).astype(np.int32) << shift
        else:
            found = _strided(bits.bits, n * len(order), tables[0]) if self.whole and all(t is tables[0] for t in tables) else None
            if found is None:
                found = np.array([[bits.value(bits.symbol(tables[i])) for i in order] for _ in range(n)], np.int32)
            found = found.reshape(n, -1)
        for i, (c, b) in enumerate(some):
            flat, v = self.coefficients[c].reshape(-1, 64), found[:, order == i].ravel()
            if before:
                flat[b.ravel(), 0] |= v
            else:
                flat[b.ravel(), 0] = np.cumsum(v) << shift

    def _ac(self, bits: _Bits, flat: np.ndarray, blocks: np.ndarray, table: dict, lo: int, hi: int, shift: int) -> None:
        width = hi - lo + 1
        if self.whole and (v := _strided(bits.bits, len(blocks) * width, table)) is not None:
            flat[blocks, lo : hi + 1] = v.reshape(-1, width) << shift
            return
        run = 0
        for b in blocks:
            if run:
                run -= 1
                continue
            k = lo
            while k <= hi:
                s = bits.symbol(table)
                r, size = s >> 4, s & 15
                if size:
                    k += r
                    flat[b, k] = bits.value(size) << shift
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + bits.take(r) - 1
                    break

    def _refine(self, bits: _Bits, flat: np.ndarray, blocks: np.ndarray, table: dict, lo: int, hi: int, shift: int) -> None:
        width, i, run = hi - lo + 1, 0, 0
        one = 1 << shift

        def correct(b: int, k: int) -> None:
            if bits.take(1) and not abs(int(flat[b, k])) & one:
                flat[b, k] += one if flat[b, k] > 0 else -one

        while i < len(blocks):
            b = blocks[i]
            k = lo
            while not run and k <= hi:
                s = bits.symbol(table)
                r, size = s >> 4, s & 15
                if not size and r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                new = (one if bits.take(1) else -one) if size else 0
                while k <= hi:
                    if flat[b, k]:
                        correct(b, k)
                    else:
                        if not r:
                            break
                        r -= 1
                    k += 1
                if new:
                    flat[b, k] = new
                k += 1
            if run and k == lo and self.whole and (flat[(some := blocks[i : i + run]), lo : hi + 1] != 0).all():
                found = bits.bits[bits.at : bits.at + len(some) * width].reshape(-1, width).astype(np.int32)
                bits.at += found.size
                part = flat[some, lo : hi + 1]
                flat[some, lo : hi + 1] = part + np.sign(part) * np.where(np.abs(part) & one, 0, found << shift)
                i += len(some)
                run = 0
                continue
            if run:
                for j in range(k, hi + 1):
                    if flat[b, j]:
                        correct(b, j)
                run -= 1
            i += 1

    def rgb(self) -> np.ndarray:
        """[height, width, 3] unsigned bytes; chroma is upsampled by repetition; one component is grey."""
        planes = []
        for c, (h, v), q in zip(self.coefficients, self.sampling, self.step_of, strict=True):
            rows, columns = c.shape[:2]
            samples = (c.reshape(-1, 64) * self.steps[q]).astype(np.float64) @ kernel()
            samples = np.clip(np.floor(samples / 8192 + 0.5) + 128, 0, 255).astype(np.int32)
            plane = samples.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
            if (up := self.most[1] // v) > 1:
                plane = plane.repeat(up, axis=0)
            if (up := self.most[0] // h) > 1:
                plane = plane.repeat(up, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) < 3:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        # the usual YCbCr factors 1.402, 0.344136, 0.714136 and 1.772 in 2^-16
        r, g, b = y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)
        return np.clip(np.stack([r, g, b], axis=2), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """The bytes that ``write_bytes`` stored."""
        note = next((c for c in self.comments if c.startswith(b"payload ")), None)
        if note is None:
            raise ValueError("no payload")
        flat = np.stack([c.reshape(-1, 64) for c in self.coefficients], axis=1)
        out = np.empty(flat.shape, np.uint8)
        out[:, :, 0] = np.abs(flat[:, :, 0]) - 512
        out[:, :, 1:] = flat[:, :, 1:] - 256
        return out.tobytes()[: int(note[8:])]


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "replace")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_bytes, media): each text's UTF-8 bytes, padded with spaces to a positive multiple of UNIT, as a
    progressive JPEG. A null text is empty. Repeated rows stay repeated; other columns are not read. Narrow."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.Table:
        parts = []
        for k in range(0, batch.num_rows, 256):
            ids, texts = batch.column(0).slice(k, 256), batch.column(1).slice(k, 256).to_pylist()
            n = [len((t or "").encode("utf-8", "replace")) for t in texts]
            parts.append(pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array([write_bytes(padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"]))
        return pa.Table.from_batches(parts)

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_rows(rows, run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def features(rgb: np.ndarray) -> str:
    """Size, mean of each channel and mean horizontal step, in whole hundredths."""
    h, w = rgb.shape[:2]
    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 100 // (h * w)
    step = int(np.abs(np.diff(rgb[:, :, 1].astype(np.int16), axis=1)).sum(dtype=np.int64)) * 100 // (h * w)
    return f"{w}x{h}:{mean[0]}:{mean[1]}:{mean[2]}:{step}"


def load_media(df: DataFrame, keep: list[str], media_col: str = "media", tensors: bool = True) -> DataFrame:
    """``keep`` and payload (null if none is stored), width, height, rgb (row-major tensor, if ``tensors``), feature of each
    JPEG. Null or undecodable media give nulls. A column of ``keep`` called like a result is replaced by it."""
    keep = [c for c in keep if c not in ("payload", "width", "height", "rgb", "feature")]
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(F.col(f"`{media_col}`").alias("media"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)])
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    types = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string())

    def one(raw: bytes | None) -> tuple:
        try:
            d = Decoder(raw or b"")
            rgb = d.rgb()
        except (ValueError, KeyError, IndexError, struct.error):
            return (None,) * 5
        own = d.payload() if any(c.startswith(b"payload ") for c in d.comments) else None
        return own, d.width, d.height, rgb.tobytes() if tensors else None, features(rgb)

    def run(batch: pa.RecordBatch) -> pa.Table:
        parts = []
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            found = list(zip(*[one(x) for x in part.column(0).to_pylist()], strict=True))
            parts.append(pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(c, t) for c, t in zip(found, types, strict=True)]], names=[*names, "payload", "width", "height", "rgb", "feature"]))
        return pa.Table.from_batches(parts)

    out = map_rows(rows, run, ", ".join([*kinds, "payload binary, width int, height int, rgb binary, feature string"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "payload", "width", "height", "rgb", "feature")
