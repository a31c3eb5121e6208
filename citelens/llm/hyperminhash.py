"""Near-duplicate documents by HyperMinHash signatures, confirmed on full sets.

A signature has a register per bucket. A bucket has a hash function of its own (rather than a share of one function's values,
which would leave most buckets of a short text empty); its register keeps of the least hash of the set the number of leading
zeros and the MANTISSA bits after the first one, 16 bits in place of 64.

1. Equal sets of shingles are one node, with one signature.
2. ROWS registers of a signature are a band. Nodes that agree in a band form a group. Two sets of Jaccard similarity s agree in
   some band with probability 1 - (1 - s^ROWS)^BANDS: a pair at 0.85 is missed once in 50 million, and a chain of links
   survives a missed pair where another joins its ends.
3. In the tiles of a group, the share of equal registers, less those expected to be equal by collision of truncated values,
   estimates the similarity. Pairs estimated more than SLACK standard errors below the bound are dropped; a forest over the
   rest leaves the tile.
4. What remains is confirmed on the sorted arrays of full sets, by the tiles, clusters and components of the n-gram Jaccard join.
   Groups and clusters beyond a tile are settled in parts and then by pairs of blocks, so none is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .jaccard import TILE, Shingler, Tile, least_ids, nodes_of, settled, united

BANDS = 24
ROWS = 4
MANTISSA = 10
SLACK = 6.0
CHUNK = 1 << 16  # shingles hashed at once


class Registers:
    """Signatures of sets of 64-bit hashes."""

    def __init__(self, buckets: int, mantissa: int = MANTISSA) -> None:
        rng = np.random.default_rng(13)
        self.factors = rng.integers(0, 1 << 63, (buckets, 1), np.uint64) << np.uint64(1) | np.uint64(1)
        self.terms = rng.integers(0, 1 << 63, (buckets, 1), np.uint64) << np.uint64(1)
        self.mantissa = mantissa

    def __call__(self, h: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        step = max(1, CHUNK // len(self.factors))
        for at in range(0, len(h), step):
            least = np.minimum(least, (self.factors * h[at : at + step] + self.terms).min(1))
        # As a double, the value's exponent tells its leading zeros and the mantissa starts after its first one.
        bits = (least >> np.uint64(11)).astype(np.float64).view(np.uint64) >> np.uint64(52 - self.mantissa)
        return bits.astype(np.uint16)  # the exponent's low six bits suffice: hashes have 53 bits here


def collisions(n: np.ndarray | int, m: np.ndarray | int, mantissa: int = MANTISSA) -> np.ndarray:
    """The probability that disjoint sets of ``n`` and ``m`` elements have equal registers: over all values of a register, the
    product of the probabilities that each set's least hash falls into that value's interval.

    With z leading zeros, intervals are 2^-(z + 1 + mantissa) wide, and minima near x have densities n (1 - x)^(n - 1)."""
    n, m = np.asarray(n, np.float64)[..., None, None], np.asarray(m, np.float64)[..., None, None]
    z = np.arange(53)[:, None]
    x = 2.0 ** -(z + 1) * (1 + (np.arange(16) + 0.5) / 16)  # sixteen points for each number of zeros, on which densities hardly vary
    density = n * m * np.exp((n + m - 2) * np.log1p(-x))
    return (density * 2.0 ** -(z + 1 + mantissa) * 2.0 ** -(z + 1) / 16).sum((-1, -2))


class EstimatedTile(Tile):
    """A tile whose pairs are told by their registers."""

    def _prepare(self) -> None:
        self.registers = np.frombuffer(b"".join(self.bits), np.uint16).reshape(len(self.f), -1)
        bound = self.percent / 100
        self.least = bound - SLACK * np.sqrt(bound * (1 - bound) / self.registers.shape[1])

    def _allowed(self, i: int, at: np.ndarray) -> np.ndarray:
        equal = (self.registers[at] == self.registers[i]).mean(1)
        chance = collisions(self.n[i], self.n[i])  # sizes within the band differ too little to change it
        return at[(equal - chance) / (1 - chance) >= self.least]


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc, t, f, n, bits): t is a hash of the text, f identifies the set (null if empty); bits holds the registers, and is empty
    on a set that its task met before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, registers, seen, met = Shingler(n), Registers(bands * rows), set(), {}
        for b in batches:
            out = []
            for key, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key in met:
                    out.append((*met[key], b""))
                    continue
                h = shingles(text)
                f = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None
                met[key] = f, len(h)
                new = f is not None and f not in seen
                if new:
                    seen.add(f)
                out.append((f, len(h), registers(h).tobytes() if new else b""))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc", "t", "f", "n", "bits"])

    return docs.select("doc", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc long, t long, f long, n long, bits binary")


def _groups(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(least, fs, big): nodes that agree in a band, in parts of about TILE nodes; ``big`` is the band's value where there are
    several. Members are counted first, by partial sums, so that no task holds a group beyond a part."""
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("bits", i * 2 * rows + 1, F.lit(2 * rows))))
    each = nodes.select("f", F.explode(band).alias("g"))
    sizes = each.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    part = F.when(F.col("size") > TILE, F.pmod(F.xxhash64("f", "g"), F.ceil(F.col("size") / TILE)))
    members = each.join(sizes, "g").select("g", part.alias("part"), "f").repartition("g", "part")
    groups = members.groupBy("g", "part").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return groups.select(F.col("fs")[0].alias("least"), "fs", F.when(F.col("part").isNotNull(), F.col("g")).alias("big"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(``id_col``, n_shingles, component_id, kept) of every row: the size of its set of n-word shingles, the least id reachable
    by links 100 |A n B| >= percent |A u B|, itself included, and whether that is its own.

    A null, empty or blank text has an empty set and links with nothing. Each row is a document of its own: rows stay repeated,
    links join rows, and of equal rows with one id all or none are kept. A null id stays out of the components' least ids;
    such a row is kept if no other id stands for its component. Other columns are not read. Ids are longs."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = materialise(_signed(docs, n, bands, rows), "signed")
    nodes = nodes_of(sets)
    groups = materialise(united(_groups(nodes, bands, rows)), "groups")
    labels = settled(groups, nodes, docs, n, percent, EstimatedTile)
    out = least_ids(sets, labels).withColumn("kept", F.col("doc").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("doc", id_col)
