"""Rows in the order of their source, and large JSON arrays read by ranges of bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FILE, _BLOCK = "_metadata.file_path", "_metadata.file_block_start"


def numbered(rows: DataFrame, name: str = "ord") -> DataFrame:
    """Adds each row's number from 0 in its source: files by name, within a file the order it has there. ``rows`` comes straight from
    a file reader. Rows are counted per range of a file that one task reads, and these counts (a row per range, no more) are
    added up before it; nothing is shuffled. Tasks must read the same ranges again, as they do for unchanged files."""
    # The id rises along the rows of a task; a task reads its ranges one after the other.
    placed = rows.withColumns({"__file": F.col(_FILE), "__at": F.col(_BLOCK), "__id": F.monotonically_increasing_id()})
    ranges = placed.groupBy("__file", "__at").agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
    before = W.orderBy("__file", "__at").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("__file", "__at", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(starts), ["__file", "__at"]).withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).drop("__file", "__at", "__id", "__first", "__before")


def first_by(rows: DataFrame, keys: list[str], order: Column | str = "ord") -> DataFrame:
    """Of rows with equal keys the first one by ``order``; partial per task, whatever the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


_ESCAPED = re.compile(r"\\.", re.S)


def _marks(piece: str, inside: bool) -> tuple[int, bool]:
    """(depth gained, whether a string is open at the end) of a piece that starts within a string or not; the closing brace after
    the piece counts if it is outside one."""
    parts = _ESCAPED.sub("", piece).split('"')
    out = parts[1 if inside else 0 :: 2]
    open_ = inside ^ (len(parts) % 2 == 0)
    return sum(p.count("{") + p.count("[") - p.count("]") for p in out) - (not open_), open_


def json_array_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the top-level objects of files that hold one JSON array each, whatever their layout, as texts.

    Files are read as pieces that end at closing braces, so any number of tasks read ranges of one file. Whether a brace is
    within a string, and how deep it is, depends on all that comes before: a first pass sums up each range for both cases (what
    it does to an open string and to the depth), these sums are chained in order (a row per range), and a second pass cuts at
    the braces that end an object of the array. What is cut off at a range's ends, at most two pieces a range, is joined."""
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col(_FILE).alias("file"), F.col(_BLOCK).alias("at"), "value")

    def runs(b: pa.RecordBatch) -> Iterator[tuple[str, int, list[str]]]:
        files, ats, values = (c.to_pylist() for c in b.columns)
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or (files[i], ats[i]) != (files[start], ats[start]):
                yield files[start], ats[start], values[start:i]
                start = i

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for b in batches:
            for file, at, values in runs(b):
                s = found.setdefault((file, at), [0, False, 0, True])
                for v in values:
                    gained, s[1] = _marks(v, s[1])
                    s[0] += gained
                    gained, s[3] = _marks(v, s[3])
                    s[2] += gained
        rows = [(*k, *v) for k, v in found.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "at", "d0", "s0", "d1", "s1"])

    starts: dict[tuple[str, int], tuple[int, bool]] = {}
    last, depth, inside = None, 0, False
    for r in pieces.mapInArrow(summed, "file string, at long, d0 long, s0 boolean, d1 long, s1 boolean").orderBy("file", "at").toLocalIterator():
        if r.file != last:
            last, depth, inside = r.file, 0, False
        starts[r.file, r["at"]] = depth, inside
        depth, inside = (depth + r.d1, r.s1) if inside else (depth + r.d0, r.s0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, depth, inside, met = None, [], 0, False, False
        out: list[tuple] = []
        for b in batches:
            for file, at, values in runs(b):
                if (file, at) != now:
                    if held:
                        out.append((*now, 1, True, "".join(held)))
                    now, held, met = (file, at), [], False
                    depth, inside = starts[now]
                for v in values:
                    gained, inside = _marks(v, inside)
                    depth += gained
                    held.append(v + "}")
                    if depth == 1 and not inside:  # the end of an object of the array
                        out.append((*now, 0, not met, "".join(held)))
                        held, met = [], True
            yield _fragments(out)
            out = []
        yield _fragments([(*now, 1, True, "".join(held))] if held else [])

    parts = pieces.mapInArrow(cut, "file string, at long, place int, edge boolean, value string")
    edges = parts.where("edge")
    # An object that ranges share: the rest of one range, whole ranges without an end, the first end.
    order = W.partitionBy("file").orderBy("at", "place")
    ends = F.coalesce(F.sum(F.when(F.col("place") == 0, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = edges.withColumn("o", ends).groupBy("file", "o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "place", "value"))), lambda x: x["value"]), "").alias("value"))
    both = parts.where("NOT edge").select("file", "value").unionByName(whole.select("file", "value"))
    return both.select("file", F.regexp_replace("value", r"^[\s,\[]*", "").alias("value")).where(F.col("value").startswith("{"))


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "at", "place", "edge", "value"])


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of large JSON arrays by a schema; those that do not parse keep their text in _corrupt_record."""
    bad = {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}
    return json_array_texts(spark, path).select(F.from_json("value", f"{schema}, _corrupt_record string", bad).alias("r")).select("r.*")
