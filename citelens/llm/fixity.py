"""WARC records and a Merkle fixity audit of replicas, in DataFrame operations.

A replica is a table (archive, offset, length, record). Records are hashed with their place; the hashes of a range of
``RANGE`` bytes, in order of offset, make a leaf, and 16 nodes in order make one of the next level, up to one root per
archive. Two replicas are compared root by root, then level by level under mismatching nodes only, down to the records.
Ranges bound every group: a node has 16 children at most, a leaf the records that start in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

RANGE = 65_536
FAN = 16


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """A WARC 1.1 resource record as bytes; a null url or payload is empty."""
    body = F.encode(F.coalesce(payload, F.lit("")), "utf-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8"))


def archive_pages(pages: DataFrame, per_archive: int = 250) -> DataFrame:
    """(archive, offset, length, page_id, record): pages in archives of ``per_archive`` consecutive ids, records at
    ascending offsets by page_id, then record. Records without an id are dealt by their hash to archives -1 to -4096."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    own = F.coalesce(F.floor(F.col("page_id") / per_archive), -1 - F.pmod(F.xxhash64("record"), F.lit(4096)))
    rows = pages.select("page_id", record.alias("record")).select(own.cast("long").alias("archive"), "page_id", "record")
    rows = rows.withColumn("length", F.octet_length("record").cast("long"))
    before = W.partitionBy("archive").orderBy("page_id", "record").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("archive", "offset", "length", "page_id", "record")


def record_hashes(replica: DataFrame) -> DataFrame:
    """(archive, offset, length, h): each record's hash over its place and bytes. A null record has a hash of its own."""
    place = F.encode(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.when(F.col("record").isNull(), "null").otherwise("")), "utf-8")
    return replica.select("archive", "offset", "length", F.sha2(F.concat(place, F.coalesce("record", F.lit(b""))), 256).alias("h"))


def _leaves(hashes: DataFrame) -> DataFrame:
    """Equal rows are counted first, so that a leaf holds no more than its range's different records."""
    hashes = hashes.groupBy("archive", "offset", "length", "h").agg(F.count("*").alias("copies"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "h", "copies"))), lambda r: F.concat(r["h"], F.lit("x"), r["copies"].cast("string"))), ",")
    return hashes.groupBy("archive", F.floor(F.col("offset") / RANGE).alias("node")).agg(F.sha2(joined.cast("binary"), 256).alias("h"))


def _parents(nodes: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "h"))), lambda r: F.concat(r["node"].cast("string"), F.lit(":"), r["h"])), ",")
    return nodes.groupBy("archive", F.floor(F.col("node") / FAN).alias("node")).agg(F.sha2(joined.cast("binary"), 256).alias("h"))


def merkle_tree(hashes: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (archive, node, h) of each level, leaves first; the last level is the roots (node 0)."""
    out = [materialise(_leaves(hashes), "leaves")]
    for _ in range(levels):
        out.append(materialise(_parents(out[-1]), "nodes"))
    return out


def _mismatches(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    a, b = a.withColumnRenamed("h", "ha"), b.withColumnRenamed("h", "hb")
    return a.join(b, keys, "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, offset, length, status) of every record by which replica ``b`` differs from ``a``: "corrupt" (same place,
    other bytes), "missing" (only in a) or "extra" (only in b).

    Archives or ranges that only one replica has mismatch from the root down. Records that repeat a place and bytes within
    one replica count once at the record level. Null archives are one archive; null offsets or lengths count as 0. Empty
    tables compare as empty. Other columns are not read. One scan of each replica hashes it; the descent reads only hashes.
    """
    filled = lambda r: r.select(F.coalesce(F.col("archive").cast("long"), F.lit(-1)).alias("archive"), F.coalesce(F.col("offset").cast("long"), F.lit(0)).alias("offset"), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"), "record")
    hashes = [materialise(record_hashes(filled(r)), "records") for r in (a, b)]
    last = max(h.agg(F.max("offset")).first()[0] or 0 for h in hashes)
    levels, span = 0, RANGE
    while span <= last:
        span, levels = span * FAN, levels + 1
    trees = [merkle_tree(h, levels) for h in hashes]
    wrong = _mismatches(trees[0][-1], trees[1][-1], ["archive", "node"]).select("archive", "node")
    for level in range(levels - 1, -1, -1):
        under = [t[level].withColumn("up", F.floor(F.col("node") / FAN)).join(wrong.withColumnRenamed("node", "up"), ["archive", "up"], "left_semi").drop("up") for t in trees]
        wrong = _mismatches(*under, ["archive", "node"]).select("archive", "node")
    records = [h.withColumn("node", F.floor(F.col("offset") / RANGE)).join(wrong, ["archive", "node"], "left_semi").drop("node").distinct() for h in hashes]
    found = _mismatches(*records, ["archive", "offset", "length"])
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("corrupt")
    return found.select("archive", "offset", "length", status.alias("status")).distinct()
