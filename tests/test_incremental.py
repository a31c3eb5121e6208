"""Bucketed tables and the batch lifecycle: replays, touched buckets, streams against batch queries."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from citelens.sources import buckets as B
from citelens.streaming.lifecycle import lifecycle, lifecycle_stream

ROWS = "k string, v int, x string"


def stamps(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("__bucket")}


def test_upsert_rewrites_touched_buckets_only(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(f"k{i}", 1, "a") for i in range(60)] + [(None, 1, "none")], ROWS)
    assert B.upsert_buckets(first, path, ["k"], "v", 0, buckets=8) == 8
    before = stamps(path)
    second = spark.createDataFrame([("k3", 2, "b"), ("k3", 1, "late"), (None, 0, "old"), ("k4", 1, "tie")], ROWS)
    touched = B.upsert_buckets(second, path, ["k"], "v", 1, buckets=8)
    after = stamps(path)
    assert touched == sum(before[b] != after[b] for b in before) < 8
    want = sorted([(f"k{i}", 1, "a") for i in range(60) if i not in (3, 4)] + [("k3", 2, "b"), ("k4", 1, "tie"), (None, 1, "none")], key=str)
    assert rows(B.read_buckets(spark, path, ROWS)) == want
    B.upsert_buckets(second, path, ["k"], "v", 1, buckets=8)  # a replay
    assert rows(B.read_buckets(spark, path, ROWS)) == want
    assert B.upsert_buckets(second.limit(0), path, ["k"], "v", 2, buckets=8) == 0
    assert B.read_buckets(spark, str(tmp_path / "nothing"), ROWS).count() == 0


def test_append_numbers_on_and_replays_change_nothing(spark, rows, tmp_path):
    path, kind = str(tmp_path / "t"), "bibcode string, run int, x string"
    one = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c")], kind)
    two = spark.createDataFrame([("p", 0, "d"), ("r", 0, "e")], kind)
    for batch, df in ((0, one), (1, two), (1, two), (1, two)):
        B.append_buckets(df, path, "bibcode", "run", batch, 4)
    assert rows(B.read_buckets(spark, path, kind)) == [("p", 0, "a"), ("p", 1, "b"), ("p", 2, "d"), ("q", 0, "c"), ("r", 0, "e")]
    for _ in range(2):
        B.append_buckets(two, path, "bibcode", "run", 2, 4, replace=True)
    assert rows(B.read_buckets(spark, path, kind)) == [("p", 0, "d"), ("q", 0, "c"), ("r", 0, "e")]


def test_streams_equal_a_batch_query(spark, rows, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "t")
    data = [(f"k{i % 7}", (i * 5) % 23, f"x{i}") for i in range(40)]
    df = spark.createDataFrame(data, ROWS)
    for part in range(4):
        df.where(F.expr(f"cast(substr(x, 2) as int) % 4 = {part}")).coalesce(1).write.mode("append").parquet(str(source))
        B.upsert_stream(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(source)), path, ["k"], "v", str(tmp_path / "cp"), 4).awaitTermination()
    best = df.groupBy("k").agg(F.max("v").alias("v"))
    assert rows(B.read_buckets(spark, path, ROWS).select("k", "v")) == rows(best)
    runs = str(tmp_path / "r")
    B.append_stream(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(source)), runs, "k", "v", str(tmp_path / "cp2"), 4).awaitTermination()
    assert B.read_buckets(spark, runs, ROWS).count() == 40


T0 = dt.datetime(2025, 1, 1)
EVENTS = "batch_id string, ts timestamp, status string"


def events():
    at = lambda h: T0 + dt.timedelta(hours=h)
    return [
        ("a", at(0), "submitted"), ("a", at(2), "completed"), ("a", at(3), "failed"), ("b", at(1), "submitted"), ("b", at(30), "completed"), ("c", at(5), "in_progress"), ("c", at(29), "failed"), ("d", at(2), "failed"), ("d", at(2), "cancelled"),
        ("e", at(60), "submitted"), (None, at(1), "completed"), ("f", None, "completed"), ("g", at(70), "submitted"), ("g", at(71), "completed"),
    ]


def test_lifecycle(spark):
    got = {r.batch_id: (r.status, r.ended and (r.ended - T0).total_seconds() / 3600) for r in lifecycle(spark.createDataFrame(events(), EVENTS)).collect()}
    assert got == {"a": ("completed", 2), "b": ("expired", 25), "c": ("failed", 29), "d": ("cancelled", 2), "e": ("open", None), "g": ("completed", 71)}
    early = {r.batch_id: r.status for r in lifecycle(spark.createDataFrame(events(), EVENTS), F.lit(T0 + dt.timedelta(hours=20))).collect()}
    assert early["b"] == "open" and early["c"] == "open" and early["a"] == "completed"
    assert lifecycle(spark.createDataFrame([], EVENTS)).count() == 0


@pytest.mark.parametrize("cut", [[0, 14], [0, 3, 6, 9, 14]])
def test_lifecycle_stream_equals_the_batch_query(spark, rows, tmp_path, cut):
    """However the events are cut into batches, and in any order within the watermark."""
    source = str(tmp_path / "in")
    order = sorted(events(), key=lambda e: (e[1] is None, e[1] or T0))
    order = [x for i in range(0, 14, 2) for x in reversed(order[i : i + 2])]
    last = ("z", T0 + dt.timedelta(hours=200), "submitted")
    name = f"life{len(cut)}"
    spark.createDataFrame(order[:0], EVENTS).write.parquet(source)
    query = lifecycle_stream(spark.readStream.schema(EVENTS).parquet(source), "10 hours").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for part in [order[a:b] for a, b in zip(cut, cut[1:], strict=False)] + [[last], [("z", T0 + dt.timedelta(hours=201), "in_progress")]]:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    query.stop()
    want = lifecycle(spark.createDataFrame(order, EVENTS), F.lit(T0 + dt.timedelta(hours=200)))
    assert rows(spark.table(name)) == rows(want)
