"""Source order and JSON arrays by ranges of bytes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from citelens.sources import order as O

KIND = "k int, t string, n array<struct<a:string,b:array<int>>>"


def objects(n):
    rnd = random.Random(n)
    odd = ['a "quoted" } brace', "back\\slash\\", "[{", "}\n{", " é}", "", '\\"}', "x" * 300]
    return [{"k": i, "t": rnd.choice(odd) + rnd.choice(odd), "n": [{"a": rnd.choice(odd), "b": [1] * rnd.randint(0, 3)} for _ in range(rnd.randint(0, 3))]} for i in range(n)]


@pytest.mark.parametrize(("indent", "n"), [(None, 400), (2, 400), (None, 1), (2, 0)])
def test_json_arrays_are_read_by_many_tasks(spark, tmp_path, indent, n):
    rows = objects(n)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text("\n [" + json.dumps({"k": -1, "t": None, "n": None}) + " ] \n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = O.read_json_array(spark, str(tmp_path), KIND)
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
        found = sorted(got.collect(), key=lambda r: r.k)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    plain = sorted(spark.read.schema(KIND).option("multiLine", True).json(str(tmp_path)).collect(), key=lambda r: r.k)
    assert [(r.k, r.t, r.n) for r in found] == [(r.k, r.t, r.n) for r in plain] and all(r._corrupt_record is None for r in found)
    assert len(found) == n + 1 and (n < 400 or tasks > 20)


def test_numbers_follow_the_files(spark, rows, tmp_path):
    data = [(i, f"b{i % 7}") for i in range(500)]
    for k, part in enumerate((data[:120], data[120:121], data[121:])):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"v": v, "bibcode": b}) for v, b in part))
        spark.createDataFrame(part, "v long, bibcode string").coalesce(1).write.parquet(str(tmp_path / "pq" / f"{k}"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        read = O.numbered(spark.read.schema("v long, bibcode string").json(str(tmp_path / "*.json")))
        assert rows(read.select("v", "ord")) == rows(spark.createDataFrame([(v, v) for v, _ in data], "v long, ord long"))
        assert sorted((r.bibcode, r.v) for r in O.first_by(read.repartition(5), ["bibcode"]).collect()) == [(f"b{i}", i) for i in range(7)]
        assert [r.v for r in read.where("ord = 121").collect()] == [121]
        assert O.numbered(spark.read.parquet(str(tmp_path / "pq" / "*"))).where("v <> ord").count() == 0
        assert O.numbered(spark.read.schema("v long").json(str(tmp_path / "0.json")).where("v < 0")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
