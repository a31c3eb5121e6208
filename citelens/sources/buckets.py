"""A keyed table in hash buckets: a batch rewrites the buckets its keys fall into and reads no others.

A bucket is a folder, so old rows are found by partition pruning and replaced by dynamic partition overwrite. Every row
carries the batch it came with. A batch that is written again first takes its own rows out, so replays after a lost driver or
executor change nothing, also where rows are appended. One writer at a time, with batch numbers that grow; which buckets a
batch touches is counted, at most ``buckets`` numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str, schema: StructType | str, batches: bool = False) -> DataFrame:
    """The table's rows; none if nothing was written. With ``batches`` also the columns __batch and __bucket."""
    kind = spark.createDataFrame([], schema).schema
    stored = StructType([*kind.fields]).add("__batch", "long").add("__bucket", "integer")
    try:
        found = spark.read.schema(stored).parquet(path)
    except AnalysisException:
        found = spark.createDataFrame([], stored)
    return found if batches else found.select(kind.names)


def _write(new: DataFrame, path: str, keys: list[str], batch: int, buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Rewrites the buckets that ``new`` touches as ``merge`` (old rows, new rows) of them; returns their number."""
    staged = new.withColumn("__batch", F.lit(batch).cast("long")).withColumn("__bucket", bucket_of(keys, buckets))
    touched = [r[0] for r in staged.select("__bucket").distinct().collect()]
    if not touched:
        return 0
    old = read_buckets(new.sparkSession, path, new.schema, batches=True).where(F.col("__bucket").isin(touched) & (F.col("__batch") != batch))
    merged = merge(old, staged).repartition("__bucket")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(path)
    return len(touched)


def upsert_buckets(new: DataFrame, path: str, keys: list[str], version: str, batch: int, buckets: int = BUCKETS) -> int:
    """Of rows with equal keys the one of the greatest ``version`` stays, of equal versions that of the later batch (null keys are
    equal, a null version is the least). Returns how many buckets were rewritten. ``new`` is read twice. A replay of a batch that
    is not the last leaves rows that a later batch has replaced as they are."""
    def merge(old: DataFrame, staged: DataFrame) -> DataFrame:
        both = old.unionByName(staged)
        rest = [c for c in both.columns if c not in (*keys, "__bucket")]
        best = both.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(*rest), F.struct(F.col(version).alias("v"), F.col("__batch").alias("b"), F.xxhash64(*rest).alias("h"))).alias("r"))
        return best.select(*keys, "r.*", "__bucket").select(both.columns)

    return _write(new, path, keys, batch, buckets, merge)


def append_buckets(new: DataFrame, path: str, key: str, number: str, batch: int, buckets: int = BUCKETS, replace: bool = False) -> int:
    """Appends rows, numbering them on: a row's ``number`` is raised by what its key has already, of earlier batches. With
    ``replace`` the new rows of a key take the place of its old ones. Returns how many buckets were rewritten."""
    def merge(old: DataFrame, staged: DataFrame) -> DataFrame:
        if replace:
            return old.join(staged.select(key).distinct(), key, "left_anti").select(staged.columns).unionByName(staged)
        last = old.where(F.col("__batch") < batch).groupBy(key).agg((F.max(number) + 1).alias("__n"))
        moved = staged.join(last, key, "left").withColumn(number, (F.col(number) + F.coalesce("__n", F.lit(0))).cast(staged.schema[number].dataType))
        return old.unionByName(moved.select(old.columns))

    return _write(new, path, [key], batch, buckets, merge)


def upsert_stream(rows: DataFrame, path: str, keys: list[str], version: str, checkpoint: str, buckets: int = BUCKETS, available: bool = True) -> StreamingQuery:
    """``upsert_buckets`` of a stream's batches, by their numbers. ``available``: stops after what there is."""
    return _stream(rows, checkpoint, available, lambda batch, n: upsert_buckets(batch, path, keys, version, n, buckets))


def append_stream(rows: DataFrame, path: str, key: str, number: str, checkpoint: str, buckets: int = BUCKETS, replace: bool = False, available: bool = True) -> StreamingQuery:
    """``append_buckets`` of a stream's batches."""
    return _stream(rows, checkpoint, available, lambda batch, n: append_buckets(batch, path, key, number, n, buckets, replace))


def _stream(rows: DataFrame, checkpoint: str, available: bool, step: Callable[[DataFrame, int], int]) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(lambda batch, n: step(batch, n) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()
