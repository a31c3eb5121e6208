"""Shared helpers: tables, Arrow mapping; the shared folder for intermediate results is ``sources.stage``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import discard, forget, materialise, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..sources.files import spread  # not in the workers, which import this module too

    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def map_rows(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs run within send at most so many rows to Python at once: for rows of many kilobytes, of which a default batch of
    10,000 would be held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc32_of(col) -> F.Column:
    """crc32 of a value's text."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary"))
