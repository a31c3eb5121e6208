"""Order without one task: rows are cut into ranges of a numeric column, work happens per range, and only the ranges meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 200


def range_of(df: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """The number of a row's range, by approximate quantiles of the column (numeric; at most ``ranges`` of them reach the
    driver), so that sparse or clustered values still spread. Equal values share a range."""
    found = df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    cuts = sorted(set(found))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(column))) if cuts else F.lit(0)


def starts(rows: DataFrame, block: str, amounts: dict[str, Column], descending: bool = False) -> DataFrame:
    """(block, one column per amount): what the blocks before each one sum to. One row per block meets in one task."""
    sums = rows.groupBy(block).agg(*[a.alias(f"__{k}") for k, a in amounts.items()])
    before = W.orderBy(F.desc(block) if descending else F.col(block)).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(block, *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(k) for k in amounts])
