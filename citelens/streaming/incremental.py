"""Incremental variants of batch steps as Structured Streaming (an extension). Tables kept by a stream are in ``sources.buckets``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_tokens(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, n, tokens) of a stream of submissions (ts timestamp, tokens), final once the watermark passes the day."""
    per = log.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return per.select(F.to_date("window.start").alias("day"), "n", "tokens")


def tally_stream(calls: DataFrame, accept: float, inspect: float) -> DataFrame:
    """Running counts per (mission, papertype) of a stream of calls: total, accepted, to inspect (complete or update mode)."""
    best = F.greatest("conf_science", "conf_mention")
    return calls.groupBy(F.lower("mission").alias("mission"), F.lower("papertype").alias("papertype")).agg(
        F.count("*").alias("total_count"), F.count_if(best >= accept).alias("accepted_count"), F.count_if((best >= inspect) & (best < accept)).alias("inspection_count"))
