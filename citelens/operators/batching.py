"""Batch planning under limits of lines, bytes and tokens; the submission log."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import range_of, starts

MAX_LINES, MAX_BYTES, MAX_TOKENS = 50_000, 200 * 1024 * 1024, 40_000_000


def token_estimate(line: Column) -> Column:
    """Words of a line, at least one."""
    return F.greatest(F.lit(1), F.size(F.split(F.trim(line), r"\s+"))).cast("long")


def token_count(line: Column, encode: Callable[[str], list[int]] | None = None) -> Column:
    """Tokens of a line by a tokenizer's ``encode``, run in Arrow batches; without one, its words."""
    if encode is None:
        return token_estimate(line)

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(encode(t or "")))

    return run(line)


def file_statistics(lines: DataFrame, sample: int | None = None, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """One row: n_lines, n_bytes, avg_tokens of the first ``sample`` lines by ord (default: all), total_tokens (truncated).
    Tokens are ``encode``'s, or words."""
    all_ = lines.agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("n_bytes"))
    some = lines.orderBy("ord").limit(sample) if sample else lines
    avg = some.agg(F.coalesce(F.avg(token_count(F.col("line"), encode)), F.lit(0.0)).alias("avg_tokens"))
    return all_.join(F.broadcast(avg)).withColumn("total_tokens", (F.col("avg_tokens") * F.col("n_lines")).cast("long"))  # one row each


def chunk_plan(stats: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds base_chunks, lines_per_chunk, tokens_per_chunk, chunks_per_day, days."""
    up = lambda a, b: F.ceil(F.col(a) / F.lit(b))
    out = stats.withColumn("base_chunks", F.greatest(up("n_lines", max_lines), up("n_bytes", max_bytes), up("total_tokens", max_tokens), F.lit(1)))
    out = out.withColumns({"lines_per_chunk": F.ceil(F.col("n_lines") / F.col("base_chunks")), "tokens_per_chunk": F.ceil(F.col("total_tokens") / F.col("base_chunks"))})
    per_day = F.greatest(F.lit(1), F.least(F.col("base_chunks"), F.expr(f"{max_tokens}L DIV greatest(1L, tokens_per_chunk)")))
    return out.withColumn("chunks_per_day", per_day).withColumn("days", F.greatest(F.lit(1), F.ceil(F.col("base_chunks") / F.col("chunks_per_day"))))


def ordinals(lines: DataFrame) -> DataFrame:
    """Adds a global number from 0 in the order of ord: ranges of ord are counted, then numbered within."""
    keyed = lines.withColumn("__b", range_of(lines, "ord"))
    return keyed.join(F.broadcast(starts(keyed, "__b", {"__s": F.count("*")})), "__b").withColumn("number", F.col("__s") + F.row_number().over(W.partitionBy("__b").orderBy("ord")) - 1).drop("__b", "__s")


def assign_chunks(lines: DataFrame, lines_per_chunk: int, chunks_per_day: int) -> DataFrame:
    """Adds chunk (from 1) and day (from 1)."""
    return ordinals(lines).withColumn("chunk", F.expr(f"number DIV {lines_per_chunk} + 1")).withColumn("day", F.expr(f"(chunk - 1) DIV {chunks_per_day} + 1"))


def within_limits(stats: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Whether a file may be submitted as it is: strictly below both limits."""
    return stats.select("*", ((F.col("n_lines") < max_lines) & (F.col("n_bytes") < max_bytes)).alias("ok"))


def daily_quota(log: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(day, n, tokens, tokens_left, campaign_day) of a log (ts, tokens); days count from the first submission."""
    per = log.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    first = log.agg(F.to_date(F.min("ts")).alias("first"))
    return per.join(F.broadcast(first)).select("day", "n", "tokens", F.greatest(F.lit(0), F.lit(max_tokens) - F.col("tokens")).alias("tokens_left"), (F.date_diff("day", "first") + 1).alias("campaign_day"))


def pending(chunks: DataFrame, log: DataFrame, chunks_per_day: int) -> DataFrame:
    """The next chunks to send: not in the log, the first by number."""
    return chunks.join(log.select("chunk").distinct(), "chunk", "left_anti").orderBy("chunk").limit(chunks_per_day)


def submission_status(chunks: DataFrame, log: DataFrame, today: Column | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row: total, submitted and remaining chunks; with a date, also chunks and tokens submitted on it and tokens left."""
    sent = log.select("chunk").distinct().withColumn("sent", F.lit(True))
    out = chunks.join(sent, "chunk", "left").agg(F.count("*").alias("total"), F.count("sent").alias("submitted"), (F.count("*") - F.count("sent")).alias("remaining"))
    if today is None:
        return out
    own = log.where(F.to_date("ts") == today).agg(F.count("*").alias("submitted_today"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_today"))
    return out.join(F.broadcast(own)).withColumn("tokens_left", F.greatest(F.lit(0), F.lit(max_tokens) - F.col("tokens_today")))  # one row each


def submission_gate(chunks: DataFrame, log: DataFrame, today: Column, chunks_per_day: int, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(chunk, tokens, running, send): the chunks (chunk, tokens) that are next, with the tokens that they would add up to on
    that day, and whether each may still go. A dry run: nothing is sent. Only as many chunks as a day allows meet."""
    spent = log.where(F.to_date("ts") == today).agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("spent"))
    order = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    next_ = pending(chunks, log, chunks_per_day).join(F.broadcast(spent))  # one row
    running = F.col("spent") + F.sum("tokens").over(order)
    return next_.select("chunk", "tokens", running.alias("running"), ((running <= max_tokens) & (F.col("n") + F.count("*").over(order) <= chunks_per_day)).alias("send"))


def verify_chunks(lines: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(chunk, n_lines, n_bytes, tokens, ok) of chunked lines (chunk, line): whether each chunk keeps to the limits."""
    per = lines.groupBy("chunk").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line") + 1).alias("n_bytes"), F.sum(token_estimate(F.col("line"))).alias("tokens"))
    return per.withColumn("ok", (F.col("n_lines") <= max_lines) & (F.col("n_bytes") <= max_bytes) & (F.col("tokens") <= max_tokens))


def chunking_needed(stats: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row: whether a file must be cut, and by which of the limits."""
    over = {"lines": F.col("n_lines") >= max_lines, "bytes": F.col("n_bytes") >= max_bytes, "tokens": F.col("total_tokens") >= max_tokens}
    reasons = F.array_compact(F.array(*[F.when(c, k) for k, c in over.items()]))
    return stats.select("n_lines", "n_bytes", "total_tokens", (F.size(reasons) > 0).alias("needed"), F.array_join(reasons, ",").alias("reasons"))


def check_model(lines: DataFrame, model: str) -> DataFrame:
    """(model, n, ok): the models that request lines name, and whether each is the one asked for."""
    named = F.get_json_object("line", "$.body.model")
    return lines.groupBy(named.alias("model")).agg(F.count("*").alias("n")).withColumn("ok", F.coalesce(F.col("model") == model, F.lit(False)))


def batch_status(log: DataFrame, remote: DataFrame) -> DataFrame:
    """Each logged batch's remote status; not_found where the service does not know it."""
    return log.join(remote.select("batch_id", "status"), "batch_id", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))
