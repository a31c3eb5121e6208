"""JSON, lines, splits and chunks as files; upsert and append sinks. Schemas are explicit."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batching import assign_chunks
from ..operators.responses import keep_latest

PAPERTEXT = "bibcode string, pubdate string, abstract string, body string, title array<string>, author array<string>, keyword array<string>, keyword_norm array<string>"
PAPERTRACK = "bibcode string, searches array<struct<search_key:string,ignored:boolean>>, class_missions array<struct<mission:string,paper_type:string>>"
RUNS = "bibcode string, run int, notes string, error string, missions array<struct<mission:string,papertype:string,confidence:array<double>,reason:string,quotes:array<string>>>"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to as many tasks as there are cores if its files give fewer: a small file is often one row group and so
    one task, too few for work on texts. Tables of many files are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame | None:
    """A JSON array or JSON lines; unparsable records are in _corrupt_record. A missing path is logged and gives None."""
    try:
        return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        logging.getLogger(__name__).error("cannot read %s: %s", path, e)
        return None


def load_datasets(spark: SparkSession, papertext: str, papertrack: str) -> tuple[DataFrame | None, DataFrame | None]:
    return read_json(spark, papertext, PAPERTEXT), read_json(spark, papertrack, PAPERTRACK)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_json_array(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """The rows as one JSON array in one file, in the order of the table's partitions, for tools that take nothing else. One task
    writes it: tables that go on within Spark are ``write_json``'s, which ``read_json`` reads in parallel."""
    one = df.coalesce(1)
    rows = one.select(F.concat(F.when(F.monotonically_increasing_id() == 0, "[").otherwise(","), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("line"))
    end = df.sparkSession.range(1).select(F.lit("[]" if df.isEmpty() else "]").alias("line"))
    rows.unionByName(end).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    """One text file: for short lists."""
    df.select(F.col(column).cast("string")).coalesce(1).write.mode("errorifexists").text(path)


def get_source(papers: DataFrame, bibcode: str | None = None, index: int | None = None) -> DataFrame:
    """The first paper of a bibcode, or the paper at a place in the order of ord; empty if there is none. ``sources.order.numbered``
    gives papers from files their ord."""
    if bibcode is not None:
        return papers.where(F.col("bibcode") == bibcode).orderBy("ord").limit(1)
    return papers.orderBy("ord").offset(index or 0).limit(1)


def append_runs(old: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Runs with new ones appended, numbered on per paper; with ``replace`` a paper's new runs take the old ones' place."""
    if replace:
        return old.join(new.select("bibcode").distinct(), "bibcode", "left_anti").unionByName(new)
    last = old.groupBy("bibcode").agg((F.max("run") + 1).alias("__n"))
    moved = new.join(last, "bibcode", "left").withColumn("run", F.col("run") + F.coalesce("__n", F.lit(0))).drop("__n")
    return old.unionByName(moved.select(old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key, new ones before old ones."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return keep_latest(both, keys, "__v").drop("__v")


def merge_files(spark: SparkSession, paths: list[str], schema: str, keys: list[str]) -> DataFrame:
    """JSON-lines files in order of name; of equal keys the last file's row counts."""
    rows = spark.read.schema(schema).json(paths).withColumn("__file", F.input_file_name())
    return keep_latest(rows, keys, "__file").drop("__file")


def write_split(rows: DataFrame, path: str) -> None:
    """Texts by split and class; never over an earlier split."""
    rows.write.partitionBy("split", "class").mode("errorifexists").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def write_chunks(lines: DataFrame, path: str, lines_per_chunk: int, chunks_per_day: int = 1) -> None:
    """Consecutive lines as one text folder per chunk."""
    chunks = assign_chunks(lines, lines_per_chunk, chunks_per_day)
    chunks.select("chunk", "line").repartition("chunk").write.partitionBy("chunk").mode("errorifexists").text(path)


def save_plan(plan: dict, path: str) -> None:
    Path(path).write_text(json.dumps(plan, indent=1, default=str))


def load_plan(path: str) -> dict:
    """A saved plan; base_chunks is at least the number of chunk files it lists."""
    plan = json.loads(Path(path).read_text())
    return plan | {"base_chunks": max(plan.get("base_chunks", 0), len(plan.get("files", [])))}


def merged(default: dict, user: dict | None) -> dict:
    """A configuration with the user's values in place of the default ones: mappings are merged key by key, lists are joined, and
    any other value of the user's replaces the default one."""
    out = dict(default)
    for key, value in (user or {}).items():
        old = out.get(key)
        if isinstance(old, dict) and isinstance(value, dict):
            out[key] = merged(old, value)
        else:
            out[key] = [*old, *value] if isinstance(old, list) and isinstance(value, list) else value
    return out


def load_config(default: dict, folder: str | None = None, name: str = "citelens_config.json") -> dict:
    """The default configuration with that of the user's file, if there is one in ``folder`` (by default the folder named in
    CITELENS_CONFIG_DIR, else the home folder), merged over it. Variables of the environment are replaced in the file."""
    path = Path(folder or os.environ.get("CITELENS_CONFIG_DIR") or Path.home()) / name
    return merged(default, json.loads(os.path.expandvars(path.read_text())) if path.exists() else None)


def prompt(kind: str, file: str | None = None, config: dict | None = None, default: dict | None = None) -> str:
    """The user's or agent's prompt: from a file, else the configuration, else the packaged default."""
    if kind not in ("user", "agent"):
        raise ValueError(f"unknown prompt {kind}")
    if file and Path(file).exists():
        return Path(file).read_text()
    for source in (config, default):
        if source and source.get(kind):
            return source[kind]
    raise ValueError(f"no {kind} prompt")


def misclassified_report(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(line): a text block per misclassified row."""
    parts = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in columns.items()]
    return rows.select(F.concat(F.concat_ws("\n", *parts), F.lit("\n-----")).alias("line"))


_sources: dict[tuple, tuple[DataFrame | None, DataFrame | None]] = {}


def cached_sources(spark: SparkSession, papertext: str, papertrack: str) -> tuple[DataFrame | None, DataFrame | None]:
    """``load_datasets``, read once an application and kept by Spark, which spills and recomputes what does not fit, until
    ``release_sources``."""
    key = (spark.sparkContext.applicationId, papertext, papertrack)
    if key not in _sources:
        _sources[key] = tuple(df if df is None else df.persist() for df in load_datasets(spark, papertext, papertrack))
    return _sources[key]


def release_sources() -> None:
    """Forgets what ``cached_sources`` keeps."""
    while _sources:
        for df in _sources.popitem()[1]:
            if df is not None:
                df.unpersist()


def read_output(spark: SparkSession, path: str, bibcode: str | None = None) -> DataFrame:
    """Runs written by ``append_runs``, all or one paper's."""
    runs = spark.read.schema(RUNS).json(path)
    return runs if bibcode is None else runs.where(F.col("bibcode") == bibcode)


def paper_to_file(df: DataFrame, path: str, bibcode: str) -> DataFrame:
    """Writes one paper as a JSON folder, for tools that take a file; returns it."""
    one = get_source(df, bibcode)
    one.write.mode("overwrite").json(path)
    return one


def write_results(results: DataFrame, path: str) -> None:
    """Classification results (id, bibcode, mission, verdict, probs) as JSON, one line per paper: id and a list of verdicts."""
    by_mission = lambda a, b: F.when(a["mission"] < b["mission"], -1).when(a["mission"] > b["mission"], 1).otherwise(0)
    per = results.groupBy("bibcode").agg(F.array_sort(F.collect_list(F.struct("mission", "verdict", "probs")), by_mission).alias("missions"))
    per.write.mode("errorifexists").json(path)


def run_serially(items: list[str], run: Callable[[str], None], log: str, pause: float = 0.0, dry_run: bool = False) -> list[str]:
    """Runs items in sorted order, one after the other, skipping those a former call logged; returns what it ran (or would)."""
    path = Path(log)
    done = set(path.read_text().split("\n")) if path.exists() else set()
    todo = [i for i in sorted(items) if i not in done]
    for k, item in enumerate(todo if not dry_run else []):
        if k and pause:
            time.sleep(pause)
        run(item)
        with path.open("a") as f:
            f.write(item + "\n")
    return todo


def write_paragraphs(paragraphs: DataFrame, path: str, overwrite: bool = False) -> None:
    """Paragraphs (bibcode, mission, lo, hi, paragraph) as Parquet by mission; an existing folder is kept unless told otherwise."""
    paragraphs.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("mission").parquet(path)


def read_paragraphs(spark: SparkSession, path: str, missions: list[str] | None = None) -> DataFrame:
    """Written paragraphs, of all or some missions; only their folders are read."""
    found = spark.read.parquet(path)
    return found if missions is None else found.where(F.col("mission").isin(missions))
