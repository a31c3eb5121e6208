"""Responses of a classification model: validation, normalisation, conversion, keys."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.registry import LABELS
from ..functions.text import fenced_json

RESPONSE = "struct<notes:string,missions:array<struct<mission:string,papertype:string,quotes:array<string>,reason:string,confidence:array<double>>>>"


def valid_confidence(confidence: Column) -> Column:
    """Two values that sum to 1 (to 1e-6), or to 0."""
    total = F.aggregate(confidence, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce((F.size(confidence) == 2) & ((total == 0) | (F.abs(total - 1) <= 1e-6)), F.lit(False))


def unique_missions(missions: Column) -> Column:
    """Whether a response names no mission twice."""
    names = F.transform(missions, lambda m: m["mission"])
    return F.size(names) == F.size(F.array_distinct(names))


def canonical_mission(name: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The registered spelling of a mission's name in any case; null if unknown."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label in labels:
        out = out.when(F.lower(name) == label.lower(), label)
    return out


def strip_quotes(quotes: Column) -> Column:
    return F.transform(quotes, lambda q: F.regexp_replace(q, '^"+|"+$', ""))


def parse_response(text: Column) -> Column:
    """struct<error, response> of a model's text: its first fenced JSON block, parsed."""
    raw = fenced_json(text)
    parsed = F.from_json(raw, RESPONSE)
    error = F.when(raw.isNull(), "No JSON content found in response").when(parsed["missions"].isNull(), "JSON could not be decoded")
    return F.struct(error.alias("error"), F.when(error.isNull(), parsed).alias("response"))


def classification(calls: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Calls whose better confidence reaches the threshold, or is exactly one half."""
    best = F.greatest("conf_science", "conf_mention")
    return calls.where((best >= threshold) | (best == 0.5))


def output_key(bibcode: Column, file: Column) -> Column:
    """The paper a response belongs to: its bibcode, else its file name, without a temporary file's parts."""
    return F.coalesce(bibcode, F.coalesce(F.nullif(F.regexp_extract(file, r"temp_[^_]*_(.*)\.json$", 1), F.lit("")), file))


def source_kind(source: Column, files: list[str] | None = None) -> Column:
    """What a source names: one of the known ``files``, an index, or a bibcode."""
    kind = F.when(source.rlike("^[0-9]+$"), "index").otherwise("bibcode")
    return F.when(source.isin(files), "file").otherwise(kind) if files else kind


def unfilled_fields(template: str, fields: list[str]) -> list[str]:
    """The fields of a prompt template that a paper's columns do not fill, in order."""
    return list(dict.fromkeys(f for f in re.findall(r"\{(\w+)\}", template) if f not in fields))


def classify_papers(papers: DataFrame, prompt: Column, responder: Callable[[str], str], n_runs: int = 1) -> DataFrame:
    """Runs (bibcode, run, notes, error, missions) of a model: ``responder`` turns a prompt into a response text and is called
    in the tasks, ``n_runs`` times a paper; if it raises, the message is the run's error. Names are set to their registered
    spelling, quotes stripped; a response that fails validation keeps its error."""

    @F.pandas_udf("struct<text:string,failed:string>")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        def one(p: str | None) -> tuple[str | None, str | None]:
            try:
                return responder(p or ""), None
            except Exception as e:  # noqa: BLE001  a run's failure is data
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(p) for p in prompts], columns=["text", "failed"])

    each = papers.select("bibcode", prompt.alias("prompt"), F.explode(F.sequence(F.lit(1), F.lit(n_runs))).alias("run"))
    said = each.select("bibcode", "run", ask.asNondeterministic()("prompt").alias("a")).select("bibcode", "run", "a.*")
    parsed = said.withColumn("p", parse_response(F.col("text")))
    missions = F.transform("p.response.missions", lambda m: m.withField("mission", F.coalesce(canonical_mission(m["mission"]), m["mission"])).withField("quotes", strip_quotes(m["quotes"])))
    error = F.coalesce("failed", "p.error", F.when(~unique_missions(F.col("missions")) | F.exists("missions", lambda m: ~valid_confidence(m["confidence"])), "Validation failed"))
    return parsed.withColumn("missions", missions).select("bibcode", "run", F.col("p.response.notes").alias("notes"), error.alias("error"), "missions")


def keep_latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of rows with equal keys the one of the greatest version: upsert, or merge of files where later ones win."""
    w = W.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def requests(papers: DataFrame, wanted: DataFrame, model: str, prompt: Column) -> DataFrame:
    """(line): a JSON request for each wanted paper that has a source."""
    body = F.struct(F.lit(model).alias("model"), prompt.alias("input"))
    found = papers.join(wanted.select("bibcode").distinct(), "bibcode", "left_semi")
    return found.select(F.to_json(F.struct(F.col("bibcode").cast("string").alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("line"))


def adjust_model(lines: DataFrame, old: str, new: str) -> DataFrame:
    """Requests with another model's name."""
    return lines.withColumn("line", F.replace("line", F.lit(f'"{old}"'), F.lit(f'"{new}"')))


def batch_results(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result lines (custom_id, text) -> valid responses and, apart, those that failed with the reason."""
    parsed = lines.withColumn("p", parse_response(F.col("text")))
    missions = F.col("p.response.missions")
    good = F.col("p.error").isNull() & unique_missions(missions) & F.forall(missions, lambda m: valid_confidence(m["confidence"]) & canonical_mission(m["mission"]).isNotNull())
    marked = parsed.withColumn("ok", F.coalesce(good, F.lit(False)))
    return marked.where("ok").select("custom_id", "p.response.*"), marked.where("NOT ok").select("custom_id", F.coalesce("p.error", F.lit("Validation failed")).alias("error"))
