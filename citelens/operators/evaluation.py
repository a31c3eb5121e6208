"""Evaluation of repeated classification runs. Runs are rows (bibcode, run, error, missions array<struct<mission, papertype,
confidence array<double>, ...>>); calls are their missions, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCEPT, INSPECT = 0.5, 0.45


def round3(c: Column) -> Column:
    return F.bround(c, 3)  # half to even


def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs without an error that call a mission."""
    return runs.where(F.col("error").isNull() & (F.size("missions") > 0))


def explode_calls(runs: DataFrame) -> DataFrame:
    """(bibcode, run, mission, papertype, conf_science, conf_mention): one row per call of the valid runs."""
    return valid_runs(runs).select("bibcode", "run", F.inline(F.transform("missions", lambda m: F.struct(
        m["mission"].alias("mission"), m["papertype"].alias("papertype"), m["confidence"][0].alias("conf_science"), m["confidence"][1].alias("conf_mention"))))
    )


def grouped_calls(calls: DataFrame) -> DataFrame:
    """Per (bibcode, mission, papertype): mean and population deviation of each confidence (rounded half to even), count,
    the paper's number of valid runs, and means weighted by count / runs."""
    runs = calls.groupBy("bibcode").agg(F.countDistinct("run").alias("n_runs"))
    stats = calls.groupBy("bibcode", "mission", "papertype").agg(
        round3(F.avg("conf_science")).alias("mean_science"), round3(F.avg("conf_mention")).alias("mean_mention"),
        round3(F.stddev_pop("conf_science")).alias("std_science"), round3(F.stddev_pop("conf_mention")).alias("std_mention"), F.count("*").alias("count"),
    )
    weigh = lambda c: round3(F.col(c) * F.col("count") / F.col("n_runs"))
    return stats.join(runs, "bibcode").withColumns({"weighted_science": weigh("mean_science"), "weighted_mention": weigh("mean_mention")})


def mission_confidence(grouped: DataFrame) -> DataFrame:
    """Per (bibcode, mission): summed weighted confidences, their total, the mission's share of the paper and the share of
    each paper type; null where a total is zero."""
    per = grouped.groupBy("bibcode", "mission").agg(F.sum("weighted_science").alias("total_science"), F.sum("weighted_mention").alias("total_mention"))
    per = per.withColumn("total", F.col("total_science") + F.col("total_mention"))
    paper = F.sum("total").over(W.partitionBy("bibcode"))
    return per.select("*", round3(F.try_divide("total", paper)).alias("prob_mission"), F.try_divide("total_science", "total").alias("prob_science"), F.try_divide("total_mention", "total").alias("prob_mention"))


def route(grouped: DataFrame, per_mission: DataFrame, accept: float = ACCEPT, inspect: float = INSPECT) -> DataFrame:
    """Accepted and to-inspect (mission, papertype) of each paper, with the mission's totals and probability."""
    best = F.greatest("weighted_science", "weighted_mention")
    routed = grouped.withColumn("route", F.when(best >= accept, "accept").when(best >= inspect, "inspect")).where("route IS NOT NULL")
    return routed.join(per_mission, ["bibcode", "mission"]).select("bibcode", "mission", "papertype", "route", "total_science", "total_mention", "prob_mission")


def consistency(grouped: DataFrame, human: DataFrame) -> DataFrame:
    """With ``human`` (bibcode, mission, papertype): in_human_class, and the share of runs, in percent, that agree (0 where
    the class is not a human one). Missions compare without regard to case."""
    labels = human.select("bibcode", F.upper("mission").alias("__m"), F.col("papertype").alias("__p")).distinct().withColumn("__in", F.lit(True))
    on = (grouped["bibcode"] == labels["bibcode"]) & (F.upper(grouped["mission"]) == labels["__m"]) & (grouped["papertype"] == labels["__p"])
    joined = grouped.join(labels, on, "left").drop(labels["bibcode"])
    return joined.select(*[c for c in grouped.columns], F.coalesce("__in", F.lit(False)).alias("in_human_class"),
                         F.when(F.col("__in"), F.bround(100.0 * F.col("count") / F.col("n_runs"), 3)).otherwise(0.0).alias("consistency"))


def missing_missions(calls: DataFrame, human: DataFrame) -> DataFrame:
    """(bibcode, side, missions): missions the model named and people did not ("human"), and the converse ("llm"); sorted,
    joined by commas; of papers with valid runs."""
    a = calls.groupBy("bibcode").agg(F.collect_set(F.upper("mission")).alias("llm"))
    b = human.groupBy("bibcode").agg(F.collect_set(F.upper("mission")).alias("human"))
    none = F.array().cast("array<string>")
    both = a.join(b, "bibcode", "left").withColumn("human", F.coalesce("human", none))
    sides = F.array(F.struct(F.lit("human").alias("side"), F.array_except("llm", "human").alias("m")), F.struct(F.lit("llm").alias("side"), F.array_except("human", "llm").alias("m")))
    return both.select("bibcode", F.inline(sides)).where(F.size("m") > 0).select("bibcode", "side", F.array_join(F.array_sort("m"), ",").alias("missions"))


def hallucinated(calls: DataFrame, found: DataFrame) -> DataFrame:
    """Called (bibcode, mission) that ``found`` (bibcode, mission), what the text names, does not hold."""
    called = calls.select("bibcode", F.upper("mission").alias("mission")).distinct()
    return called.join(found.select("bibcode", F.upper("mission").alias("mission")).distinct(), ["bibcode", "mission"], "left_anti")


def errors(papers: DataFrame, runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(bibcode, error) of the ``wanted`` papers that cannot be evaluated: no source, or no valid output."""
    ok = valid_runs(runs).select("bibcode").distinct().withColumn("__out", F.lit(True))
    source = papers.select("bibcode").distinct().withColumn("__src", F.lit(True))
    joined = wanted.select("bibcode").distinct().join(source, "bibcode", "left").join(ok, "bibcode", "left")
    why = F.when(F.col("__src").isNull(), "No paper source found").when(F.col("__out").isNull(), F.concat(F.lit("No mission output found for "), F.col("bibcode").cast("string")))
    return joined.select("bibcode", why.alias("error")).where("error IS NOT NULL")


def _acceptance(accept: float, inspect: float) -> Column:
    best = F.greatest("conf_science", "conf_mention")
    return F.when(best >= accept, "accept").when(best >= inspect, "inspect")


def acceptance_tally(calls: DataFrame, accept: float, inspect: float) -> DataFrame:
    """Per lower-cased (mission, papertype): calls, accepted calls and papers, calls to inspect and papers."""
    route = _acceptance(accept, inspect)
    of = lambda r: F.coalesce(route == r, F.lit(False))
    return calls.groupBy(F.lower("mission").alias("mission"), F.lower("papertype").alias("papertype")).agg(
        F.count("*").alias("total_count"), F.count_if(of("accept")).alias("accepted_count"), F.countDistinct(F.when(of("accept"), F.col("bibcode"))).alias("accepted_papers"),
        F.count_if(of("inspect")).alias("inspection_count"), F.countDistinct(F.when(of("inspect"), F.col("bibcode"))).alias("inspection_papers"),
    )


def acceptance_papers(calls: DataFrame, accept: float, inspect: float) -> DataFrame:
    """(mission, papertype, route, bibcode): the papers behind the tally, one row each."""
    return calls.select(F.lower("mission").alias("mission"), F.lower("papertype").alias("papertype"), _acceptance(accept, inspect).alias("route"), "bibcode").where("route IS NOT NULL").distinct()


def evaluate(papers: DataFrame, runs: DataFrame, human: DataFrame, found: DataFrame, wanted: DataFrame, accept: float = ACCEPT, inspect: float = INSPECT) -> dict[str, DataFrame]:
    """All of an evaluation from runs to summary, for the ``wanted`` bibcodes: "missions" (mission confidences), "classes"
    (grouped calls with agreement, route and whether the text names the mission), "missing" (missions one side lacks),
    "hallucinated", and "errors" (papers without a source or an output, the latter with their human labels).

    ``human``: (bibcode, mission, papertype); ``found``: (bibcode, mission) that the texts name."""
    ids = wanted.select("bibcode").distinct()
    failed = errors(papers, runs, ids)
    calls = explode_calls(runs.join(ids, "bibcode", "left_semi").join(failed, "bibcode", "left_anti"))
    own = human.join(ids, "bibcode", "left_semi")
    grouped = grouped_calls(calls)
    per = mission_confidence(grouped)
    wrong = hallucinated(calls, found)
    routes = route(grouped, per, accept, inspect).select("bibcode", "mission", "papertype", "route")
    named = wrong.select("bibcode", F.col("mission").alias("__m"), F.lit(True).alias("__h"))
    agreed = consistency(grouped, own).withColumn("__m", F.upper("mission")).join(routes, ["bibcode", "mission", "papertype"], "left").join(named, ["bibcode", "__m"], "left")
    classes = agreed.withColumn("hallucinated", F.coalesce("__h", F.lit(False))).drop("__m", "__h")
    labels = own.groupBy("bibcode").agg(F.array_sort(F.collect_set(F.concat_ws(":", F.upper("mission"), "papertype"))).alias("labels"))
    reported = failed.join(labels, "bibcode", "left").withColumn("human", F.when(F.col("error").startswith("No mission output"), F.array_join("labels", ","))).select("bibcode", "error", "human")
    return {"missions": per, "classes": classes, "missing": missing_missions(calls, own), "hallucinated": wrong, "errors": reported}
