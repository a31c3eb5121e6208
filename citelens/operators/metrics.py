"""Label pairs, confusion, reports, ROC, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import range_of, starts

POSITIVE, NEGATIVE = "SCIENCE", "NONSCIENCE"
# Which paper types count as science.
PAPERTYPES = {"science": POSITIVE, "mention": NEGATIVE, "supermention": NEGATIVE, "data_influenced": NEGATIVE, "data-influenced": NEGATIVE, "unresolved_grey": NEGATIVE, "engineering": NEGATIVE, "instrument": NEGATIVE}


def map_papertype(papertype: Column, mapping: dict[str, str] = PAPERTYPES) -> Column:
    """The class a paper type counts as; null for an unknown one."""
    low = F.lower(papertype)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in mapping.items():
        out = out.when(low == k, v.upper())
    return out


# The masks of the pretrained classifier's classes.
MASKS = {"science": "science", "mention": "mention", "supermention": "mention", "data_influenced": "data_influenced"}


def report_lines(report: DataFrame, digits: int = 4) -> DataFrame:
    """(line) of a class report, as people print it: label, precision, recall, f1 and support in columns."""
    cell = lambda c: F.lpad(F.format_string(f"%.{digits}f", c), 10, " ")
    return report.select(F.concat(F.rpad("label", 14, " "), cell("precision"), cell("recall"), cell("f1"), F.lpad(F.col("support").cast("string"), 10, " ")).alias("line"))


def mask_class(papertype: Column, masks: dict[str, str] = MASKS, other: str = "other") -> Column:
    """The pretrained classifier's class of a paper type in any case; ``other`` for an unknown one, null for null."""
    low = F.lower(papertype)
    return F.when(papertype.isNotNull(), F.coalesce(F.create_map(*[F.lit(x) for kv in masks.items() for x in kv])[low], F.lit(other)))


def label_pairs(bibcodes: DataFrame, missions: DataFrame, human: DataFrame, llm: DataFrame) -> DataFrame:
    """(bibcode, mission, human_raw, llm_raw, human, llm) for every paper and requested mission. Missions are upper-cased.
    One side only: the other counts as ignored, so NONSCIENCE; neither: both NONSCIENCE. Of several labels the first counts,
    by a column ``ord`` where the table has one, else by name. The missions are few and fixed: they are exploded, not joined."""
    def one(df: DataFrame, c: str) -> DataFrame:
        first = F.min_by("papertype", F.struct("ord", "papertype")) if "ord" in df.columns else F.min("papertype")
        return df.groupBy("bibcode", F.upper("mission").alias("mission")).agg(first.alias(c))

    grid = bibcodes.select("bibcode").distinct().select("bibcode", F.explode(F.array(*[F.lit(m["mission"].upper()) for m in missions.collect()])).alias("mission"))
    both = grid.join(one(human, "human_raw"), ["bibcode", "mission"], "left").join(one(llm, "llm_raw"), ["bibcode", "mission"], "left")
    return both.withColumns({"human": F.coalesce(map_papertype(F.col("human_raw")), F.lit(NEGATIVE)), "llm": F.coalesce(map_papertype(F.col("llm_raw")), F.lit(NEGATIVE))})


def cell(human: Column, llm: Column) -> Column:
    yes, said = human == POSITIVE, llm == POSITIVE
    return F.when(yes & said, "tp").when(yes, "fn").when(said, "fp").otherwise("tn")


def confusion(pairs: DataFrame) -> DataFrame:
    """One row: tn, fp, fn, tp and their rates; a rate over nothing is 0. The domain is fixed, whatever labels occur."""
    counts = pairs.agg(*[F.count_if(cell(F.col("human"), F.col("llm")) == k).alias(k) for k in ("tn", "fp", "fn", "tp")])
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    return counts.withColumns({"tnr": rate("tn", "fp"), "fpr": rate("fp", "tn"), "fnr": rate("fn", "tp"), "tpr": rate("tp", "fn")})


def confusion_cells(pairs: DataFrame) -> DataFrame:
    """(cell, bibcode, mission, human_raw, llm_raw): the rows behind each count."""
    return pairs.select(cell(F.col("human"), F.col("llm")).alias("cell"), "bibcode", "mission", "human_raw", "llm_raw")


def class_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of both classes, accuracy, macro and weighted averages; 0 / 0 is 0."""
    return report_of_counts(confusion(pairs))


def report_of_counts(counts: DataFrame) -> DataFrame:
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    def row(label: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), div(hit, hit + wrong).alias("precision"), div(hit, hit + missed).alias("recall"), div(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"))

    two = counts.select(row(NEGATIVE, tn, fn, fp).alias("n"), row(POSITIVE, tp, fp, fn).alias("s"), div(tn + tp, tn + fp + fn + tp).alias("acc"), (tn + fp + fn + tp).alias("all"))

    def average(label: str, f) -> Column:
        return F.struct(F.lit(label).alias("label"), *[f(k).alias(k) for k in ("precision", "recall", "f1")], F.col("all").alias("support"))

    macro = average("macro avg", lambda k: (F.col("n")[k] + F.col("s")[k]) / 2)
    weighted = average("weighted avg", lambda k: div(F.col("n")[k] * F.col("n")["support"] + F.col("s")[k] * F.col("s")["support"], F.col("all")))
    accuracy = F.struct(F.lit("accuracy").alias("label"), F.col("acc").alias("precision"), F.col("acc").alias("recall"), F.col("acc").alias("f1"), F.col("all").alias("support"))
    return two.select(F.inline(F.array("n", "s", accuracy, macro, weighted)))


def roc_scores(pairs: DataFrame, per_mission: DataFrame) -> DataFrame:
    """(bibcode, mission, label 0/1, score): the mission's science share where the model accepted it, else 0."""
    prob = per_mission.select("bibcode", F.upper("mission").alias("mission"), "prob_science")
    joined = pairs.join(prob, ["bibcode", "mission"], "left")
    score = F.when(F.col("llm_raw").isNotNull(), F.coalesce("prob_science", F.lit(0.0))).otherwise(0.0)
    return joined.select("bibcode", "mission", (F.col("human") == POSITIVE).cast("int").alias("label"), score.alias("score"))


def roc_curve(scores: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) by descending score, from a start at infinity; scores on a straight line are dropped.

    Rows are summed per distinct score, and running sums go by ranges of scores: no task sees more than one range's scores.
    """
    per = scores.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    per = per.withColumn("block", range_of(per, "score"))
    edges = per.groupBy("block").agg(F.max_by(F.struct("p", "n"), "score").alias("top"))
    below = edges.select("block", F.lag("top").over(W.orderBy("block")).alias("below"), F.lead("block").over(W.orderBy("block")).isNull().alias("highest"))
    joined = per.join(F.broadcast(starts(per, "block", {"p0": F.sum("p"), "n0": F.sum("n")}, descending=True)), "block").join(F.broadcast(below), "block")
    w = W.partitionBy("block").orderBy(F.desc("score"))
    down = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    next_ = F.coalesce(F.lead(F.struct("p", "n")).over(w), F.col("below"))
    points = joined.select(
        F.col("score").alias("threshold"), (F.col("p0") + F.sum("p").over(down)).alias("tp"), (F.col("n0") + F.sum("n").over(down)).alias("fp"),
        (next_.isNull() | (F.col("highest") & (F.row_number().over(w) == 1)) | (next_["p"] != F.col("p")) | (next_["n"] != F.col("n"))).alias("bend"),
    )
    if drop_collinear:
        points = points.where("bend")
    total = per.agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    start = total.select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    points = start.unionByName(points.drop("bend")).join(F.broadcast(total))  # one row
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return points.select("threshold", "tp", "fp", rate("tp", "ps").alias("tpr"), rate("fp", "ns").alias("fpr"))


def auc(scores: DataFrame) -> DataFrame:
    """One row: the area under the curve of rows (label, score), by trapezoids: each score's negatives times the positives above
    it and half of those at it. 0 if a class is missing."""
    per = scores.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    per = per.withColumn("block", range_of(per, "score"))
    above = F.coalesce(F.sum("p").over(W.partitionBy("block").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = per.withColumn("above", above).join(F.broadcast(starts(per, "block", {"p0": F.sum("p")}, descending=True)), "block")
    area = F.sum(F.col("n") * (F.col("p0") + F.col("above") + F.col("p") / 2))
    return joined.agg(F.coalesce(F.try_divide(area, (F.sum("p") * F.sum("n")).cast("double")), F.lit(0.0)).alias("auc"))


def auc_per_class(rows: DataFrame, classes: list[str], round_to: int = 6) -> DataFrame:
    """(class, auc) of rows (actual, probs map<class, double>), one class against the rest; then "macro", the mean of the
    classes, and "micro", over all (row, class) decisions together. Scores are rounded first: closer ones count as equal, and
    no class has more than a million of them. Sums above a score go by ranges of scores."""
    each = F.array(*[F.struct(F.lit(c).alias("class"), (F.col("actual") == c).cast("int").alias("label"), F.round(F.coalesce(F.col("probs")[c], F.lit(0.0)), round_to).alias("score")) for c in classes])
    decisions = rows.select(F.inline(each))
    both = decisions.unionByName(decisions.withColumn("class", F.lit("micro")))
    per = both.groupBy("class", "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    per = per.withColumn("block", range_of(per, "score"))
    higher = W.partitionBy("class").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    before = per.groupBy("class", "block").agg(F.sum("p").alias("__p")).select("class", "block", F.coalesce(F.sum("__p").over(higher), F.lit(0)).alias("p0"))
    above = F.col("p0") + F.coalesce(F.sum("p").over(W.partitionBy("class", "block").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    area = F.sum(F.col("n") * (F.col("above") + F.col("p") / 2))
    own = per.join(F.broadcast(before), ["class", "block"]).withColumn("above", above).groupBy("class").agg(F.coalesce(F.try_divide(area, (F.sum("p") * F.sum("n")).cast("double")), F.lit(0.0)).alias("auc"))
    return own.unionByName(own.where("class <> 'micro'").agg(F.lit("macro").alias("class"), F.avg("auc").alias("auc")))


def nearest_thresholds(curve: DataFrame) -> DataFrame:
    """For 0.1, 0.2 ... 0.9 the curve's point with the closest threshold, the higher one of two."""
    wanted = F.explode(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i / F.lit(10.0))).alias("wanted")
    near = curve.where(F.col("threshold") < float("inf")).select(wanted, "*")
    key = F.struct(F.abs(F.col("threshold") - F.col("wanted")).alias("d"), (-F.col("threshold")).alias("t"))
    return near.groupBy("wanted").agg(F.min_by(F.struct("threshold", "tpr", "fpr"), key).alias("p")).select("wanted", "p.*")


def callouts(pairs: DataFrame, human: DataFrame, llm: DataFrame, missions: list[str], failed: DataFrame | None = None, hallucinated: DataFrame | None = None) -> DataFrame:
    """One row of counts: papers, human and model calls of requested missions, distinct model missions beyond them, calls both
    made. With ``failed`` (bibcode, error): papers without an output; with ``hallucinated`` (bibcode, mission), calls that the
    text does not bear out: how many of them people made as well."""
    names = [m.upper() for m in missions]
    own = pairs.agg(F.countDistinct("bibcode").alias("n_bibcodes"), F.count("human_raw").alias("n_human_callouts"), F.count("llm_raw").alias("n_llm_callouts"),
                    F.count_if(F.col("human_raw").isNotNull() & F.col("llm_raw").isNotNull()).alias("n_both_callouts"))
    beyond = llm.where(~F.upper("mission").isin(names)).agg(F.countDistinct(F.upper("mission")).alias("n_non_mission"))
    out = own.join(F.broadcast(beyond))  # one row each, as are the others
    if failed is not None:
        out = out.join(F.broadcast(failed.agg(F.count_if(F.col("error").startswith("No mission output")).alias("n_missing_output"))))
    if hallucinated is not None:
        joint = hallucinated.select("bibcode", F.upper("mission").alias("mission")).distinct().join(human.select("bibcode", F.upper("mission").alias("mission")).distinct(), ["bibcode", "mission"], "left_semi")
        out = out.join(F.broadcast(joint.agg(F.count("*").alias("n_joint_hallucinations"))))
    return out


def audit(human: DataFrame, llm: DataFrame) -> DataFrame:
    """(bibcode, mission, human, result) of every human label against that paper's model labels, compared as written:
    matched, ignored, false_negative_because_ignored, false_negative, false_positive, or null."""
    h = human.select("bibcode", F.upper("mission").alias("mission"), F.upper("papertype").alias("human"))
    said = llm.select("bibcode", F.upper("mission").alias("mission"), F.upper("papertype").alias("said"))
    per = h.join(said, ["bibcode", "mission"], "left").groupBy("bibcode", "mission", "human").agg(
        F.count("said").alias("n"), F.coalesce(F.bool_or(F.col("said") == F.col("human")), F.lit(False)).alias("equal"), F.coalesce(F.bool_or(F.col("said") == POSITIVE), F.lit(False)).alias("science"))
    science = F.col("human") == POSITIVE
    result = (F.when((F.col("n") == 0) & science, "false_negative_because_ignored").when(F.col("n") == 0, "ignored").when(F.col("equal"), "matched")
              .when(science, "false_negative").when(F.col("science"), "false_positive"))
    return per.select("bibcode", "mission", "human", result.alias("result"))


def llm_only(human: DataFrame, llm: DataFrame) -> DataFrame:
    """Papers the model classified and people did not."""
    return llm.select("bibcode").distinct().join(human.select("bibcode").distinct(), "bibcode", "left_anti")


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row: papers and classifications that failed, and each kind's count. With a column ``flag``, a flagged row counts as
    failed whatever its result, and flags are counted."""
    flagged = F.coalesce(F.col("flag"), F.lit(False)) if "flag" in audited.columns else F.lit(False)
    bad = audited.where(flagged | (F.col("result").isNotNull() & (F.col("result") != "matched")))
    kinds = ("false_positive", "false_negative", "false_negative_because_ignored", "ignored")
    more = [F.count_if(flagged).alias("flag")] if "flag" in audited.columns else []
    return bad.agg(F.countDistinct("bibcode").alias("n_papers"), F.count("*").alias("n_classifications"), *[F.count_if(F.col("result") == k).alias(k) for k in kinds], *more)
