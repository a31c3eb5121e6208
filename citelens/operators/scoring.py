"""Classifiers as plug-ins, verdicts, counters. A scorer turns (text) rows into class probabilities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.registry import Mission
from .dataset import tvt_split

LOW, ERROR, NO_MATCH, NOT_CLASSIFIED = "lowprob", "error", "nomatch", "donotclassify"
SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    """Registers a function that adds a column probs (map class -> probability) to a table with a column text."""
    def own(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        SCORERS[name] = f
        return f

    return own


def scorer(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in SCORERS:
        raise ValueError(f"no scorer called {name}: {sorted(SCORERS)}")
    return SCORERS[name]


def verdict(classes: list[str], probs: Column, threshold: float = 0.7) -> Column:
    """The first class of greatest probability, or LOW under the threshold."""
    best = F.array_max(probs)
    return F.when(best < threshold, LOW).otherwise(F.get(F.array(*[F.lit(c) for c in classes]), F.array_position(probs, best).cast("int") - 1))


def routed_verdict(classes: list[str], probs: Column, text: Column, do_not_classify: Column, failed: Column, threshold: float = 0.7) -> Column:
    """Errors, empty texts and missions not to be classified come before the scorer's verdict."""
    return F.when(failed, ERROR).when(F.coalesce(F.trim(text) == "", F.lit(True)), NO_MATCH).when(do_not_classify, NOT_CLASSIFIED).otherwise(verdict(classes, probs, threshold))


def classify_set(texts: DataFrame, missions: tuple[Mission, ...], modify: Callable[[DataFrame, Mission], DataFrame], score: Callable[[DataFrame], DataFrame], classes: list[str], threshold: float = 0.7) -> DataFrame:
    """(id, bibcode, mission, verdict, probs): every text classified for every mission. ``modify`` gives a mission's
    (bibcode, modif), empty where the text does not name it; ``score`` adds probs to a table with a column text. The missions
    are few and fixed: one branch each, of one plan; texts are scored once for all of them."""
    per = [modify(texts, m).select("bibcode", F.lit(m.label).alias("mission"), F.lit(m.do_not_classify).alias("skip"), F.col("modif").alias("text")) for m in missions]
    every = reduce(DataFrame.unionByName, per)
    scored = score(every)
    probs = F.array(*[F.coalesce(F.col("probs")[c], F.lit(0.0)) for c in classes])
    said = routed_verdict(classes, probs, F.col("text"), F.col("skip"), F.col("probs").isNull() & (F.trim("text") != ""), threshold)
    return scored.select(F.concat_ws("_", "bibcode", "mission").alias("id"), "bibcode", "mission", said.alias("verdict"), "probs")


def train_with_quarantine(rows: DataFrame, modify: Callable[[DataFrame], DataFrame], train: Callable[[DataFrame], object], fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 10):
    """(model, splits, quarantine) of rows (bibcode, class, ...): ``modify`` adds ``text`` and ``error``; rows with an error or
    without text go to quarantine with the reason, the rest are split by bibcode, and ``train`` fits on the train split."""
    made = modify(rows)
    reason = F.coalesce("error", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text"))
    quarantine = made.where(reason.isNotNull()).select("bibcode", "class", reason.alias("error"))
    good = made.where(reason.isNull())
    splits = good.join(tvt_split(good.select("bibcode", "class"), fractions, seed=seed).select("bibcode", "split"), "bibcode")
    return train(splits.where("split = 'train'")), splits, quarantine


def performance(rows: DataFrame, classes: list[str], probs: Column, actual: Column, steps: Column | None = None) -> DataFrame:
    """(threshold, actual, measured, n): counts of verdicts at every threshold of a sweep, in one pass over the rows."""
    each = rows.select(actual.alias("actual"), probs.alias("__p"), F.explode(thresholds() if steps is None else steps).alias("threshold"))
    best = F.array_max("__p")
    named = F.get(F.array(*[F.lit(c) for c in classes]), F.array_position("__p", best).cast("int") - 1)
    return each.select("threshold", "actual", F.when(best < F.col("threshold"), LOW).otherwise(named).alias("measured")).groupBy("threshold", "actual", "measured").agg(F.count("*").alias("n"))


def counters(rows: DataFrame, actual: list[str], measured: list[str]) -> DataFrame:
    """(actual, measured, n, total, share): zero-filled counts of every pair of the domains, and shares of each actual class."""
    domain = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(a) for a in actual])).alias("actual")).select("actual", F.explode(F.array(*[F.lit(m) for m in measured])).alias("measured"))
    counted = rows.groupBy("actual", "measured").agg(F.count("*").alias("n"))
    full = domain.join(counted, ["actual", "measured"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy("actual"))
    return full.withColumn("total", total).withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("total")), F.lit(0.0)))


def thresholds(first: float = 0.5, last: float = 0.95, n: int = 20) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(first) + i * F.lit((last - first) / (n - 1)))


def threshold_sweep(rows: DataFrame, best: Column, right: Column, steps: Column) -> DataFrame:
    """(threshold, n_kept, n_right) for each threshold: rows whose best probability reaches it, and right ones among them."""
    per = rows.select(best.alias("b"), right.alias("r")).groupBy("b", "r").agg(F.count("*").alias("n")).select("b", "r", "n", F.explode(steps).alias("threshold"))
    kept = F.col("b") >= F.col("threshold")
    return per.groupBy("threshold").agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept"), F.sum(F.when(kept & F.col("r"), F.col("n")).otherwise(0)).alias("n_right"))


def train_baseline(labelled: DataFrame, text_col: str = "text", label_col: str = "class"):
    """A pyspark.ml pipeline: hashed words, inverse document frequency, logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    stages = [StringIndexer(inputCol=label_col, outputCol="label", handleInvalid="skip"), RegexTokenizer(inputCol=text_col, outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 16), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=20)]
    return Pipeline(stages=stages).fit(labelled)
