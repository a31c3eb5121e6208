"""Paragraphs around the sentences that name a mission."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grammar, parse
from ..functions.registry import MISSIONS, Mission
from ..functions.text import acronym_in, anonymise, forms, let, mention_in, phrase_in, sentences, streamline, where_near
from ..sources.stage import materialise
from .ambiguity import key_of, settle


def merge_spans(hits: DataFrame, keys: list[str], buffer: int) -> DataFrame:
    """Rows (keys, i, last) -> (keys, lo, hi): each hit i widened by ``buffer`` sentences, within 0 .. last; spans that overlap
    or share an end are joined, so that none are at buffer 0."""
    order = W.partitionBy(*keys).orderBy("i")
    spans = hits.select(*keys, "i", "last", F.greatest(F.col("i") - buffer, F.lit(0)).alias("lo"), F.least(F.col("i") + buffer, F.col("last")).alias("hi")).dropDuplicates([*keys, "i"])
    begins = F.when(F.coalesce(F.lag(F.col("i") + buffer).over(order) >= F.col("lo"), F.lit(False)) & F.lit(buffer > 0), 0).otherwise(1)
    grouped = spans.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return grouped.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def _rules(v: Column, mission: Mission) -> Column:
    if not mission.ambiguous:
        return mention_in(v, mission)
    plain = tuple(p for p in mission.phrases if p.lower() not in {a.lower() for a in mission.ambiguous})
    out = F.when(acronym_in(v, mission), True)
    if plain:
        out = out.when(phrase_in(v, Mission(mission.label, plain, mission.cased, mission.uncased, mission.banned)), True)
    return out.when(~phrase_in(v, mission), False)


def verdict_by_rules(sentence: Column, mission: Mission) -> Column:
    """Whether a sentence that holds an ambiguous word means the mission, as far as expressions tell; null if a linguistic
    look is needed. In turn: a term without ambiguous words, no term at all, an acronym, a phrase that is more than an
    ambiguous word."""
    return let(forms(sentence), lambda v: _rules(v, mission))


def _verdicts(v: Column, missions: tuple[Mission, ...]) -> Column:
    return F.array(*[F.struct(F.lit(m.label).alias("mission"), _rules(v, m).alias("verdict")) for m in missions])


def verdicts(sentence: Column, missions: tuple[Mission, ...] = MISSIONS) -> Column:
    """array<struct<mission, verdict>>: ``verdict_by_rules`` for every mission, the sentence's forms computed once."""
    no = F.array(*[F.struct(F.lit(m.label).alias("mission"), F.lit(False).alias("verdict")) for m in missions])
    return where_near(sentence, missions, lambda v: _verdicts(v, missions), no)


def _labels(sentence: Column, missions: tuple[Mission, ...], counts: Callable[[Column], Column]) -> Column:
    """Labels of the missions whose verdict by rules ``counts``; false never does."""
    return where_near(sentence, missions, lambda v: F.array_compact(F.array(*[F.when(counts(_rules(v, m)), m.label) for m in missions])), F.array().cast("array<string>"))


def _each(rows: DataFrame) -> DataFrame:
    """A row per element of ``mission``. An inner generator would have the optimiser compute the array once more, to filter on it
    first, which is what costs here; hence an outer one, and the filter after it."""
    return rows.withColumn("mission", F.explode_outer("mission")).where("mission IS NOT NULL")


def sentence_rows(papers: DataFrame, text: Column) -> DataFrame:
    """(bibcode, i, last, sentence): the sentences of a text, exploded once for all missions."""
    split = papers.select("bibcode", sentences(text).alias("s"))
    return split.select("bibcode", (F.size("s") - 1).alias("last"), F.posexplode("s").alias("i", "sentence"))


def mission_sentences(rows: DataFrame, missions: tuple[Mission, ...] = MISSIONS, undecided: bool = True) -> DataFrame:
    """(bibcode, mission, i, last) of sentences that count for each mission. ``undecided``: whether an ambiguous word that
    rules cannot settle counts."""
    hits = _labels(F.col("sentence"), missions, lambda verdict: F.coalesce(verdict, F.lit(undecided)))
    return _each(rows.select("bibcode", "i", "last", hits.alias("mission")))


def _ruled(papers: DataFrame, text: Column, missions: tuple[Mission, ...], *more: Column) -> DataFrame:
    """(bibcode, r, more): a paper's sentences as array<struct<sentence, said>>, ``said`` the ``verdicts`` of the missions that rules settle
    for it or leave open."""
    told = lambda v: F.filter(_verdicts(v, missions), lambda m: F.coalesce(m["verdict"], F.lit(True)))
    said = lambda x: where_near(x, missions, told, F.array().cast("array<struct<mission:string,verdict:boolean>>"))
    return papers.select("bibcode", F.transform(sentences(text), lambda x: F.struct(x.alias("sentence"), said(x).alias("said"))).alias("r"), *more)


def _spoken(r: Column) -> Column:
    """array<struct<i, mission, verdict, sentence>> of ``_ruled`` sentences; the sentence of open ones only."""
    one = lambda x, i: F.transform(x["said"], lambda m: F.struct(i.alias("i"), m["mission"].alias("mission"), m["verdict"].alias("verdict"), F.when(m["verdict"].isNull(), x["sentence"]).alias("sentence")))
    return F.flatten(F.transform(r, one))


def _told(asked: DataFrame, keep: list[str], missions: tuple[Mission, ...], lexicon: DataFrame | None) -> DataFrame:
    """(keep, i, mission) of open sentences that phrases settle for their mission. Only these sentences are shuffled."""
    return settle(asked, [*keep, "i"], missions, lexicon).where("verdict").select(*keep, "i", "mission")


def settled_sentences(papers: DataFrame, text: Column, missions: tuple[Mission, ...] = MISSIONS, lexicon: DataFrame | None = None) -> DataFrame:
    """(bibcode, i, mission) of every sentence that means a mission: by rules, else by phrases (``operators.ambiguity``).
    Bibcodes are unique. The rules, which cost most, are tried once: what they settle or leave open is written."""
    rows = materialise(_ruled(papers, text, missions).select("bibcode", F.inline_outer(_spoken(F.col("r")))).where("mission IS NOT NULL"), "sentences")
    return rows.where("verdict").select("bibcode", "i", "mission").unionByName(_told(rows.where("verdict IS NULL"), ["bibcode"], missions, lexicon))


def marked_papers(papers: DataFrame, text: Column, missions: tuple[Mission, ...] = MISSIONS, undecided: bool | None = True, lexicon: DataFrame | None = None) -> DataFrame:
    """(bibcode, s, h): a paper's sentences, and for each the missions that it counts for. ``undecided`` None: sentences that
    rules cannot settle count where a phrase of the table says so; what that finds is joined to the papers by a hash of their
    text. Otherwise one narrow pass."""
    if undecided is not None:
        split = papers.select("bibcode", sentences(text).alias("s"))
        return split.select("bibcode", "s", F.transform("s", lambda x: _labels(x, missions, lambda verdict: F.coalesce(verdict, F.lit(undecided)))).alias("h"))
    # The key tells papers with equal texts apart and is never null, so that no task gets many papers.
    ruled = _ruled(papers, text, missions).withColumn("p", key_of(F.concat_ws("\n", F.col("bibcode").cast("string"), F.transform("r", lambda x: x["sentence"]))))
    asked = ruled.select("p", F.inline_outer(F.filter(_spoken(F.col("r")), lambda x: x["verdict"].isNull()))).where("mission IS NOT NULL")  # an inner one would have the rules tried for a filter as well
    meant = _told(asked, ["p"], missions, lexicon).groupBy("p").agg(F.collect_list(F.struct("i", "mission")).alias("meant"))
    sure = lambda x: F.transform(F.filter(x["said"], lambda m: m["verdict"].isNotNull()), lambda m: m["mission"])
    more = lambda i: F.coalesce(F.transform(F.filter("meant", lambda x: x["i"] == i), lambda x: x["mission"]), F.array().cast("array<string>"))
    return ruled.join(meant, "p", "left").select("bibcode", F.transform("r", lambda x: x["sentence"]).alias("s"), F.transform("r", lambda x, i: F.concat(sure(x), more(i))).alias("h"))


def _spans(hits: Column, last: Column, buffer: int) -> Column:
    """As ``merge_spans``, of a sorted array of hits: array<struct<lo, hi>>."""
    end = F.size(hits) - 1
    opens = lambda k: (k == 0) | (F.get(hits, k - 1) + buffer < F.greatest(F.get(hits, k) - buffer, F.lit(0))) | F.lit(buffer == 0)
    starts = F.filter(F.sequence(F.lit(0), end), opens)
    closes = lambda j, at: F.coalesce(F.get(at, j + 1) - 1, end)
    one = lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda j: F.struct(F.greatest(F.get(hits, F.get(at, j)) - buffer, F.lit(0)).alias("lo"), F.least(F.get(hits, closes(j, at)) + buffer, last).alias("hi")))
    return let(starts, one)


def paragraphs(papers: DataFrame, text: Column, buffer: int = 0, missions: tuple[Mission, ...] = MISSIONS, undecided: bool | None = True) -> DataFrame:
    """(bibcode, mission, lo, hi, paragraph): the sentences of each span, joined by spaces. ``undecided`` as in
    ``marked_papers``. Each row is a paper; its sentences stay with it, so nothing is shuffled."""
    each = _each(marked_papers(papers, text, missions, undecided).select("bibcode", "s", "h", F.array_distinct(F.flatten("h")).alias("mission")))
    hits = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.array_contains(F.get("h", i), F.col("mission")))
    found = each.select("bibcode", "mission", "s", hits.alias("at")).select("bibcode", "mission", "s", F.inline(_spans(F.col("at"), F.size("s") - 1, buffer)))
    return found.select("bibcode", "mission", "lo", "hi", F.array_join(F.slice("s", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1), " ").alias("paragraph"))


def missions_in_text(papers: DataFrame, text: Column, missions: tuple[Mission, ...] = MISSIONS, undecided: bool | None = True) -> DataFrame:
    """(bibcode, mission) where the text has a paragraph for the mission. Each row is a paper."""
    return _each(marked_papers(papers, text, missions, undecided).select("bibcode", F.array_distinct(F.flatten("h")).alias("mission")))


def missions_or_names(papers: DataFrame, text: Column, missions: tuple[Mission, ...] = MISSIONS, lexicon: DataFrame | None = None) -> DataFrame:
    """(bibcode, mission) as ``missions_in_text`` with phrases, but a paper with a sentence of which no phrase tells whether it means a
    mission counts for those missions whose label its text holds as it is spelt. Bibcodes are unique. As in
    ``settled_sentences``, the rules are tried once; the labels in a text go along with its open sentences."""
    names = F.filter(F.array(*[F.lit(m.label) for m in missions]), lambda m: F.contains(text, m)).alias("names")
    spoken = _ruled(papers, text, missions, names).select("bibcode", "names", F.inline_outer(_spoken(F.col("r")))).where("mission IS NOT NULL")
    rows = materialise(spoken.withColumn("names", F.when(F.col("verdict").isNull(), F.col("names"))), "sentences")
    asked = rows.where("verdict IS NULL").drop("verdict")
    told = settle(asked, ["bibcode", "i"], missions, lexicon)
    both = asked.join(told, ["bibcode", "i", "mission"], "left").select("bibcode", "mission", "verdict", "names").unionByName(rows.where("verdict").select("bibcode", "mission", "verdict", "names"))
    per = both.groupBy("bibcode").agg(F.bool_or(F.col("verdict").isNull()).alias("failed"), F.collect_set(F.when(F.col("verdict"), F.col("mission"))).alias("found"), F.first("names", ignorenulls=True).alias("names"))
    return _each(per.select("bibcode", F.when(F.col("failed"), F.col("names")).otherwise(F.col("found")).alias("mission")))


def _anonymous(sentence: Column, mission: Mission) -> Column:
    """A sentence without the mission's terms; its last mark stays, which an acronym's dot would take along."""
    return F.concat(anonymise(F.regexp_replace(sentence, r"[.?!]+$", ""), mission), F.regexp_extract(sentence, r"[.?!]+$", 0))


def modified_by_mission(papers: DataFrame, text: Column, missions: tuple[Mission, ...] = MISSIONS, anon: bool = False, buffer: int = 0, undecided: bool | None = True) -> DataFrame:
    """(bibcode, mission, modif, modif_none): what ``modified_texts`` gives in the modes "none" and "anon", of all missions in one
    pass over the papers; only missions that a text holds have a row."""
    found = paragraphs(papers, text, buffer, missions, undecided)
    own = F.col("paragraph")
    now = reduce(lambda e, m: e.when(F.col("mission") == m.label, _anonymous(own, m)), missions, F) if anon else own
    made = found.select("bibcode", "mission", F.struct("lo", streamline(now).alias("m"), own.alias("p")).alias("x"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x[c]), "\n")
    return made.groupBy("bibcode", "mission").agg(joined("m").alias("modif"), joined("p").alias("modif_none"))


def modified_texts(papers: DataFrame, text: Column, mission: Mission, mode: str = "none", buffer: int = 0, undecided: bool | None = True, parser: Callable[[Column], Column] = grammar.parsed) -> DataFrame:
    """(bibcode, modif, modif_none) of every paper: a mission's paragraphs after the steps of ``mode``, and as they are, each
    joined by line breaks; empty where the text has none. Steps, joined by "_" and applied in this order: "skim", "trim",
    "anon", or "none"; then the text is streamlined. "trim" needs single sentences, so buffer 0. ``parser`` gives a sentence's parse
    (``functions.parse``) as a column."""
    steps = mode.split("_")
    if not set(steps) <= {"none", "skim", "trim", "anon"} or ("none" in steps and len(steps) > 1):
        raise ValueError(f"unknown mode {mode}")
    if "trim" in steps and buffer:
        raise ValueError("trim works on single sentences: buffer must be 0")
    found = paragraphs(papers, text, buffer, (mission,), undecided)
    now = F.col("paragraph")
    if {"skim", "trim"} & set(steps):
        found = parse.thinned(found.withColumn("__parse", parser(now)), F.col("__parse"), "__thin", grammar.importance_of(mission), set(steps))
        now = F.col("__thin")
    if "anon" in steps:
        now = _anonymous(now, mission)
    made = found.select("bibcode", "lo", streamline(now).alias("m"), F.col("paragraph").alias("p"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", c))), lambda x: x[c]), "\n")
    per = made.groupBy("bibcode").agg(joined("m").alias("modif"), joined("p").alias("modif_none"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return papers.select("bibcode").join(per, "bibcode", "left").select("bibcode", empty("modif"), empty("modif_none"))
