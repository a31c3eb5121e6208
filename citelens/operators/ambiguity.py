"""Whether an ambiguous word means its mission, decided by joins: chunks of words, their meanings, and a table of phrases.

1. Words of the sentences that rules leave open are rows. Neighbouring nouns, adjectives, numbers and possessives around a
   word that names the mission are a chunk (gaps and islands).
2. A chunk's meaning is the roots of its words. A lexicon, a table (word, roots) that the caller gives, is joined by word; words
   it lacks stand for themselves in the singular.
3. The phrase table is an inverted index: each phrase is filed under its rarest root. An equi-join on the words of the meaning
   gives the few phrases that may match, and only these are tried. Exact matches go before those of roots, short ones before
   long ones, earlier phrases before later ones.
4. A sentence means the mission if one of its chunks does; it is null if no chunk meets a phrase.

The phrase table is of fixed size and broadcast; everything else is grouped by sentence. Equal sentences are decided once.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ambiguity import PHRASES
from ..functions.nlp import NUMBER
from ..functions.registry import MISSIONS, Mission
from ..functions.words import core, names_mission, singular, tagged

INNER = ("NOUN", "ADJ", "NUM", "POSS")
ANY = "AnyMission"
Phrase = tuple[str, str, bool]


def _meant(rows: DataFrame, missions: tuple[Mission, ...], lexicon: DataFrame | None) -> DataFrame:
    """Adds ``roots``, an array, to rows (word, ...): what the word contributes to a meaning."""
    rows = rows.withColumn("core", core(F.col("word"), missions)).withColumn("low", F.lower("word"))
    own = F.array(F.coalesce("core", singular(F.col("word"))))
    if lexicon is None:
        return rows.withColumn("roots", own).drop("core", "low")
    known = lexicon.groupBy(F.lower("word").alias("low")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("roots")))).alias("known"))
    joined = rows.join(known, "low", "left")
    return joined.withColumn("roots", F.when(F.col("core").isNull() & (F.size("known") > 0), F.col("known")).otherwise(own)).drop("core", "low", "known")


def chunks(sentences: DataFrame, keys: list[str], missions: tuple[Mission, ...], lexicon: DataFrame | None = None, words: Column | None = None,
           every: tuple[Mission, ...] = MISSIONS, brackets: bool = False, verbs: bool = False, important: Column | None = None) -> DataFrame:
    """(keys, at, text, meaning) of rows (keys, mission, sentence): each chunk of words around one that names the row's mission,
    with the place of its first word, its words and the roots of its words, parted by spaces. ``keys`` and the mission tell rows apart.

    ``words``: array<struct<text, pos>> of the sentence, by default ``tagged``. A chunk grows over nouns, adjectives, numbers,
    possessives, hyphens, slashes and words that name the mission; with ``brackets`` over brackets, with ``verbs`` over verbs to the
    right of a name, and over words for which ``important``, a column of "word", holds."""
    keys = list(dict.fromkeys([*keys, "mission"]))
    tokens = sentences.select(*keys, F.posexplode(words if words is not None else tagged(F.col("sentence"))).alias("__i", "__t"))
    tokens = tokens.select(*keys, "__i", F.col("__t.text").alias("word"), F.col("__t.pos").alias("pos"))
    own = F.coalesce(*[F.when(F.col("mission") == m.label, names_mission(F.col("word"), (m,)).isNotNull()) for m in missions], F.lit(False))
    inner = F.col("pos").isin(*INNER) | F.col("word").isin("-", "/") | F.col("own")
    if brackets:
        inner = inner | F.col("word").isin(*"()[]{}")
    if important is not None:
        inner = inner | important
    tokens = tokens.withColumn("own", own).withColumn("inner", inner)
    if verbs:  # a verb goes on with a chunk that has a name to its left already
        order = W.partitionBy(*keys).orderBy("__i")
        gap = ~F.col("inner") & (F.col("pos") != "VERB")
        run = F.sum(gap.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        named = F.max("own").over(W.partitionBy(*keys, "run").orderBy("__i").rowsBetween(W.unboundedPreceding, -1))
        tokens = tokens.withColumn("run", run).withColumn("inner", F.col("inner") | ((F.col("pos") == "VERB") & F.coalesce(named, F.lit(False)))).drop("run")
    island = F.col("__i") - F.row_number().over(W.partitionBy(*keys).orderBy("__i"))
    members = tokens.where("inner").withColumn("island", island)
    members = members.withColumn("named", F.max("own").over(W.partitionBy(*keys, "island"))).where("named")
    # Marks and possessives belong to a chunk's words, not to its meaning.
    means = _meant(members, every, lexicon).withColumn("roots", F.when(F.col("pos").isin("PUNCT", "POSS"), F.array().cast("array<string>")).otherwise(F.col("roots")))
    whole = F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), "word", "pos", "roots")))
    grouped = means.groupBy(*keys, "island").agg(whole.alias("w"))
    spoken = F.filter("w", lambda x: x["pos"] != "POSS")
    return grouped.select(*keys, F.col("w")[0]["i"].alias("at"), F.array_join(F.transform(spoken, lambda x: x["word"]), " ").alias("text"),
                          F.array_join(F.flatten(F.transform("w", lambda x: x["roots"])), " ").alias("meaning"))


def phrase_index(spark: SparkSession, missions: tuple[Mission, ...] = MISSIONS, lexicon: DataFrame | None = None, phrases: list[Phrase] = PHRASES) -> DataFrame:
    """(mission, root, form, ord, pattern, verdict): the phrases of each mission with ambiguous words, in their exact form (0) and by
    the roots of their words (1), filed under the rarest word or root. Bounded by the phrases; without a lexicon built once."""
    rows = _filed(spark, missions, None, tuple(phrases)) if lexicon is None else _file(spark, missions, lexicon, tuple(phrases))
    return spark.createDataFrame(rows, "mission string, root string, form int, ord int, pattern string, verdict boolean")


def _file(spark: SparkSession, missions: tuple[Mission, ...], lexicon: DataFrame | None, phrases: tuple[Phrase, ...]) -> list[tuple]:
    ambiguous = [m for m in missions if m.ambiguous]
    spread = [(m.label, n, text.replace(ANY, m.name.lower()), verdict) for n, (who, text, verdict) in enumerate(phrases) for m in ambiguous if who == ANY or who.lower() == m.name.lower()]
    rows = spark.createDataFrame(spread, "mission string, ord int, text string, verdict boolean")
    words = rows.select("mission", "ord", F.posexplode(tagged(F.col("text"))).alias("i", "t")).where("t.pos <> 'PUNCT'").select("mission", "ord", "i", F.col("t.text").alias("word"))
    listed = _meant(words, missions, lexicon).groupBy("mission", "ord").agg(F.array_sort(F.collect_list(F.struct("i", "roots"))).alias("w")).collect()
    roots = {(r.mission, r.ord): [x.roots for x in r.w] for r in listed}
    entries = []
    for label, n, text, verdict in spread:
        groups = roots.get((label, n), [])
        spaced = r" (?:\w+ )*".join(r"\b(?:" + "|".join(re.escape(x) for x in g) + r")\b" for g in groups)
        entries.append((label, n, 0, rf"\b{re.escape(text)}\b", verdict, [[x] for x in _pieces(text)]))
        entries.append((label, n, 1, spaced, verdict, [sorted({p for x in g for p in _pieces(x)[:1]}) for g in groups]))
    often: dict[str, int] = {}
    for e in entries:
        for p in {p for g in e[5] for p in g}:
            often[p] = often.get(p, 0) + 1
    return [(e[0], p, e[2], e[1], f"(?iU){e[3]}", e[4]) for e in entries for p in min((g for g in e[5] if g), key=lambda g: (max(often[p] for p in g), g), default=[])]


_filed = lru_cache(maxsize=4)(_file)


def _pieces(text: str) -> list[str]:
    return [p for p in re.split(r"\W+", text.lower()) if p]


def chunk_verdicts(found: DataFrame, keys: list[str], index: DataFrame, missions: tuple[Mission, ...] = MISSIONS) -> DataFrame:
    """(keys, mission, at, verdict, phrase) of chunks: the bare ambiguous word and another term of the mission mean it; else the best
    phrase decides (``phrase``: its place in the table); null if none matches."""
    keys = list(dict.fromkeys([*keys, "mission"]))
    bare = F.lit(False)
    for m in missions:
        if m.ambiguous:
            plain = [p.lower() for p in m.phrases + m.cased + m.uncased]
            bare = F.when(F.col("mission") == m.label, F.lower("text").isin([a.lower() for a in m.ambiguous]) | F.replace(F.lower("text"), F.lit("."), F.lit("")).isin(plain)).otherwise(bare)
    parts = F.array_distinct(F.filter(F.split(F.lower("meaning"), r"(?U)\W+"), lambda p: p != ""))
    tried = found.select(*keys, "at", "meaning", bare.alias("bare"), F.explode_outer(F.when(~bare, parts)).alias("root"))
    size = F.length(F.call_function("regexp_extract", F.col("meaning"), F.col("pattern"), F.lit(0)))
    hits = tried.join(F.broadcast(index), ["mission", "root"], "left").withColumn("size", size)
    best = hits.groupBy(*keys, "at").agg(F.max("bare").alias("bare"), F.min(F.when(F.col("size") > 0, F.struct("form", "size", "ord", "verdict"))).alias("b"))
    return best.select(*keys, "at", F.when(F.col("bare"), True).otherwise(F.col("b.verdict")).alias("verdict"), F.col("b.ord").alias("phrase"))


def settle(asked: DataFrame, keys: list[str], missions: tuple[Mission, ...] = MISSIONS, lexicon: DataFrame | None = None, phrases: list[Phrase] = PHRASES) -> DataFrame:
    """(keys, mission, verdict) of rows (keys, mission, sentence) that rules leave open, where a phrase or the bare word tells. Keys and
    mission have one sentence each; repeated rows count once."""
    masked = F.col("sentence")
    for m in missions:
        for phrase in m.banned:
            masked = F.when(F.col("mission") == m.label, F.regexp_replace(masked, f"(?i){phrase}", "#" * len(phrase))).otherwise(masked)
    one = asked.select(*keys, "mission", "sentence").dropDuplicates([*keys, "mission"]).withColumn("sentence", F.regexp_replace(masked, r"(?U)-\b\d+\b", f"-{NUMBER}"))
    found = chunks(one, keys, tuple(m for m in missions if m.ambiguous), lexicon, every=missions)
    told = chunk_verdicts(found, keys, phrase_index(asked.sparkSession, missions, lexicon, phrases), missions)
    return told.where("verdict IS NOT NULL").groupBy(*keys, "mission").agg(F.bool_or("verdict").alias("verdict"))


def decide(rows: DataFrame, verdict: Column, missions: tuple[Mission, ...] = MISSIONS, lexicon: DataFrame | None = None, phrases: list[Phrase] = PHRASES) -> DataFrame:
    """Adds ``verdict`` to rows (mission, sentence, ...): by rules where they tell (a column, null where they do not), else by
    phrases, else null. Only open sentences are shuffled, and equal ones are decided once."""
    first = rows.withColumn("verdict", verdict).withColumn("__key", F.when(F.col("verdict").isNull(), key_of(F.col("sentence"))))
    told = settle(first.where("verdict IS NULL AND sentence IS NOT NULL"), ["__key"], missions, lexicon, phrases).withColumnRenamed("verdict", "__told")
    return first.join(told, ["mission", "__key"], "left").withColumn("verdict", F.coalesce("verdict", "__told")).drop("__key", "__told")


def key_of(sentence: Column) -> Column:
    return F.md5(sentence)
