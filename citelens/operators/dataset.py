"""Dataset assembly: joins of texts and labels, flattening, deduplication, leak-free splits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.registry import MISSIONS, Mission
from ..functions.text import mentions
from .batching import ordinals
from .ranges import range_of, starts

TEXT_KEYS = ["abstract", "author", "bibcode", "body", "keyword", "keyword_norm", "pubdate", "title"]


def trim(df: DataFrame, keys: list[str] = TEXT_KEYS) -> DataFrame:
    """Only the listed columns, in the table's order."""
    return df.select([c for c in df.columns if c in keys])


def date_range(df: DataFrame) -> DataFrame:
    """One row: number of papers, first and last pubdate (as strings: a day may be 00)."""
    return df.agg(F.count("*").alias("n"), F.min("pubdate").alias("first"), F.max("pubdate").alias("last"))


def duplicates(df: DataFrame, key: str = "bibcode") -> DataFrame:
    """(key, count) of keys that repeat."""
    return df.groupBy(key).agg(F.count("*").alias("count")).where("count > 1")


def assert_unique(df: DataFrame, key: str = "bibcode") -> DataFrame:
    if (found := duplicates(df, key).limit(3).collect()):
        raise ValueError(f"duplicate {key}: {[r[0] for r in found]}")
    return df


def combine(texts: DataFrame, track: DataFrame) -> DataFrame:
    """Texts with labels: class_missions as a map mission -> (bibcode, papertype), is_ignored as a map of search keys. Of a
    mission or key listed twice the last counts."""
    last = lambda a: F.map_from_entries(F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["key"] == x["key"])))
    classes = F.transform("class_missions", lambda c: F.struct(c["mission"].alias("key"), F.struct(F.col("bibcode"), c["paper_type"].alias("papertype")).alias("value")))
    ignored = F.transform("searches", lambda s: F.struct(F.concat(F.lit("is_ignored_"), s["search_key"]).alias("key"), s["ignored"].alias("value")))
    labels = track.select("bibcode", classes.alias("__c"), ignored.alias("__i"))
    return texts.join(labels, "bibcode").withColumns({"class_missions": last(F.col("__c")), "is_ignored": last(F.col("__i"))}).drop("__c", "__i")


def only_in(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``left`` (the given columns, distinct) whose bibcode ``right`` lacks."""
    return left.join(right.select("bibcode").distinct(), "bibcode", "left_anti").select(columns).distinct()


def first_per_paper(df: DataFrame, order: str = "ord") -> DataFrame:
    """Of each bibcode the first row by order."""
    w = W.partitionBy("bibcode").orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def mission_of(name: Column, missions: tuple[Mission, ...] = MISSIONS) -> Column:
    """Registry name of the first mission whose expressions match the given name."""
    return F.coalesce(*[F.when(mentions(name, m), m.name) for m in missions])


def flatten(papers: DataFrame, labels: DataFrame, papertypes: list[str], missions: tuple[Mission, ...] = MISSIONS) -> DataFrame:
    """One row per label of an allowed type of papers with a text: (ord, bibcode, text, class, mission, i_mission, id).
    Repeats of a bibcode are dropped first. i_mission counts within a paper."""
    first = first_per_paper(papers).where(F.col("body").isNotNull())
    kept = labels.where(F.col("papertype").isin(papertypes)).select("bibcode", F.col("mission").alias("label"), F.col("papertype").alias("class"))
    rows = first.join(kept, "bibcode").withColumn("mission", mission_of(F.col("label"), missions)).where("mission IS NOT NULL")
    w = W.partitionBy("bibcode").orderBy("mission", "class")
    rows = rows.withColumn("i_mission", F.row_number().over(w) - 1)
    return rows.select("ord", "bibcode", F.col("body").alias("text"), "class", "mission", "i_mission", F.concat_ws("_", "ord", "i_mission").alias("id"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds i_track, the number from 0 of a row's paper among the papers of the table, in their order."""
    per = ordinals(rows.select("ord", "bibcode").distinct())
    return rows.join(per.select("ord", "bibcode", F.col("number").alias("i_track")), ["ord", "bibcode"])


def require_rows(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, or an error if they are fewer than asked for; at most n rows are read for it."""
    if (found := rows.limit(n).count()) < n:
        raise ValueError(f"{found} rows where {n} were asked for")
    return rows


def limit_papers(rows: DataFrame, n: int) -> DataFrame:
    """Whole papers in order until ``n`` rows are reached: a paper stays if fewer than n rows precede it.

    The running sum is over sums of ranges of ord, so no task sees more than a range's papers or all range sums.
    """
    per = rows.groupBy("ord", "bibcode").agg(F.count("*").alias("rows"))
    per = per.withColumn("block", range_of(per, "ord"))
    own = F.coalesce(F.sum("rows").over(W.partitionBy("block").orderBy("ord", "bibcode").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = F.broadcast(starts(per, "block", {"start": F.sum("rows")}))
    kept = per.withColumn("own", own).join(before, "block").where(F.col("start") + F.col("own") < n).select("ord", "bibcode")
    return rows.join(kept, ["ord", "bibcode"], "left_semi")


def split_order(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("bibcode").cast("string")))


def _ranked(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with ``k``, their number from 1 within the key in hashed order. A key may hold most rows: they are numbered by
    ranges of the hash, each starting where the ranges before it end."""
    ordered = rows.withColumn("__o", split_order(seed)).withColumn("__b", F.substring("__o", 1, 4))
    ranges = ordered.groupBy(key, "__b").agg(F.count("*").alias("__n"))
    before = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    first = ranges.select(key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    within = F.row_number().over(W.partitionBy(key, "__b").orderBy("__o", "bibcode"))
    return ordered.withColumn("__w", within).join(first, [key, "__b"]).withColumn("k", F.col("__s") + F.col("__w")).drop("__o", "__b", "__s", "__w")


#: Papers of several classes are folded by ranges of the hash: about this many a range, and at most so many ranges.
RANGE_ROWS, MOST_RANGES = 50_000, 4096


def fold_levels(members: list[tuple[int, ...]], entry: list[int]) -> list[int]:
    """Which class each paper goes to, in order: the smallest of its classes so far, the first of them at a tie."""
    counts, picks = list(entry), []
    for classes in members:
        best = min(classes, key=lambda c: (counts[c], c))
        counts[best] += 1
        picks.append(best)
    return picks


def _entries(ranges: DataFrame, fold, start: list[int], sizes: dict[int, int]) -> dict[int, list[int]]:
    """The counts that each range starts from. All ranges are folded at once from guessed counts and again where what the
    ranges before them gave differs from the guess, until nothing does. A pass settles at least the first range that was
    wrong, and mostly all: from counts of the same total, levelling soon comes to the same counts."""
    order = sorted(sizes)
    guess, at = {}, 0
    for r in order:
        low, each = sum(start) + at, list(start)
        for c in sorted(range(len(start)), key=lambda c: start[c]):  # as if the lowest classes were filled up evenly
            each[c] = max(each[c], low // len(start))
        each[start.index(min(start))] += low - sum(each)
        guess[r], at = each, at + sizes[r]
    guess[order[0]] = list(start)
    given: dict[int, list[int]] = {}
    stale = set(order)
    ranges = ranges.persist()
    try:
        while stale:
            picked = fold(ranges.where(F.col("range").isin(sorted(stale))), {r: guess[r] for r in stale})
            for r, c, n in picked.select("range", F.explode("picks").alias("c")).groupBy("range", "c").count().collect():
                if r in stale:
                    given[r], stale = [0] * len(start), stale - {r}
                given[r][c] = n
            now, stale = list(start), set()
            for r in order:
                if guess[r] != now:
                    guess[r] = list(now)
                    stale.add(r)
                now = [a + b for a, b in zip(now, given[r], strict=True)]
    finally:
        ranges.unpersist()
    return guess


def levelled(papers: DataFrame, counts: dict[str, int], n: int, seed: int = 10, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(bibcode, class) of ``n`` papers (bibcode, classes: sorted array): in hashed order each goes to the smallest of its
    classes so far, by name at a tie; ``counts`` is what every class has before.

    Only the counts of ranges, of which there are at most MOST_RANGES, reach the driver."""
    names = sorted(counts)
    place = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    parts = max(1, min(MOST_RANGES, -(-n // range_rows)))
    own = papers.select("bibcode", F.transform("classes", lambda c: place[c]).alias("members"), split_order(seed).alias("o"))
    own = own.withColumn("range", F.shiftright(F.conv(F.substring("o", 1, 8), 16, 10).cast("long") * parts, 32).cast("int"))
    ranges = own.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("o", "bibcode", "members"))).alias("rows")).select("range", F.col("rows.bibcode").alias("ids"), F.col("rows.members").alias("members"))
    start = [counts[c] for c in names]

    def fold(rows: DataFrame, entry: dict[int, list[int]]) -> DataFrame:
        def run(batches):
            for b in batches:
                found = zip(b.column("range").to_pylist(), b.column("members").to_pylist(), strict=True)
                picks = [fold_levels(members, entry[r]) for r, members in found]
                yield pa.RecordBatch.from_arrays([b.column("range"), b.column("ids"), pa.array(picks, pa.list_(pa.int32()))], names=["range", "ids", "picks"])

        return rows.mapInArrow(run, f"range int, ids {rows.schema['ids'].dataType.simpleString()}, picks array<int>")

    entry = {0: start}
    if parts > 1:
        sizes = {r["range"]: r["n"] for r in own.groupBy("range").agg(F.count("*").alias("n")).collect()}
        entry = _entries(ranges, fold, start, sizes)
    picked = fold(ranges, entry).select(F.explode(F.arrays_zip("ids", "picks")).alias("p"))
    return picked.select(F.col("p.ids").alias("bibcode"), F.array(*[F.lit(c) for c in names])[F.col("p.picks")].alias("class"))


def tvt_split(labels: DataFrame, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), mode: str = "uniform", seed: int = 10, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(bibcode, class, split): all rows of a bibcode share one split.

    A bibcode of one class is represented by it. Those of several go, one by one in hashed order, to the smallest of their
    classes so far (``levelled``). Then each class is ordered by hash and sliced. "uniform": every class gives round(fraction x
    smallest class) to train and validate, the rest to test; "available": each class by its own count, an error if the roundings
    do not sum to it.
    """
    if mode not in ("uniform", "available"):
        raise ValueError(f"unknown mode {mode}")
    total = sum(fractions)
    share = [f / total for f in fractions]
    per = labels.groupBy("bibcode").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    sets = [(list(r["classes"]), r["n"]) for r in per.groupBy("classes").agg(F.count("*").alias("n")).collect()]
    counts = {c: 0 for classes, _ in sets for c in classes} | {classes[0]: n for classes, n in sets if len(classes) == 1}
    rep = per.where(F.size("classes") == 1).select("bibcode", F.col("classes")[0].alias("class"))
    if several := sum(n for classes, n in sets if len(classes) > 1):
        picked = levelled(per.where(F.size("classes") > 1), counts, several, seed, range_rows)
        rep = rep.unionByName(picked)
        for r in picked.groupBy("class").agg(F.count("*").alias("n")).collect():
            counts[r["class"]] += r["n"]
    least = min(counts.values(), default=0)
    split = F.lit("test")
    for c, n in counts.items():
        train, validate, test = (round(s * (least if mode == "uniform" else n)) for s in share)
        if mode == "available" and train + validate + test != n:
            raise ValueError(f"fractions do not divide class {c} of {n}")
        split = F.when((F.col("class") == c) & (F.col("k") <= train), "train").when((F.col("class") == c) & (F.col("k") <= train + validate), "validate").otherwise(split)
    return _ranked(rep, "class", seed).select("bibcode", "class", split.alias("split"))


def truth_table(bibcodes: DataFrame, labels: DataFrame, missions: list[str], rejection: str = "rejection") -> DataFrame:
    """(bibcode, mission, class) for every paper and registered mission; missions without a label get the rejection class."""
    grid = bibcodes.select("bibcode").distinct().select("bibcode", F.explode(F.array(*[F.lit(m) for m in missions])).alias("mission"))
    own = labels.groupBy("bibcode", "mission").agg(F.min("papertype").alias("class"))
    return grid.join(own, ["bibcode", "mission"], "left").select("bibcode", "mission", F.coalesce("class", F.lit(rejection)).alias("class"))
