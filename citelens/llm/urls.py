"""URL filters as a sort-merge range join, in DataFrame operations only.

A host's canonical key is its labels reversed, each followed by a dot (``www.example.com`` -> ``com.example.www.``),
so the host of a rule and all its subdomains are the keys with the rule's key as a prefix: one interval of the sort
order. Two sorted sweeps follow.

1. Rule intervals (start and end events) and urls are merged by key. The running sum of starts minus ends is the
   height of the stack of nested intervals; the last start seen at each height is that level of the stack. Every url
   so gets the hosts of all rules that cover it.
2. Per covering host, the paths of its rules are intervals too (a prefix p spans [p, p + byte FF), as FF never occurs
   in UTF-8). The same sweep gives the innermost path rule: the last start at the current height.

Of a url's hits the longest rule (host plus path) wins, at equal length the longer host. Urls are dealt by a salt, and the rules
go to every salt, so no host, however frequent, lands in one task; the copies are rules x salts, not urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END, URL = 1, 0, 2  # at equal keys, ends come first, then starts, then urls


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as a table (verdict, host, path) from pairs such as ("block", "com/en/")."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit(r[len(r.partition("/")[0]):]).alias("path")) for v, r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end.
    Null or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")), "utf-8")


def filter_urls(
    df: DataFrame, rules: DataFrame, id_cols: list[str], url_col: str = "url", default: str = "allow", salts: int | None = None
) -> DataFrame:
    """``id_cols`` and host, path, rule, verdict of each row of ``df``: one output row per input row.

    rules: (verdict, host, path), any number; host '' fits nothing; a null verdict, host or path drops the rule; of two
    rules with one host and path, "block" wins. Urls that no rule fits have a null rule and the verdict ``default``.
    A null or malformed url has an empty host and path, so the default. Repeated rows stay repeated. Other columns of
    ``df`` are not read; internal names start with two underscores, so an input's host, path, rule or verdict columns
    do not clash; among ``id_cols`` such a column is replaced by the result. Every rule goes to each salt: the rules' rows are
    multiplied by ``salts`` (twice the shuffle partitions), whatever the number of urls.
    """
    id_cols = [c for c in id_cols if c not in ("host", "path", "rule", "verdict")]
    spark = df.sparkSession
    salts = salts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col).cast("string"))
    ids = F.struct(*([F.col(c) for c in id_cols] or [F.lit(0).alias("__none")])).alias("__ids")
    urls = df.select(ids, host.alias("host"), path.alias("path")).select(
        "__ids", "host", "path", F.monotonically_increasing_id().alias("__row")
    )
    urls = urls.withColumn("__salt", F.pmod(F.xxhash64("__row", "host", "path"), F.lit(salts)).cast("int"))
    rules = (
        rules.dropna(subset=["verdict", "host", "path"])
        .select("verdict", _lower(F.col("host")).alias("host"), "path")
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block > allow
        .select(host_key(F.col("host")).alias("__h"), "host", "path", "verdict")
    )
    each_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")
    hosts = rules.select("__h").distinct()
    # A rule's host nests at most as deep as it has labels: small and known before the sweep is planned.
    levels = hosts.agg(F.max(F.length(F.decode("__h", "utf-8")) - F.length(F.replace(F.decode("__h", "utf-8"), F.lit("."))))).first()[0] or 0

    # First sweep: the stack of rule hosts over each url's host.
    none = F.lit(None)
    ends = F.expr("concat(substring(__h, 1, length(__h) - 1), X'2F')")  # '/' follows '.', so this ends the prefix
    events = hosts.select("__h", each_salt).select(
        "__salt", F.inline(F.array(
            F.struct(F.col("__h").alias("__key"), F.lit(START).alias("__kind"), F.col("__h").alias("__at")),
            F.struct(ends.alias("__key"), F.lit(END).alias("__kind"), none.cast("binary").alias("__at")),
        ))
    )
    events = events.select("__salt", "__key", "__kind", "__at", none.cast(urls.schema["__ids"].dataType).alias("__ids"), none.cast("long").alias("__row"), none.cast("string").alias("host"), none.cast("string").alias("path"))
    merged = events.unionByName(urls.select("__salt", host_key(F.col("host")).alias("__key"), F.lit(URL).alias("__kind"), none.cast("binary").alias("__at"), "__ids", "__row", "host", "path"))
    so_far = W.partitionBy("__salt").orderBy("__key", "__kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    height = F.sum(F.when(F.col("__kind") == START, 1).when(F.col("__kind") == END, -1).otherwise(0)).over(so_far)
    swept = merged.withColumn("__depth", height)
    stack = [F.last(F.when((F.col("__kind") == START) & (F.col("__depth") == k), F.col("__at")), ignorenulls=True).over(so_far) for k in range(1, levels + 1)]
    swept = swept.select("*", *[s.alias(f"__s{k}") for k, s in enumerate(stack, 1)]).where(F.col("__kind") == URL)
    covering = F.filter(F.array(*[F.when(F.col("__depth") >= k, F.col(f"__s{k}")) for k in range(1, levels + 1)]) if levels else F.array(none.cast("binary")), lambda h: h.isNotNull())
    hit = swept.select("__salt", "__ids", "__row", "host", "path", F.explode_outer(covering).alias("__h"))

    # Second sweep: per covering host, the innermost rule by path.
    start = F.encode("path", "utf-8")
    events = rules.select("*", each_salt).select(
        "__salt", "__h", F.inline(F.array(
            F.struct(start.alias("__key"), F.lit(START).alias("__kind"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")).alias("__at")),
            F.struct(F.expr("concat(encode(path, 'utf-8'), X'FF')").alias("__key"), F.lit(END).alias("__kind"), none.cast("struct<n:int,h:int,rule:string,verdict:string>").alias("__at")),
        ))
    )
    events = events.select("__salt", "__h", "__key", "__kind", "__at", none.cast(urls.schema["__ids"].dataType).alias("__ids"), none.cast("long").alias("__row"), none.cast("string").alias("host"), none.cast("string").alias("path"))
    at_type = events.schema["__at"].dataType
    merged = events.unionByName(hit.select("__salt", "__h", start.alias("__key"), F.lit(URL).alias("__kind"), none.cast(at_type).alias("__at"), "__ids", "__row", "host", "path"))
    so_far = W.partitionBy("__salt", "__h").orderBy("__key", "__kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = merged.withColumn("__depth", F.sum(F.when(F.col("__kind") == START, 1).when(F.col("__kind") == END, -1).otherwise(0)).over(so_far))
    level = W.partitionBy("__salt", "__h", "__depth").orderBy("__key", "__kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    top = F.last(F.when(F.col("__kind") == START, F.col("__at")), ignorenulls=True).over(level)
    found = merged.withColumn("__top", top).where(F.col("__kind") == URL).withColumn("__top", F.when(F.col("__depth") > 0, F.col("__top")))
    best = found.groupBy("__salt", "__row", "__ids", "host", "path").agg(F.max("__top").alias("__best"))
    return best.select(
        *[F.col("__ids").getField(c).alias(c) for c in id_cols], "host", "path", F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
