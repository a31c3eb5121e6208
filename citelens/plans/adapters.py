"""Domain-shaped tables derived from the generic driver tables, for Spark and as SQL common table expressions.

The generic documents name no mission, so each paper's body ends in one of a list of probe sentences; labels become human
labels and repeated classification runs by plain arithmetic on doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import LABELS
from ..functions.text import let
from ..sources.files import spread

PROBES = [
    "We used that H S-T data in our work. The dog left the house.", "It shows that H.S T data. Fig. 4 shows the red vs. blue stars.",
    "These are HST FGS data.", "We rely on that Kepler K2 mission. They did not.", "This uses that Kepler and K2 data.",
    "Here is that OAO 3 data. OAO-3 was early.", "We observed with VLA-FIRST in 2003.", "Data of Pan-STARRS-1 were used.", "A Keplerian velocity is shown in Figure 3.",
    "We saw that HcST data and that A.H.S.T.M. data.", "No LHST data; that K23 data, that AK2 data and that K 2 star.",
    "The Hubble Space Telescope saw it. (According to us.) Hubble images are fine [see below]. James Webb Space Telescope data follow.",
    "The JWST spectra (NIRSpec) are new. TESS light curves too. GALEX and FUSE are not used!",
    "Blue et al. (2023) published the raw spectra already. Somename (2013) published  in SJ.", "Also Author papers (Author et al. 1997, 2023), are cited.",
    "The poetry... It was beautiful (according to the audience.). We agree , ( mostly ) .", "Copernicus satellite data and the Copernicus model differ. Roman numerals are not Roman Space Telescope data.",
    "The Transiting Exoplanet Survey Satellite (TESS) found it. It has a table, i.e. Tab. 2. IUE was first? WUPPE was not. EUVE was.",
]


def _array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("text", F.lit("\n"), _pick(PROBES, F.col("doc_id")))
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(F.col("doc_id").alias("bibcode"), F.col("doc_id").alias("ord"), F.array("source").alias("title"), F.lit(None).cast("string").alias("abstract"), body.alias("body"))


PAPERS = f"""papers AS (SELECT doc_id AS bibcode, doc_id AS ord, source AS title,
  text || chr(10) || ({_array(PROBES)})[CAST(doc_id % {len(PROBES)} AS INTEGER) + 1] AS body FROM documents)"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SCIENCE").when((F.col("quality") == 1) & (F.col("toxic") == 1), "MENTION").when(F.col("toxic") == 0, "SUPERMENTION").otherwise("DATA_INFLUENCED")
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("bibcode"), _pick(LABELS, F.col("doc_id")).alias("mission"), kind.alias("papertype"))


TRACK = f"""track AS (SELECT doc_id AS bibcode, ({_array(LABELS)})[CAST(doc_id % {len(LABELS)} AS INTEGER) + 1] AS mission,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'SCIENCE' WHEN quality = 1 AND toxic = 1 THEN 'MENTION' WHEN toxic = 0 THEN 'SUPERMENTION' ELSE 'DATA_INFLUENCED' END AS papertype FROM labels)"""


def several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of papers with one to three missions: every third has a second one of another type, every sixth repeats the first."""
    one = track(spark, sf_dir)
    b = F.col("bibcode")
    second = one.where(b % 3 == 0).select("bibcode", _pick(LABELS, b + 5).alias("mission"), F.when(F.col("papertype") == "SCIENCE", "MENTION").otherwise("SCIENCE").alias("papertype"))
    return one.unionByName(second).unionByName(one.where(b % 6 == 0))


SEVERAL = TRACK + f""", several AS (SELECT * FROM track UNION ALL SELECT bibcode, ({_array(LABELS)})[CAST((bibcode + 5) % {len(LABELS)} AS INTEGER) + 1], CASE WHEN papertype = 'SCIENCE' THEN 'MENTION' ELSE 'SCIENCE' END FROM track WHERE bibcode % 3 = 0
  UNION ALL SELECT * FROM track WHERE bibcode % 6 = 0)"""


def track_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As (bibcode, searches, class_missions)."""
    return track(spark, sf_dir).select("bibcode", F.array(F.struct(F.lower("mission").alias("search_key"), (F.col("bibcode") % 2 == 0).alias("ignored"))).alias("searches"), F.array(F.struct("mission", F.col("papertype").alias("paper_type"))).alias("class_missions"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs per labelled paper; of every eleven (paper + run) one failed."""
    d, r = F.col("bibcode"), F.col("run")
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("bibcode"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run"))
    ok = (d + r) % 11 != 0
    science = ((d * 31 + r * 17) % 21).cast("double") / F.lit(20.0)
    mission = _pick(LABELS, d + F.when((d * 7 + r * 3) % 5 == 0, 1).otherwise(0))
    call = F.struct(mission.alias("mission"), F.when(science >= 0.5, "SCIENCE").otherwise("MENTION").alias("papertype"), F.array(science, 1 - science).alias("confidence"))
    return rows.select("bibcode", "run", F.when(~ok, "failed").alias("error"), F.when(ok, F.array(call)).alias("missions"))


CALLS = f"""calls AS (SELECT *, 1 - conf_science AS conf_mention, CASE WHEN conf_science >= 0.5 THEN 'SCIENCE' ELSE 'MENTION' END AS papertype FROM (
  SELECT doc_id AS bibcode, run, CAST((doc_id * 31 + run * 17) % 21 AS DOUBLE) / CAST(20 AS DOUBLE) AS conf_science,
  ({_array(LABELS)})[CAST((doc_id + CASE WHEN (doc_id * 7 + run * 3) % 5 = 0 THEN 1 ELSE 0 END) % {len(LABELS)} AS INTEGER) + 1] AS mission
  FROM labels, (SELECT unnest([0, 1, 2, 3, 4]) AS run) WHERE (doc_id + run) % 11 <> 0))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a submission log: chunk, time, tokens."""
    return read(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("chunk"), F.col("ts"), (F.col("event_id") % 1000 + 1).alias("tokens"), F.concat(F.lit("b"), F.col("event_id") % 700).alias("batch_id"))


LOG = "log AS (SELECT event_id % 500 AS chunk, ts, event_id % 1000 + 1 AS tokens, 'b' || (event_id % 700) AS batch_id FROM events)"


_STATUSES = ["submitted", "validating", "in_progress", "in_progress", "in_progress", "finalizing", "completed", "in_progress", "failed", "in_progress", "cancelled"]


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status reports of submitted batches, three or four of each."""
    return read(spark, sf_dir, "events").select(F.concat(F.lit("b"), (F.col("event_id") / 4).cast("long")).alias("batch_id"), "ts", _pick(_STATUSES, F.col("event_id") * 7 + F.col("user_id")).alias("status"))


BATCH_EVENTS = f"ev AS (SELECT 'b' || (event_id // 4) AS batch_id, ts, ({_array(_STATUSES)})[CAST((event_id * 7 + user_id) % {len(_STATUSES)} AS INTEGER) + 1] AS status FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines of a batch file."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("line"))


LINES = "lines AS (SELECT page_id AS ord, url AS line FROM pages)"


# Labels (part of speech, tag, dependency) dealt to words by arithmetic, as a parser's output in form: every word class, with chains of
# conjuncts, subjects, objects, clauses and auxiliaries at every depth.
PARSE_LABELS = [
    ("PROPN", "NNP", "nsubj"), ("NOUN", "NN", "dobj"), ("NOUN", "NNS", "pobj"), ("NOUN", "NN", "conj"), ("VERB", "VBD", "conj"), ("VERB", "VBZ", "advcl"), ("VERB", "VBN", "acl"),
    ("VERB", "VBG", "amod"), ("VERB", "VB", "ccomp"), ("ADJ", "JJ", "amod"), ("ADV", "RB", "advmod"), ("DET", "DT", "det"), ("PRON", "PRP", "nsubj"), ("PRON", "WDT", "nsubj"),
    ("ADP", "IN", "prep"), ("PART", "TO", "aux"), ("AUX", "MD", "aux"), ("AUX", "VBZ", "auxpass"), ("CCONJ", "CC", "cc"), ("SCONJ", "IN", "mark"), ("NUM", "CD", "nummod"),
    ("PUNCT", ".", "punct"), ("PART", "RB", "neg"), ("PROPN", "NNP", "appos"), ("X", "FW", "X"), ("PUNCT", "-LRB-", "punct"), ("PART", "POS", "case"), ("AUX", "IN", "aux"), ("ADJ", "JJ", "advmod"),
]
ROOT_LABELS = [("VERB", "VBD"), ("AUX", "VBZ"), ("NOUN", "NN")]


def parse(sentence: Column) -> Column:
    """A dependency tree over a sentence's words: the middle word is the root, every other word hangs on one nearer to it."""
    words = F.filter(F.split(sentence, " "), lambda w: w != "")

    def tree(ws: Column) -> Column:
        n = F.size(ws)
        r = F.floor(n / 2).cast("int")

        def one(w: Column, i: Column) -> Column:
            head = F.when(i == r, i).when(i < r, i + 1 + F.length(w) % F.greatest(r - i, F.lit(1))).otherwise(i - 1 - F.length(w) % F.greatest(i - r, F.lit(1)))
            label = lambda k: F.get(F.array(*[F.lit(x[k]) for x in PARSE_LABELS]), (F.length(w) * 5 + i * 3) % len(PARSE_LABELS))
            root = lambda k: F.get(F.array(*[F.lit(x[k]) for x in ROOT_LABELS]), n % len(ROOT_LABELS))
            at = lambda k: F.when(i == r, root(k) if k < 2 else F.lit("ROOT")).otherwise(label(k))
            return F.struct(w.alias("text"), at(0).alias("pos"), at(1).alias("tag"), at(2).alias("dep"), head.cast("int").alias("head"))

        return F.transform(ws, one)

    return let(words, tree)


def parse_sql(source: str) -> str:
    """tk(sid, w, i, n, head, pos, tag, dep): the same trees over src(sid, sentence), the distinct sentences of ``source``."""
    k = len(PARSE_LABELS)
    of = lambda x: f"CASE WHEN i = r THEN {_array([y[x] for y in ROOT_LABELS]) + f'[CAST(n % {len(ROOT_LABELS)} AS INTEGER) + 1]' if x < 2 else chr(39) + 'ROOT' + chr(39)} ELSE ({_array([y[x] for y in PARSE_LABELS])})[CAST((length(w) * 5 + i * 3) % {k} AS INTEGER) + 1] END"
    return f"""src AS MATERIALIZED (SELECT row_number() OVER () AS sid, sentence FROM (SELECT DISTINCT sentence FROM {source} WHERE sentence IS NOT NULL)),
tk0 AS (SELECT sid, list_filter(string_split(sentence, ' '), lambda x: x <> '') AS ws FROM src),
tk1 AS (SELECT sid, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n, len(ws) // 2 AS r FROM tk0),
tk AS MATERIALIZED (SELECT sid, w, i, n, CASE WHEN i = r THEN i WHEN i < r THEN i + 1 + length(w) % greatest(r - i, 1) ELSE i - 1 - length(w) % greatest(i - r, 1) END AS head,
  {of(0)} AS pos, {of(1)} AS tag, {of(2)} AS dep FROM tk1)"""
