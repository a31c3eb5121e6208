"""Costly expressions are computed once per text, their tests spare no text, and no task gets most papers."""

import random

import pytest
from pyspark.sql import functions as F

from citelens.functions import text as T
from citelens.functions.registry import MISSIONS, Mission
from citelens.operators import paragraphs as P
from citelens.plans import catalogue

SF = "/root/testdata/sf0.001"


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q_keyword_hits", "q_keyword_mode"])
def test_no_filter_computes_the_missions_again(spark, name):
    lines = [x for x in optimised(catalogue.QUERIES[name](spark, SF)).splitlines() if "RLIKE" in x]
    assert len(lines) == 1 and "Filter" not in lines[0]


@pytest.mark.parametrize("name", ["q_anonymise", "q_truematch_fast"])
def test_forms_are_computed_once_for_all_missions(spark, name):
    plan = optimised(catalogue.QUERIES[name](spark, SF))
    assert plan.count("lower(") == 1


@pytest.mark.parametrize("f", [P.settled_sentences, P.missions_or_names])
def test_rules_are_tried_once(spark, f):
    df = spark.createDataFrame([(1, "The Hubble constant. Hubble images. HST data. JWST"), (2, "Kepler qzx. TESS"), (3, None)], "bibcode int, body string")
    out = f(df, F.col("body"))
    assert "body" not in optimised(out)  # what is left reads what the one pass wrote
    got = sorted((r.bibcode, r.mission) for r in out.collect())
    assert got == ([(1, "HST"), (1, "HST"), (1, "JWST"), (2, "TESS")] if f is P.settled_sentences else [(1, "HST"), (1, "JWST"), (2, "TESS")])


def test_papers_without_open_sentences_go_to_all_tasks(spark):
    """Equal texts as well."""
    df = spark.createDataFrame([(i, "Nothing here. HST data." if i % 2 else "Hubble images.") for i in range(60)], "bibcode int, body string")
    keys = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ["false", "-1"], strict=True):
            spark.conf.set(k, v)
        at = P.marked_papers(df, F.col("body"), undecided=None).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    assert len(at) == 60 and all(sorted(m for h in r.h for m in h) == ["HST"] for r in at)
    for odd in (0, 1):
        assert len({r["at"] for r in at if r.bibcode % 2 == odd}) == 3


def test_the_common_pattern_spares_no_text(spark):
    rng = random.Random(3)
    terms = [t for m in MISSIONS for t in (*m.phrases, *m.cased, *m.uncased)]
    other = [" ", ".", "-", ". -", ",", "_", "é", "ſ", "K", "İ", "ı", "s", "1", "|", "\n", "(", "Kepler K2", "́"]

    def spelt():
        t = rng.choice(terms)
        return rng.choice([t, t.lower(), t.upper(), rng.choice(["", " ", ".", "-", ". -", " ."]).join(t), t.replace("s", "ſ").replace("K", "K")])

    texts = ["".join(rng.choice(other) if rng.random() < 0.6 else spelt() for _ in range(rng.randint(1, 5))) for _ in range(300)]
    banned = Mission("X", ("Foo", "Foo bar"), banned=("bar baz",))
    every = (*(m for m in MISSIONS if m.label in ("FIRST", "HST", "K2", "KEPLER")), banned)
    df = spark.createDataFrame([(t,) for t in [*texts, "Foobar baz", "xFoo", "Foo bar baz"]], "t string")
    t = F.col("t")

    def plain(m):
        own = T.masked(t, m)
        found = own.rlike(f"(?iU){m.phrase_pattern()}")
        for flags, pattern in (("(?U)", m.acronym_pattern(True)), ("(?iU)", m.acronym_pattern(False))):
            found = found | own.rlike(flags + pattern) if pattern else found
        return found

    want = F.array_compact(F.array(*[F.when(plain(m), m.label) for m in every]))
    got = P._labels(t, every, lambda v: F.coalesce(v, F.lit(True)))
    rows = df.select("t", want.alias("want"), got.alias("got"), T.mentions_any(t, every).alias("some")).collect()
    assert [(r.t, r.want, r.got) for r in rows if r.want != r.got or r.some != bool(r.want)] == []
    assert sum(bool(r.want) for r in rows) > 20 and rows[300].want == ["X"]
