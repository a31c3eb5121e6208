import pytest
from pyspark.sql import functions as F

from citelens.functions import text as T
from citelens.functions.registry import BY_LABEL, MISSIONS, Mission
from citelens.operators.paragraphs import merge_spans, paragraphs, verdict_by_rules


@pytest.fixture
def apply(spark):
    def of(f, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[1] for r in sorted(df.select("i", f(F.col("t"))).collect())]

    return of


def test_cleanse(apply):
    assert apply(T.cleanse, "  J.W .. . S. - T .  .S-c", " The poetry... It was beautiful (according to the audience.).", None) == [
        "J.W. S. - T.S-c", "The poetry. It was beautiful (according to the audience.).", None]


def test_streamline(apply):
    assert apply(T.streamline, "Fig. 4 shows the red vs. blue stars differ in radii.", "Somename (2013) published  in SJ.", "Also Author papers (Author et al. 1997, 2023),", "(Author et al. 80; Somename & Author 2012)") == [
        "Figure 4 shows the red vs blue stars differ in radii.", "Authorsetal published in SJ.", "Also Author papers,", ""]


def test_sentences(apply):
    assert apply(T.sentences, "One is here. Two is here! (Three.) Four?\n\nFive. six") == [["One is here.", "Two is here!", "(Three.)", "Four?", "", "Five. six"]]


MATCH = {"HST": ["that H S-T data", "that H.S T data", "HST.", "hst", "HST FGS"], "K2": ["that Kepler K2 mission"], "KEPLER": ["that Kepler and K2 data"], "COPERNICUS": ["that OAO 3 data"], "FIRST": ["VLA-FIRST"], "PANSTARRS": ["Pan-STARRS-1"]}
MISS = {"KEPLER": ["Keplerian velocity", "that Kepler K2 data"], "HST": ["that HcST data", "that A.H.S.T.M. data", "that LHST data", "that HS.xT data", "éHST"], "K2": ["that K23 data", "that AK2 data", "that K 2 star"]}


@pytest.mark.parametrize(("cases", "want"), [(MATCH, True), (MISS, False)])
def test_mentions(apply, cases, want):
    for label, texts in cases.items():
        assert apply(lambda t, m=BY_LABEL[label]: T.mentions(t, m), *texts) == [want] * len(texts)


def test_first_mission(apply):
    assert apply(T.first_mission, "K2 mission", "Kepler", "Kepler K2", "nothing") == ["K2", "KEPLER", "K2", None]


def test_anonymise(apply):
    assert apply(lambda t: T.anonymise(t, BY_LABEL["HST"]), "that Hubble Space Telescope data", "HST PSF.", "that A.H.S.T.M. data") == ["that OBJ data", "OBJ PSF.", "that A.H.S.T.M. data"]
    assert apply(lambda t: T.anonymise(t, BY_LABEL["PANSTARRS"]), "that Pan-STARRS data") == ["that OBJ data"]
    assert apply(lambda t: T.anonymise(t, BY_LABEL["COPERNICUS"]), "that OAO-3 data") == ["that OBJ data"]


def test_names():
    names = {m.label: m.name for m in MISSIONS}
    assert (names["HST"], names["JWST"], names["K2"], names["COPERNICUS"]) == ("Hubble", "Webb Telescope", "K2", "Copernicus")
    with pytest.raises(ValueError):
        Mission("X", ())


def test_importance(apply):
    got = apply(T.importance, "We used HST data in our work.", "The observations are plotted in Figure 3.", "Blue et al. (2023) published the raw spectra already.", "The dog left the doghouse.")
    assert [(r.is_pron_1st, r.is_keyword, r.is_term_fig, r.is_etal, r.is_any) for r in got] == [
        (True, True, False, False, True), (False, False, True, False, True), (False, False, False, True, True), (False, False, False, False, False)]


SPANS = [([1, 2, 3, 7, 8, 11], 1, 10, [(0, 4), (6, 9), (10, 10)]), ([1, 2, 7, 12], 2, 13, [(0, 4), (5, 9), (10, 13)]), (list(range(1, 11)), 0, 11, [(i, i) for i in range(1, 11)]), (list(range(1, 11)), 1, 11, [(0, 11)])]


@pytest.mark.parametrize(("hits", "buffer", "last", "want"), SPANS)
def test_spans(spark, hits, buffer, last, want):
    df = spark.createDataFrame([("p", i, last) for i in hits], "p string, i int, last int")
    assert sorted((r.lo, r.hi) for r in merge_spans(df, ["p"], buffer).collect()) == want


def test_rules(apply):
    assert apply(lambda t: verdict_by_rules(t, BY_LABEL["HST"]), "H.S.T. observatory", "Hubble Space Telescope", "Hubble et al. 2000", "nothing") == [True, True, None, False]


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "No. Here HST is. Not here. Nor here. HST again.")], "bibcode int, body string")
    got = sorted((r.lo, r.hi, r.paragraph) for r in paragraphs(df, F.col("body"), 0, (BY_LABEL["HST"],)).collect())
    assert got == [(1, 1, "Here HST is."), (4, 4, "HST again.")] or [g[2] for g in got] == ["No. Here HST is.", "HST again."]


def test_prompt_and_json(apply):
    assert apply(lambda t: T.fill_prompt("a {x} {y}", {"x": t}), "v", None) == ["a v {y}", "a  {y}"]
    assert apply(T.fenced_json, "x ```json\n{\"a\": 1}\n``` ```json\n{}\n```", "none") == ['{"a": 1}', None]
