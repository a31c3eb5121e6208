import pytest
from pyspark.sql import functions as F

from citelens.functions import nlp
from citelens.functions.registry import BY_LABEL, MISSIONS
from citelens.operators import ambiguity
from citelens.operators.paragraphs import verdict_by_rules

CASES = [
    ("small Hubble constant", "KEPLER", False), ("small Hubble's constant", "KEPLER", False), ("Edwin Hubble's papers", "HST", False),
    ("high S/N Hubble image", "HST", True), ("HST observatory", "HST", True), ("H.S.T. observatory", "HST", True), ("Hubble calibrated images", "HST", True),
    ("Hubble's calibrated data", "HST", True), ("Hubble's pretty spectra", "HST", True), ("Edwin Hubble's analysis", "HST", False), ("A Hubble constant data", "HST", False),
    ("Hubble et al. 2000", "HST", False), ("Hubbleetal 2000", "HST", False), ("Hubble and more data.", "HST", True), ("Kepler fields.", "KEPLER", True),
    ("Kepler velocities.", "KEPLER", False), ("Kepler velocity fields.", "KEPLER", False), ("Kepler rotation velocity fields.", "KEPLER", False),
    ("that Kepler data velocity.", "KEPLER", True), ("true Kepler planets", "KEPLER", False), ("those Kepler radii", "KEPLER", False), ("Keplerian orbits", "KEPLER", False),
    ("Kepler's law", "KEPLER", False), ("Kepler observations", "KEPLER", True), ("K2 database", "K2", True), ("K2-123 star", "K2", False), ("K2 stars", "K2", False),
    ("Copernicus satellite", "COPERNICUS", True), ("Copernicus model", "COPERNICUS", False),
]


@pytest.mark.parametrize(("phrase", "label", "want"), CASES)
def test_true_match(phrase, label, want):
    assert nlp.true_match(phrase, BY_LABEL[label]) is want


def test_decide_agrees(spark):
    for label in ("HST", "KEPLER", "K2", "COPERNICUS"):
        own = [(p, w) for p, m, w in CASES if m == label]
        df = spark.createDataFrame(own, "sentence string, want boolean")
        got = ambiguity.decide(df.withColumn("mission", F.lit(label)), verdict_by_rules(F.col("sentence"), BY_LABEL[label]))
        assert got.count() == len(own) and got.where("verdict IS DISTINCT FROM want").count() == 0


def test_chunks_meaning():
    chunks = nlp.wordchunks(nlp.annotate("We saw the deep Hubble images of stars"), BY_LABEL["HST"])
    assert [[t.text for t in c] for c in chunks] == [["deep", "Hubble", "images"]]
    assert nlp.meaning(chunks[0], MISSIONS) == ["deep", "hubble", "image"]


def test_spans(spark):
    df = spark.createDataFrame([("HST HST",), ("the Hubble",), (None,)], "t string")
    got = [[(x.lo, x.hi) for x in r[0]] for r in df.select(nlp.spans(F.col("t"), BY_LABEL["HST"])).collect()]
    assert got == [[(0, 3)], [(4, 9)], []] or got[0] == [(0, 4)] and got[1:] == [[(4, 9)], []]
