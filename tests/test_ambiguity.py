"""The ambiguity decision as joins: chunks, meanings by a lexicon, the phrase index, verdicts against a plain version."""

from pyspark.sql import functions as F

from citelens.functions import nlp, words
from citelens.functions.registry import BY_LABEL, MISSIONS
from citelens.operators import ambiguity as A
from citelens.operators.paragraphs import settled_sentences

AMBIGUOUS = tuple(m for m in MISSIONS if m.ambiguous)
SENTENCES = [
    "We saw the deep Hubble images of stars", "Hubble", "the Hubble's deep-field / wide spectra, and Kepler K2 data", "K2-123 star", "", "Nothing.", "Edwin Hubble wrote two Kepler papers",
    "Roman numerals (ROMAN) use Roman 000", "Keplerian Kepler velocities of Kepler planets", "Kepler-22b and Kepler data velocity fields", "hubble hubble constant hubble", "the Copernicus model of 1543",
]


def test_tagged_words_and_singulars_equal_the_plain_version(spark):
    df = spark.createDataFrame([(s,) for s in [*SENTENCES, "ID12 l'été 12.5 vs. don't, it's an ESA's thing; überall_x"]], "s string")
    for r in df.select("s", words.tagged(F.col("s")).alias("t")).collect():
        assert [(t.text, t.pos) for t in r.t] == [tuple(t) for t in nlp.annotate(r.s)]
    nouns = ["galaxies", "Masses", "boxes", "bus", "gas", "spectra", "axis", "glass", "stars", "Data", "is", "ties"]
    got = spark.createDataFrame([(n,) for n in nouns], "n string").select("n", words.singular(F.col("n")).alias("one")).collect()
    assert all(r.one == nlp.singular(r.n) for r in got)
    assert spark.createDataFrame([(None,)], "s string").select(F.size(words.tagged(F.col("s")))).first()[0] == 0


def test_chunks_and_meanings_equal_the_plain_version(spark):
    rows = [(i, m.label, s) for i, s in enumerate(SENTENCES) for m in AMBIGUOUS]
    df = spark.createDataFrame(rows, "id int, mission string, sentence string")
    got = sorted((r.id, r.mission, r.text, r.meaning) for r in A.chunks(df, ["id"], AMBIGUOUS).collect())
    want = []
    for i, label, s in rows:
        for c in nlp.wordchunks(nlp.annotate(s), BY_LABEL[label]):
            want.append((i, label, " ".join(t.text for t in c if t.pos != "POSS"), " ".join(nlp.meaning(c))))
    assert got == sorted(want)


def test_verdicts_equal_the_plain_version(spark):
    rows = [(i, m.label, s) for i, s in enumerate(SENTENCES) for m in AMBIGUOUS]
    df = spark.createDataFrame([*rows, *rows[:3], (99, "HST", None)], "id int, mission string, sentence string")
    got = {(r.id, r.mission): r.verdict for r in A.settle(df, ["id"]).collect()}
    table = nlp._compiled(MISSIONS)
    masks = lambda s, m: s.replace("Kepler K2", "#########") if m == "KEPLER" else s
    want = {(i, m): nlp.means_mission(masks(s, m), BY_LABEL[m], table) for i, m, s in rows}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_extensions_of_chunks(spark):
    df = spark.createDataFrame([(1, "HST", "We (the Hubble) imaged data show that figures matter")], "id int, mission string, sentence string")
    given = F.from_json(F.lit('[["We","PRON"],["(","PUNCT"],["the","DET"],["Hubble","NOUN"],["imaged","VERB"],["data","NOUN"],["of","PREP"],["figures","VERB"]]'), "array<array<string>>")
    parse = F.transform(given, lambda t: F.struct(t[0].alias("text"), t[1].alias("pos")))
    of = lambda **k: [(r["at"], r.text) for r in A.chunks(df, ["id"], AMBIGUOUS, words=parse, **k).collect()]
    assert of() == [(3, "Hubble")]
    assert of(verbs=True) == [(3, "Hubble imaged data")]
    assert of(important=F.col("word") == "the") == [(2, "the Hubble")]
    assert of(brackets=True, important=F.col("word") == "the", verbs=True) == [(1, "( the Hubble imaged data")]


def test_a_lexicon_gives_the_roots(spark):
    """Words of several roots, roots of several words; the phrase table is read by the same lexicon."""
    lexicon = spark.createDataFrame([("planet", ["world", "planet"]), ("worlds", ["world"]), ("Worlds", ["earth"]), ("empty", [])], "word string, roots array<string>")
    df = spark.createDataFrame([(1, "KEPLER", "Kepler worlds"), (2, "KEPLER", "Kepler empty 42")], "id int, mission string, sentence string")
    assert sorted((r.id, r.meaning) for r in A.chunks(df, ["id"], AMBIGUOUS, lexicon).collect()) == [(1, "kepler earth world"), (2, "kepler empty 000")]
    phrases = [("Kepler", "Kepler planet", False), ("AnyMission", "AnyMission 000", True)]
    assert [(r.id, r.verdict) for r in A.settle(df, ["id"], MISSIONS, lexicon, phrases).orderBy("id").collect()] == [(1, False), (2, True)]
    assert [(r.id, r.verdict) for r in A.settle(df, ["id"], MISSIONS, None, phrases).collect()] == [(2, True)]
    index = A.phrase_index(spark, MISSIONS, lexicon, phrases).where("mission = 'KEPLER' AND form = 1 AND ord = 0")
    assert sorted(r.root for r in index.collect()) == ["planet", "world"]


def test_settled_sentences(spark):
    df = spark.createDataFrame([(1, "The Hubble constant is large. Hubble images are deep.\nTESS flew."), (2, "The Hubble constant."), (3, None), (None, "Kepler data."), (4, "")], "bibcode int, body string")
    assert sorted((r.bibcode or 0, r.i, r.mission) for r in settled_sentences(df, F.col("body")).collect()) == [(0, 0, "KEPLER"), (1, 1, "HST"), (1, 2, "TESS")]
    assert settled_sentences(df.limit(0), F.col("body")).count() == 0
