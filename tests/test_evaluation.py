import pytest
from pyspark.sql import functions as F

from citelens.operators import evaluation as E
from citelens.operators import metrics as M

RUNS = "bibcode string, run int, error string, missions array<struct<mission:string,papertype:string,confidence:array<double>>>"


@pytest.fixture
def runs(spark):
    s, m = ("SCIENCE", [0.9, 0.1]), ("MENTION", [0.3, 0.7])
    calls = [[("TESS", *s), ("JWST", *m)], [("TESS", *m)], [("TESS", *s), ("JWST", *s)], [("TESS", *s)], [("TESS", *s)], [("TESS", *s), ("JWST", *m)]]
    return spark.createDataFrame([*[("p", i, None, c) for i, c in enumerate(calls)], ("p", 9, "failed", None), ("q", 0, None, [])], RUNS)


def test_grouped_and_missions(runs):
    g = E.grouped_calls(E.explode_calls(runs))
    got = {(r.mission, r.papertype): r for r in g.collect()}
    js, ts = got["JWST", "SCIENCE"], got["TESS", "SCIENCE"]
    assert len(got) == 4 and js.n_runs == 6
    assert (js["count"], js.mean_science, js.weighted_science, js.weighted_mention) == (1, 0.9, 0.15, 0.017)
    assert (ts["count"], ts.weighted_science, ts.weighted_mention) == (5, 0.75, 0.083)
    per = {r.mission: r for r in E.mission_confidence(g).collect()}
    assert (round(per["JWST"].total, 3), per["JWST"].prob_mission, round(per["JWST"].prob_science, 3)) == (0.5, 0.333, 0.5)
    assert (round(per["TESS"].total, 3), per["TESS"].prob_mission, round(per["TESS"].prob_science, 3)) == (1.0, 0.667, 0.8)
    routed = E.route(g, E.mission_confidence(g), 0.5, 0.2).collect()
    assert {(r.mission, r.papertype, r.route) for r in routed} == {("TESS", "SCIENCE", "accept"), ("JWST", "MENTION", "inspect")}


def test_consistency_and_errors(spark, runs, rows):
    human = spark.createDataFrame([("p", "tess", "SCIENCE"), ("p", "HST", "MENTION")], "bibcode string, mission string, papertype string")
    calls = E.explode_calls(runs)
    got = {(r.mission, r.papertype): (r.in_human_class, r.consistency) for r in E.consistency(E.grouped_calls(calls), human).collect()}
    assert got["TESS", "SCIENCE"] == (True, 83.333) and got["JWST", "SCIENCE"] == (False, 0.0)
    assert rows(E.missing_missions(calls, human)) == [("p", "human", "JWST"), ("p", "llm", "HST")]
    wanted = spark.createDataFrame([("p",), ("q",), ("r",)], "bibcode string")
    assert rows(E.errors(wanted.where("bibcode <> 'r'"), runs, wanted)) == [("q", "No mission output found for q"), ("r", "No paper source found")]


def test_tally_lists_the_groups_own_papers(spark, rows):
    calls = spark.createDataFrame([("a", 0, "K2", "MENTION", 0.2, 0.8), ("b", 0, "Kepler", "SCIENCE", 0.95, 0.05), ("c", 0, "KEPLER", "SCIENCE", 0.9, 0.1)], "bibcode string, run int, mission string, papertype string, conf_science double, conf_mention double")
    got = {r.mission: r for r in E.acceptance_tally(calls, 0.85, 0.5).collect()}
    assert (got["k2"].total_count, got["k2"].accepted_count, got["k2"].inspection_count, got["k2"].inspection_papers) == (1, 0, 1, 1)
    assert (got["kepler"].accepted_count, got["kepler"].accepted_papers) == (2, 2)
    papers = rows(E.acceptance_papers(calls, 0.85, 0.5), "mission", "route", "bibcode")
    assert papers == [("k2", "inspect", "a"), ("kepler", "accept", "b"), ("kepler", "accept", "c")]


def test_report_of_a_published_sample(spark):
    counts = spark.createDataFrame([(1569, 26, 20, 33)], "tn long, fp long, fn long, tp long")
    got = {r.label: r for r in M.report_of_counts(counts).collect()}
    r4 = lambda r: tuple(round(x, 4) for x in (r.precision, r.recall, r.f1))
    assert r4(got["NONSCIENCE"]) == (0.9874, 0.9837, 0.9856) and got["NONSCIENCE"].support == 1595
    assert r4(got["SCIENCE"]) == (0.5593, 0.6226, 0.5893) and got["SCIENCE"].support == 53
    assert r4(got["macro avg"]) == (0.7734, 0.8032, 0.7874) and r4(got["weighted avg"]) == (0.9736, 0.9721, 0.9728)
    assert round(got["accuracy"].f1, 4) == 0.9721


def test_label_pairs_and_confusion(spark):
    cols = "bibcode string, mission string, papertype string"
    human = spark.createDataFrame([("a", "JWST", "SCIENCE"), ("a", "ROMAN", "SCIENCE"), ("a", "TESS", "SUPERMENTION"), ("b", "HST", "SCIENCE")], cols)
    llm = spark.createDataFrame([("a", "JWST", "SCIENCE"), ("a", "ROMAN", "SUPERMENTION"), ("a", "LAMOST", "SCIENCE")], cols)
    papers = spark.createDataFrame([("a",), ("b",)], "bibcode string")
    missions = spark.createDataFrame([("HST",), ("JWST",), ("ROMAN",)], "mission string")
    pairs = M.label_pairs(papers, missions, human, llm)
    got = {(r.bibcode, r.mission): (r.human[0], r.llm[0]) for r in pairs.collect()}
    assert [got["a", m] for m in ("HST", "JWST", "ROMAN")] == [("N", "N"), ("S", "S"), ("S", "N")]
    assert [got["b", m] for m in ("HST", "JWST", "ROMAN")] == [("S", "N"), ("N", "N"), ("N", "N")]
    c = M.confusion(pairs).first()
    assert (c.tn, c.fp, c.fn, c.tp, c.fpr) == (3, 0, 2, 1, 0.0)
    k = M.callouts(pairs, human, llm, ["HST", "JWST", "ROMAN"]).first()
    assert (k.n_bibcodes, k.n_human_callouts, k.n_llm_callouts, k.n_both_callouts, k.n_non_mission) == (2, 3, 2, 2, 1)


def test_roc(spark):
    scores = spark.createDataFrame(list(zip([0.8, 0.6, 0.1, 0.7, 0.9], [1, 0, 0, 1, 1], strict=True)), "score double, label int")
    curve = M.roc_curve(scores)
    got = sorted(((r.threshold, round(r.fpr, 3), round(r.tpr, 3)) for r in curve.collect()), reverse=True)
    assert got == [(float("inf"), 0.0, 0.0), (0.9, 0.0, 0.333), (0.7, 0.0, 1.0), (0.1, 1.0, 1.0)]
    assert M.auc(scores).first().auc == 1.0


def test_audit(spark, rows):
    cols = "bibcode string, mission string, papertype string"
    human = spark.createDataFrame([("p", "KEPLER", "SCIENCE"), ("p", "TESS", "DATA-INFLUENCED"), ("q", "HST", "SCIENCE"), ("q", "K2", "MENTION")], cols)
    llm = spark.createDataFrame([("p", "KEPLER", "SCIENCE"), ("p", "K2", "MENTION"), ("q", "HST", "MENTION"), ("q", "K2", "SCIENCE"), ("z", "K2", "SCIENCE")], cols)
    a = M.audit(human, llm)
    assert rows(a, "mission", "result") == [("HST", "false_negative"), ("K2", "false_positive"), ("KEPLER", "matched"), ("TESS", "ignored")]
    s = M.audit_summary(a).first()
    assert (s.n_papers, s.n_classifications, s.false_positive, s.false_negative, s.ignored) == (2, 3, 1, 1, 1)
    assert rows(M.llm_only(human, llm)) == [("z",)]


def test_papertypes(spark):
    df = spark.createDataFrame([("Science",), ("MENTION",), ("poem",), (None,)], "t string")
    assert [r[0] for r in df.select(M.map_papertype(F.col("t"))).collect()] == ["SCIENCE", "NONSCIENCE", None, None]
