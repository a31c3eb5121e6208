"""Splits of papers with several classes, ranges, gates, callouts, multi-class areas, responders, quarantine, results."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from citelens.functions import text as T
from citelens.functions.registry import BY_LABEL
from citelens.operators import batching, dataset, evaluation, metrics, paragraphs, ranges, responses, scoring
from citelens.sources import files


def _levels(own, seed=10):
    """A plain fold: papers of several classes, by md5, go to the smallest of theirs so far."""
    counts = {c: 0 for cs in own.values() for c in cs}
    out = {b: min(cs) for b, cs in own.items() if len(cs) == 1}
    for c in out.values():
        counts[c] += 1
    for b in sorted((b for b in own if len(own[b]) > 1), key=lambda b: (hashlib.md5(f"{seed}|{b}".encode()).hexdigest(), b)):
        out[b] = min(own[b], key=lambda c: (counts[c], c))
        counts[out[b]] += 1
    return out


@pytest.mark.parametrize("range_rows", [50_000, 7])
def test_split_of_several_classes(spark, range_rows):
    rows = [(i, "a") for i in range(40)] + [(i, "b") for i in range(30, 60)] + [(i, "c") for i in range(55, 58)] + [(5, "a")]
    rnd = random.Random(3)
    many = [(i, c) for i in range(400) for c in rnd.sample("abcd", rnd.choice([1, 1, 2, 3]))] + [(i, "d") for i in range(400, 500)]
    for table in (rows, many):
        own = {}
        for b, c in table:
            own.setdefault(b, set()).add(c)
        got = dataset.tvt_split(spark.createDataFrame(table, "bibcode int, class string"), range_rows=range_rows).collect()
        assert len(got) == len(own) and {r.bibcode: r["class"] for r in got} == _levels(own)


def test_levelling_by_ranges_settles_every_case(spark):
    """Guesses are far off where the sets of classes change along the order."""
    rnd = random.Random(5)
    for n in (1, 60):
        own = {f"p{i}": {"a", "b"} if rnd.random() < 0.5 else {"b", "c", "d"} if rnd.random() < 0.7 else {"a", "d"} for i in range(n)}
        start = {"a": 0, "b": 25, "c": 3, "d": 0}
        papers = spark.createDataFrame([(b, sorted(c)) for b, c in own.items()], "bibcode string, classes array<string>")
        got = {r.bibcode: r["class"] for r in dataset.levelled(papers, start, n, range_rows=4).collect()}
        singles = {f"{c}{i}": {c} for c, k in start.items() for i in range(k)}
        assert got == {b: c for b, c in _levels(own | singles).items() if b in own}


def test_ranges_number_sparse_and_clustered_values(spark):
    values = [1, 10**12, 5] + [7] * 40 + [3 * 10**6 + i for i in range(50)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "ord long, i int")
    got = [r.number for r in batching.ordinals(df).orderBy("ord", "number").collect()]
    assert got == list(range(len(values)))
    assert batching.ordinals(df.limit(0)).count() == 0 and ranges.range_of(df.limit(0), "ord") is not None


def test_area_under_the_curve(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert abs(metrics.auc(df).first().auc - want) < 1e-9
    curve = sorted(metrics.roc_curve(df, drop_collinear=False).collect(), key=lambda r: -r.threshold)
    assert [r.tp for r in curve[1:]] == [sum(s >= r.threshold for s in pos) for r in curve[1:]] and curve[0].tp == 0
    kept = {r.threshold for r in metrics.roc_curve(df).collect()}
    assert kept <= {r.threshold for r in curve} and {curve[0].threshold, curve[1].threshold, curve[-1].threshold} <= kept
    assert metrics.auc(df.where("label = 1")).first().auc == 0 == metrics.auc(df.limit(0)).first().auc
    multi = spark.createDataFrame([("a", {"a": 0.9, "b": 0.1}), ("b", {"a": 0.2, "b": 0.8}), ("a", {"a": 0.6, "b": 0.4}), ("b", {"b": 0.7})], "actual string, probs map<string,double>")
    assert {r["class"]: r.auc for r in metrics.auc_per_class(multi, ["a", "b"]).collect()} == {"a": 1.0, "b": 1.0, "micro": 1.0, "macro": 1.0}


def test_first_label_by_order(spark):
    ids = spark.createDataFrame([(1,)], "bibcode int")
    missions = spark.createDataFrame([("HST",)], "mission string")
    llm = spark.createDataFrame([(1, "hst", "SCIENCE", 0), (1, "HST", "MENTION", 1)], "bibcode int, mission string, papertype string, ord int")
    none = llm.limit(0).drop("ord")
    assert metrics.label_pairs(ids, missions, none, llm).first().llm_raw == "SCIENCE"
    assert metrics.label_pairs(ids, missions, none, llm.drop("ord")).first().llm_raw == "MENTION"


def test_evaluate_in_one_call(spark):
    papers = spark.createDataFrame([(1,), (2,)], "bibcode int")
    kind = "bibcode int, run int, error string, missions array<struct<mission:string,papertype:string,confidence:array<double>>>"
    runs = spark.createDataFrame([(1, 0, None, [("HST", "SCIENCE", [0.9, 0.1])]), (1, 1, None, [("JWST", "MENTION", [0.2, 0.8])]), (2, 0, "failed", None)], kind)
    human = spark.createDataFrame([(1, "hst", "SCIENCE"), (2, "TESS", "MENTION")], "bibcode int, mission string, papertype string")
    found = spark.createDataFrame([(1, "HST")], "bibcode int, mission string")
    out = evaluation.evaluate(papers, runs, human, found, spark.createDataFrame([(1,), (2,), (3,)], "bibcode int"))
    classes = {r.mission: r for r in out["classes"].collect()}
    assert classes["HST"].consistency == 50.0 and not classes["HST"].hallucinated and classes["JWST"].hallucinated and classes["JWST"].consistency == 0
    assert {(r.bibcode, r.human) for r in out["errors"].collect()} == {(2, "TESS:MENTION"), (3, None)}
    assert {(r.side, r.missions) for r in out["missing"].collect()} == {("human", "JWST")} and out["missions"].count() == 2


def test_responder_and_fields(spark):
    def reply(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        body = {"notes": "", "missions": [{"mission": "hst", "papertype": "SCIENCE", "quotes": ['"q"'], "reason": "", "confidence": [0.5, 0.4] if "odd" in prompt else [0.6, 0.4]}]}
        return f"```json\n{json.dumps(body)}\n```"

    papers = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "odd"), (4, None)], "bibcode int, body string")
    got = {(r.bibcode, r.run): r for r in responses.classify_papers(papers, F.col("body"), reply, 2).collect()}
    assert len(got) == 8 and got[1, 1].error is None and got[1, 2].missions[0].mission == "HST" and got[1, 1].missions[0].quotes == ["q"]
    assert got[2, 1].error == "RuntimeError: down" and got[3, 1].error == "Validation failed" and got[4, 1].error is None
    assert responses.unfilled_fields("a {title} {body} {x} {x}", ["title", "body"]) == ["x"]
    kinds = papers.select(responses.source_kind(F.lit("12")), responses.source_kind(F.lit("2020A")), responses.source_kind(F.lit("f.json"), ["f.json"])).first()
    assert tuple(kinds) == ("index", "bibcode", "file")


def test_classify_set_and_quarantine(spark):
    papers = spark.createDataFrame([(1, "yes"), (2, "")], "bibcode int, body string")
    modify = lambda t, m: t.select("bibcode", F.when(F.col("bibcode") == 2, F.lit("")).otherwise(F.concat("body", F.lit(m.label))).alias("modif"))
    score = lambda rows: rows.withColumn("probs", F.when(F.col("text").contains("TESS"), F.create_map(F.lit("science"), F.lit(0.9))))
    out = {(r.bibcode, r.mission): r.verdict for r in scoring.classify_set(papers, (BY_LABEL["TESS"], BY_LABEL["HST"]), modify, score, ["science", "mention"]).collect()}
    assert out == {(1, "TESS"): "science", (1, "HST"): "error", (2, "TESS"): "nomatch", (2, "HST"): "nomatch"}
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)], "bibcode int, class string")
    made = lambda r: r.withColumn("text", F.when(F.col("bibcode") > 1, F.lit("t"))).withColumn("error", F.when(F.col("bibcode") == 2, "cannot"))
    model, splits, quarantine = scoring.train_with_quarantine(rows, made, lambda train: train.count())
    assert {(r.bibcode, r.error) for r in quarantine.collect()} == {(0, "no text"), (1, "no text"), (2, "cannot")}
    assert splits.count() == 37 and model == splits.where("split = 'train'").count()


def test_gate_and_checks(spark):
    chunks = spark.createDataFrame([(i, 100) for i in range(1, 8)], "chunk long, tokens long")
    log = spark.sql("SELECT 1L chunk, TIMESTAMP '2024-01-02 03:00:00' ts, 100L tokens")
    day = F.lit("2024-01-02").cast("date")
    got = [(r.chunk, r.running, r.send) for r in batching.submission_gate(chunks, log, day, 3, 350).orderBy("chunk").collect()]
    assert got == [(2, 200, True), (3, 300, True), (4, 400, False)]
    one = batching.submission_status(chunks, log, day, 350).first()
    assert (one.total, one.submitted, one.remaining, one.submitted_today, one.tokens_today, one.tokens_left) == (7, 1, 6, 1, 100, 250)
    lines = spark.createDataFrame([(1, "a b c"), (1, "d"), (2, "e")], "chunk int, line string")
    assert {r.chunk: r.ok for r in batching.verify_chunks(lines, 5, 100, 3).collect()} == {1: False, 2: True}


def test_files_of_results(spark, tmp_path):
    done = []
    log = str(tmp_path / "log")
    assert files.run_serially(["b", "a"], done.append, log, dry_run=True) == ["a", "b"] and not done
    assert files.run_serially(["b", "a"], done.append, log) == ["a", "b"] == done and files.run_serially(["c", "a"], done.append, log) == ["c"]
    results = spark.createDataFrame([("1_HST", 1, "HST", "science", {"science": 0.9}), ("1_TESS", 1, "TESS", "nomatch", None)], "id string, bibcode int, mission string, verdict string, probs map<string,double>")
    files.write_results(results, str(tmp_path / "r"))
    assert len(spark.read.json(str(tmp_path / "r")).first().missions) == 2
    papers = spark.createDataFrame([("x", "t", 0), ("y", "u", 1)], "bibcode string, body string, ord int")
    files.paper_to_file(papers, str(tmp_path / "p"), "y")
    assert spark.read.json(str(tmp_path / "p")).first().body == "u"


def test_letters_that_fold_to_ascii(spark):
    """The look-ups before the patterns are right only if no other letter matches an ASCII one without regard to case."""
    every = spark.range(0x80, 0x30000).where("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    found = {r.c for r in every.where(F.col("c").rlike("(?iU)^(?:" + "|".join("abcdefghijklmnopqrstuvwxyz") + ")$")).collect()}
    assert found == set(T.FOLDS[0])
    df = spark.createDataFrame([("HuBBLe Kepler obſerves",), ("KEPLER",), ("hubbıe",)], "t string")
    assert [r[0] for r in df.select(T.missions_of(F.col("t"))).collect()] == [["HST", "KEPLER"], ["KEPLER"], []]


def test_paragraph_files_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "HST", 0, 0, "p"), (2, "TESS", 1, 2, "q")], "bibcode int, mission string, lo int, hi int, paragraph string")
    path = str(tmp_path / "p")
    files.write_paragraphs(rows, path)
    with pytest.raises(Exception, match="exist"):
        files.write_paragraphs(rows, path)
    files.write_paragraphs(rows, path, overwrite=True)
    assert [r.bibcode for r in files.read_paragraphs(spark, path, ["TESS"]).collect()] == [2] and files.read_paragraphs(spark, path).count() == 2
    lines = spark.createDataFrame([(0, "a b"), (1, "c")], "ord int, line string")
    assert batching.file_statistics(lines, encode=lambda t: list(t)).first().total_tokens == 4 and batching.file_statistics(lines).first().total_tokens == 3
    with pytest.raises(ValueError):
        dataset.require_rows(rows, 3)
    assert dataset.require_rows(rows, 2) is rows


def test_modified_texts_of_all_missions(spark):
    """One pass over the papers gives what a call for each mission gives."""
    rows = [("a", "HST data were used. We like the J.W.S.T. spectra of HST! TESS saw it. No term here."), ("b", "TESS and HST agree."), ("c", "Nothing."), ("d", ""), ("e", None)]
    papers = spark.createDataFrame(rows, "bibcode string, body string")
    own = tuple(BY_LABEL[x] for x in ("HST", "JWST", "TESS", "GALEX"))
    for anon in (False, True):
        want = {(r.bibcode, m.label, r.modif, r.modif_none) for m in own for r in paragraphs.modified_texts(papers, F.col("body"), m, "anon" if anon else "none").where("modif_none <> ''").collect()}
        got = [tuple(r) for r in paragraphs.modified_by_mission(papers, F.col("body"), own, anon).collect()]
        assert set(got) == want and len(got) == len(want) == 5
    assert paragraphs.modified_by_mission(papers.limit(0), F.col("body"), own).count() == 0
