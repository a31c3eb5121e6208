import pytest
from pyspark.sql import functions as F

from citelens.operators import batching as B
from citelens.operators import dataset as D
from citelens.operators import responses as R
from citelens.operators import scoring as S
from citelens.sources import files


@pytest.fixture
def tables(spark):
    text = spark.createDataFrame([("2021M", "2021-01-00", "This is a JWST science paper."), ("2023A", "2023-01-00", "This is a HST mention paper.")], "bibcode string, pubdate string, body string")
    track = spark.createDataFrame([("2021M", [("jwst", False)], [("JWST", "MENTION"), ("JWST", "SCIENCE")]), ("2024C", [("kepler", False)], [("Kepler", "MENTION")])], files.PAPERTRACK)
    return text, track


def test_combine(tables, rows):
    text, track = tables
    got = D.combine(text, track).collect()
    assert len(got) == 1 and got[0].class_missions["JWST"].papertype == "SCIENCE" and got[0].is_ignored == {"is_ignored_jwst": False}
    assert rows(D.only_in(text, track, ["bibcode"])) == [("2023A",)] and rows(D.only_in(track, text, ["bibcode"])) == [("2024C",)]
    assert tuple(D.date_range(text).first()) == (2, "2021-01-00", "2023-01-00")
    assert D.trim(text, ["body", "bibcode"]).columns == ["bibcode", "body"]
    with pytest.raises(ValueError):
        D.assert_unique(text.union(text))


def test_flatten_and_limit(spark):
    papers = spark.createDataFrame([("a", 1, "x"), ("a", 2, "later"), ("b", 3, "y"), ("c", 4, None)], "bibcode string, ord long, body string")
    labels = spark.createDataFrame([("a", "K2", "SCIENCE"), ("a", "HST", "SCIENCE"), ("b", "Kepler K2", "MENTION"), ("b", "nothing", "SCIENCE"), ("c", "HST", "SCIENCE"), ("b", "HST", "OTHER")], "bibcode string, mission string, papertype string")
    got = D.flatten(papers, labels, ["SCIENCE", "MENTION"])
    assert sorted((r.bibcode, r.text, r.mission, r.i_mission) for r in got.collect()) == [("a", "x", "Hubble", 0), ("a", "x", "K2", 1), ("b", "y", "K2", 0)]
    assert D.limit_papers(got, 1).count() == 2 and D.limit_papers(got, 3).count() == 3


@pytest.mark.parametrize("mode", ["uniform", "available"])
def test_split_covers_every_paper_once(spark, mode):
    labels = spark.createDataFrame([(f"p{i}", "A") for i in range(40)] + [(f"q{i}", "B") for i in range(20)] + [(f"p{i}", "B") for i in range(0)] + [("m1", "A"), ("m1", "B")] * (mode == "uniform"), "bibcode string, class string")
    got = D.tvt_split(labels, mode=mode).collect()
    assert len({r.bibcode for r in got}) == len(got) == labels.select("bibcode").distinct().count()
    n = {(c, s): sum(1 for r in got if (r["class"], r.split) == (c, s)) for c in "AB" for s in ("train", "validate", "test")}
    if mode == "uniform":
        assert n["A", "train"] == n["B", "train"] == 17 and n["A", "validate"] == n["B", "validate"] == 2
    else:
        assert (n["A", "train"], n["A", "validate"], n["A", "test"]) == (32, 4, 4)
    with pytest.raises(ValueError):
        D.tvt_split(spark.createDataFrame([(str(i), "A") for i in range(13)], "bibcode string, class string"), mode="available").collect()


def test_plan(spark):
    plan = lambda n, lines: B.chunk_plan(spark.createDataFrame([(n, 100, 1.0, n)], "n_lines long, n_bytes long, avg_tokens double, total_tokens long"), lines).first()
    assert [plan(50, 75)[k] for k in ("base_chunks", "lines_per_chunk", "chunks_per_day", "days")] == [1, 50, 1, 1]
    assert [plan(100, 75)[k] for k in ("base_chunks", "lines_per_chunk", "chunks_per_day", "days")] == [2, 50, 2, 1]
    big = spark.createDataFrame([(60030, 4052 * 1024 * 1024, 17591.0, 1055992772)], "n_lines long, n_bytes long, avg_tokens double, total_tokens long")
    p = B.chunk_plan(big, max_tokens=100_000_000).first()
    assert [p[k] for k in ("base_chunks", "lines_per_chunk", "tokens_per_chunk", "chunks_per_day", "days")] == [21, 2859, 50285371, 1, 21]


def test_chunks_and_log(spark, tmp_path):
    lines = spark.createDataFrame([(i * 7, f"l{i}") for i in range(100)], "ord long, line string")
    got = B.assign_chunks(lines, 40, 2).collect()
    assert [sum(1 for r in got if r.chunk == c) for c in (1, 2, 3)] == [40, 40, 20] and max(r.day for r in got) == 2
    files.write_chunks(lines, str(tmp_path / "c"), 40)
    assert spark.read.text(str(tmp_path / "c")).count() == 100
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "chunk long")
    log = spark.createDataFrame([(1, "b1")], "chunk long, batch_id string")
    assert B.submission_status(chunks, log).first().remaining == 2 and [r.chunk for r in B.pending(chunks, log, 1).collect()] == [2]
    remote = spark.createDataFrame([("b2", "done")], "batch_id string, status string")
    assert B.batch_status(log, remote).first().status == "not_found"


def test_responses(spark):
    good = '```json\n{"notes": "", "missions": [{"mission": "kepler", "papertype": "SCIENCE", "quotes": ["\\"q\\""], "reason": "", "confidence": [0.9, 0.1]}]}\n```'
    bad = good.replace("0.1]", "0.3]")
    lines = spark.createDataFrame([("a", good), ("b", "none"), ("c", bad), ("d", "```json\n{x\n```")], "custom_id string, text string")
    ok, failed = R.batch_results(lines)
    assert [r.custom_id for r in ok.collect()] == ["a"]
    assert {r.custom_id: r.error for r in failed.collect()} == {"b": "No JSON content found in response", "c": "Validation failed", "d": "JSON could not be decoded"}
    r = ok.select(R.strip_quotes(F.col("missions")[0]["quotes"]).alias("q"), R.canonical_mission(F.col("missions")[0]["mission"]).alias("m")).first()
    assert (r.q, r.m) == (["q"], "KEPLER")


def test_sinks(spark, tmp_path, rows):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "bibcode string, run int, notes string")
    new = spark.createDataFrame([("a", 0, "n")], "bibcode string, run int, notes string")
    assert ("a", 2, "n") in rows(files.append_runs(old, new)) and rows(files.append_runs(old, new, True)) == [("a", 0, "n"), ("b", 0, "z")]
    assert ("a", 0, "n") in rows(files.upsert(old, new, ["bibcode", "run"]))
    files.write_json(new, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "bibcode string", lines=True).first().bibcode == "a"
    assert files.read_json(spark, str(tmp_path / "none"), "bibcode string") is None
    with pytest.raises(Exception, match="already exists"):
        files.write_json(new, str(tmp_path / "j"))
    files.save_plan({"base_chunks": 1, "files": ["a", "b"]}, str(tmp_path / "p"))
    assert files.load_plan(str(tmp_path / "p"))["base_chunks"] == 2


def test_counters_and_verdicts(spark):
    df = spark.createDataFrame([([0.8, 0.2], "t", False, False), ([0.6, 0.4], "t", False, False), ([0.8, 0.2], " ", False, False), ([0.8, 0.2], "t", True, False), ([0.8, 0.2], "t", True, True)], "p array<double>, text string, no boolean, bad boolean")
    assert [r[0] for r in df.select(S.routed_verdict(["a", "b"], F.col("p"), F.col("text"), F.col("no"), F.col("bad"))).collect()] == ["a", S.LOW, S.NO_MATCH, S.NOT_CLASSIFIED, S.ERROR]
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "actual string, measured string")
    got = {(r.actual, r.measured): (r.n, r.share) for r in S.counters(rows, ["a", "b", "c"], ["a", "b"]).collect()}
    assert len(got) == 6 and got["a", "a"] == (1, 0.5) and got["c", "a"] == (0, 0.0)
    with pytest.raises(ValueError):
        S.scorer("none")


def test_streams_equal_batch(spark, tmp_path):
    from citelens.sources.buckets import read_buckets, upsert_stream

    src = spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "k int, v int")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = upsert_stream(stream, str(tmp_path / "out"), ["k"], "v", str(tmp_path / "cp"), available=False)
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in read_buckets(spark, str(tmp_path / "out"), src.schema).collect()) == [(1, 3), (2, 2)]


def test_json_array_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, 'q"')], "k int, t string").coalesce(1)
    files.write_json_array(df, str(tmp_path / "a"))
    files.write_json_array(df.limit(0), str(tmp_path / "b"))
    assert [(r.k, r.t) for r in files.read_json(spark, str(tmp_path / "a"), "k int, t string").collect()] == [(1, "a"), (2, None), (3, 'q"')]
    assert files.read_json(spark, str(tmp_path / "b"), "k int").count() == 0
    with pytest.raises(Exception, match="already exists"):
        files.write_json_array(df, str(tmp_path / "a"))


def test_user_configuration_over_defaults(tmp_path, monkeypatch):
    default = {"llm": {"model": "small", "files": ["a"]}, "n": 1}
    assert files.load_config(default, str(tmp_path)) == default
    monkeypatch.setenv("OWN_MODEL", "large")
    (tmp_path / "citelens_config.json").write_text('{"llm": {"model": "$OWN_MODEL", "files": ["b"]}, "extra": null}')
    monkeypatch.setenv("CITELENS_CONFIG_DIR", str(tmp_path))
    assert files.load_config(default) == {"llm": {"model": "large", "files": ["a", "b"]}, "n": 1, "extra": None}
    assert default == {"llm": {"model": "small", "files": ["a"]}, "n": 1}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
