"""The registered queries over the driver's tables, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, nlp, parse
from ..functions import text as T
from ..functions.ambiguity import PHRASES
from ..functions.registry import BY_LABEL, LABELS, MISSIONS
from ..operators import ambiguity, batching, dataset, evaluation, metrics, models, paragraphs, responses, scoring
from ..sources import files, order
from ..streaming.lifecycle import lifecycle
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ACCEPT, INSPECT = 0.85, 0.70  # so that accepted, to inspect and neither all occur
ROUTE_ACCEPT, ROUTE_INSPECT = 0.5, 0.3


def query(name: str, sql: str | None = None):
    def own(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return own


# SQL building blocks


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _ascii(col: str) -> str:
    """RE2 knows ASCII word boundaries only: other letters become an ASCII word character first."""
    return f"regexp_replace({col}, '[^\\x00-\\x7F]', '_', 'g')"


# The patterns below are written out for RE2 on their own, not taken from the implementation.


def _phrases(m) -> str:
    return "(?i)(?:" + "|".join(rf"\b{p}\b" for p in m.phrases) + ")"


def _acronyms(words, case: str) -> str:
    spelt = ["".join(c + (r"(?:\.)?(?: )?(?:-)?" if i < len(w) - 1 else "") for i, c in enumerate(w)) for w in words]
    return case + r"(?:^|[^.])\b(?:" + "|".join(spelt) + r")\b(?:\.)?(?:$|[^A-Za-z|])"


def _mentions(col: str, m, mode: str | None = None) -> str:
    col = _ascii(col)
    for phrase in m.banned:
        col = f"regexp_replace({col}, {_q('(?i)' + phrase)}, '{'#' * len(phrase)}', 'g')"
    parts = []
    if mode != "acronym" and m.phrases:
        parts.append(f"regexp_matches({col}, {_q(_phrases(m))})")
    if mode != "keyword":
        parts += [f"regexp_matches({col}, {_q(_acronyms(words, case))})" for words, case in ((m.cased, ""), (m.uncased, "(?i)")) if words]
    return "(" + (" OR ".join(parts) or "FALSE") + ")"


_NAME = r"(?:\b[A-Z]\. )*[A-Z][-A-Za-z'`]+"
_WHO = rf"{_NAME}(?: and {_NAME}| & {_NAME}| et al\.| et al)*"
_WHEN = r"(?:\d{4}|\d{2})(?:[,;](?: )?(?:\d{4}|\d{2}))*"
_SQL_CITES = [
    (rf"[{{\[(]{_WHO} {_WHEN}(?:[;,] {_WHO} {_WHEN})*[}}\])]", ""), (rf"{_WHO} [{{\[(]{_WHEN}[}}\])]", "Authorsetal"),
    (r"\b(?:[A-Z]\. )*\b[A-Z][A-Za-z|]+ et al\b(?:\.)?", "Authorsetal"), (r"Authorsetal(?:(?:,|;| and|, and) +Authorsetal)+", "Authorsetal"),
]
_SQL_TIDY = [
    (r"^[!,.:;?]", ""), (r"   *", " "), (r"([<{\[(]) ?", r"\1"), (r" ?([])}>!,.:;?])", r"\1"), (r" ?' ?", "'"),
    (r"[<{\[(]([])}>])", r"\1"), (r"[!,.:;?]+([!,.:;?])", r"\1"), (r"\bet al\b\.", "et al"),
]


def _steps(col: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        col = f"regexp_replace({col}, {_q(pattern)}, {_q(to)}, 'g')"
    return col


def _cleanse(col: str, citations: bool) -> str:
    return _steps(col, [*_SQL_TIDY, *(_SQL_CITES if citations else []), (r"^\s+|\s+$", "")])


def _streamline(col: str) -> str:
    return _cleanse(_steps(_cleanse(col, True), [(r"<[A-Z|a-z|/]+>", ""), (r"\bFig\b\.", "Figure"), (r"\bTab\b\.", "Table"), (r"\bvs\b\.", "vs")]), True)


def _marked(col: str) -> str:
    """Sentences parted by chr(1)."""
    for p in ("(.[.?!]) +([(\\[{<])", "(.[.?!][)\\]}>]) +([A-Z])", "(.[.?!]) +([A-Z])"):
        for _ in range(2):
            col = f"regexp_replace({col}, '{p}', '\\1' || chr(1) || '\\2', 'g')"
    return f"replace({col}, chr(10), chr(1))"


GROUPED = A.CALLS + """, n AS (SELECT bibcode, count(DISTINCT run) AS n_runs FROM calls GROUP BY 1),
g0 AS (SELECT bibcode, mission, papertype, round_even(avg(conf_science), 3) AS mean_science, round_even(avg(conf_mention), 3) AS mean_mention,
  round_even(stddev_pop(conf_science), 3) AS std_science, round_even(stddev_pop(conf_mention), 3) AS std_mention, count(*) AS "count" FROM calls GROUP BY 1, 2, 3),
grouped AS (SELECT g0.*, n_runs, round_even(mean_science * "count" / n_runs, 3) AS weighted_science, round_even(mean_mention * "count" / n_runs, 3) AS weighted_mention FROM g0 JOIN n USING (bibcode)),
m0 AS (SELECT bibcode, mission, sum(weighted_science) AS total_science, sum(weighted_mention) AS total_mention FROM grouped GROUP BY 1, 2),
per_mission AS (SELECT *, total_science + total_mention AS total, round_even((total_science + total_mention) / nullif(sum(total_science + total_mention) OVER (PARTITION BY bibcode), 0), 3) AS prob_mission,
  total_science / nullif(total_science + total_mention, 0) AS prob_science, total_mention / nullif(total_science + total_mention, 0) AS prob_mention FROM m0)"""
ROUTED = GROUPED + f""", routed AS (SELECT g.bibcode, g.mission, g.papertype, CASE WHEN greatest(weighted_science, weighted_mention) >= {ROUTE_ACCEPT} THEN 'accept' ELSE 'inspect' END AS route,
  total_science, total_mention, prob_mission FROM grouped g JOIN per_mission USING (bibcode, mission) WHERE greatest(weighted_science, weighted_mention) >= {ROUTE_INSPECT})"""
_CLASS = "CASE WHEN lower({0}) = 'science' THEN 'SCIENCE' ELSE 'NONSCIENCE' END"
PAIRS = ROUTED + ", " + A.TRACK + f""", llm AS (SELECT * FROM routed WHERE route = 'accept'),
grid AS (SELECT bibcode, mission FROM (SELECT DISTINCT doc_id AS bibcode FROM labels), (SELECT unnest({A._array(LABELS)}) AS mission)),
pairs AS (SELECT grid.bibcode, grid.mission, h.papertype AS human_raw, l.papertype AS llm_raw, {_CLASS.format("coalesce(h.papertype, '')")} AS human, {_CLASS.format("coalesce(l.papertype, '')")} AS llm
  FROM grid LEFT JOIN track h USING (bibcode, mission) LEFT JOIN (SELECT bibcode, mission, min(papertype) AS papertype FROM llm GROUP BY 1, 2) l USING (bibcode, mission)),
cells AS (SELECT *, CASE WHEN human = 'SCIENCE' AND llm = 'SCIENCE' THEN 'tp' WHEN human = 'SCIENCE' THEN 'fn' WHEN llm = 'SCIENCE' THEN 'fp' ELSE 'tn' END AS cell FROM pairs),
conf AS (SELECT count(*) FILTER (cell = 'tn') AS tn, count(*) FILTER (cell = 'fp') AS fp, count(*) FILTER (cell = 'fn') AS fn, count(*) FILTER (cell = 'tp') AS tp FROM cells)"""
ROC = PAIRS + """, sc AS (SELECT CASE WHEN human = 'SCIENCE' THEN 1 ELSE 0 END AS label, CASE WHEN llm_raw IS NOT NULL THEN coalesce(round(prob_science, 6), 0.0) ELSE 0.0 END AS score FROM pairs LEFT JOIN per_mission USING (bibcode, mission)),
ps AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM sc GROUP BY 1),
pt AS (SELECT score AS threshold, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM ps),
df AS (SELECT *, tp - lag(tp) OVER w AS t0, lead(tp) OVER w - tp AS t1, fp - lag(fp) OVER w AS f0, lead(fp) OVER w - fp AS f1 FROM pt WINDOW w AS (ORDER BY threshold DESC)),
kept AS (SELECT threshold, tp, fp FROM df WHERE t0 IS NULL OR t1 IS NULL OR t0 <> t1 OR f0 <> f1 UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0),
curve AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tp AS DOUBLE) / (SELECT sum(label) FROM sc) AS tpr, CAST(fp AS DOUBLE) / (SELECT sum(1 - label) FROM sc) AS fpr
  FROM kept)"""


def _calls(s, d):
    return evaluation.explode_calls(A.runs(s, d))


def _grouped(s, d):
    return evaluation.grouped_calls(_calls(s, d))


def _routed(s, d):
    g = _grouped(s, d)
    return evaluation.route(g, evaluation.mission_confidence(g), ROUTE_ACCEPT, ROUTE_INSPECT)


def _llm(s, d):
    return _routed(s, d).where("route = 'accept'")


def _pairs(s, d):
    missions = s.range(1).select(F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("mission"))
    return metrics.label_pairs(A.read(s, d, "labels").select(F.col("doc_id").alias("bibcode")), missions, A.track(s, d), _llm(s, d))


def _scores(s, d):
    sc = metrics.roc_scores(_pairs(s, d), evaluation.mission_confidence(_grouped(s, d)))
    return sc.withColumn("score", F.round("score", 6))


# Evaluation


@query("q_ops_stats", "WITH " + A.CALLS + f""", c AS (SELECT *, greatest(conf_science, conf_mention) AS best FROM calls)
SELECT lower(mission) AS mission, lower(papertype) AS papertype, count(*) AS total_count, count(*) FILTER (best >= {ACCEPT}) AS accepted_count,
  count(DISTINCT bibcode) FILTER (best >= {ACCEPT}) AS accepted_papers, count(*) FILTER (best >= {INSPECT} AND best < {ACCEPT}) AS inspection_count,
  count(DISTINCT bibcode) FILTER (best >= {INSPECT} AND best < {ACCEPT}) AS inspection_papers FROM c GROUP BY 1, 2""")
def q_ops_stats(s, d):
    return evaluation.acceptance_tally(_calls(s, d), ACCEPT, INSPECT)


@query("q_ops_papers", "WITH " + A.CALLS + f""" SELECT DISTINCT lower(mission) AS mission, lower(papertype) AS papertype, CASE WHEN greatest(conf_science, conf_mention) >= {ACCEPT} THEN 'accept' ELSE 'inspect' END AS route, bibcode
FROM calls WHERE greatest(conf_science, conf_mention) >= {INSPECT}""")
def q_ops_papers(s, d):
    return evaluation.acceptance_papers(_calls(s, d), ACCEPT, INSPECT)


@query("q_eval_grouped", "WITH " + GROUPED + " SELECT * FROM grouped")
def q_eval_grouped(s, d):
    return _grouped(s, d)


@query("q_eval_stats", "WITH " + GROUPED + f""", c AS (SELECT *, greatest(mean_science, mean_mention) AS best FROM grouped)
SELECT lower(mission) AS mission, lower(papertype) AS papertype, count(*) AS total_count, count(*) FILTER (best >= {ACCEPT}) AS accepted_count, count(*) FILTER (best >= {INSPECT} AND best < {ACCEPT}) AS inspection_count FROM c GROUP BY 1, 2""")
def q_eval_stats(s, d):
    means = _grouped(s, d).select("bibcode", "mission", "papertype", F.col("mean_science").alias("conf_science"), F.col("mean_mention").alias("conf_mention"))
    return evaluation.acceptance_tally(means, ACCEPT, INSPECT).select("mission", "papertype", "total_count", "accepted_count", "inspection_count")


_MISSION_COLUMNS = "bibcode, mission, round(total_science, 6) AS total_science, round(total_mention, 6) AS total_mention, prob_mission, round(prob_science, 6) AS prob_science, round(prob_mention, 6) AS prob_mention"


@query("q_eval_mission", f"WITH {GROUPED} SELECT {_MISSION_COLUMNS} FROM per_mission")
def q_eval_mission(s, d):
    m = evaluation.mission_confidence(_grouped(s, d))
    return m.select("bibcode", "mission", "prob_mission", *[F.round(c, 6).alias(c) for c in ("total_science", "total_mention", "prob_science", "prob_mention")])


@query("q_eval_routed", f"WITH {ROUTED} SELECT bibcode, mission, papertype, route, round(total_science, 6) AS total_science, round(total_mention, 6) AS total_mention, prob_mission FROM routed")
def q_eval_routed(s, d):
    return _routed(s, d).withColumns({c: F.round(c, 6) for c in ("total_science", "total_mention")})


@query("q_consistency", "WITH " + GROUPED + ", " + A.TRACK + """ SELECT g.*, t.bibcode IS NOT NULL AS in_human_class,
  CASE WHEN t.bibcode IS NULL THEN 0.0 ELSE round_even(CAST(100 AS DOUBLE) * "count" / n_runs, 3) END AS consistency
  FROM grouped g LEFT JOIN track t ON t.bibcode = g.bibcode AND t.mission = g.mission AND t.papertype = g.papertype""")
def q_consistency(s, d):
    return evaluation.consistency(_grouped(s, d), A.track(s, d))


@query("q_missing_missions", "WITH " + A.CALLS + ", " + A.TRACK + """, a AS (SELECT DISTINCT bibcode, mission FROM calls), b AS (SELECT DISTINCT bibcode, mission FROM track WHERE bibcode IN (SELECT bibcode FROM calls)),
x AS (SELECT bibcode, 'human' AS side, mission FROM a WHERE (bibcode, mission) NOT IN (SELECT (bibcode, mission) FROM b) UNION ALL SELECT bibcode, 'llm', mission FROM b WHERE (bibcode, mission) NOT IN (SELECT (bibcode, mission) FROM a))
SELECT bibcode, side, string_agg(mission, ',' ORDER BY mission) AS missions FROM x GROUP BY 1, 2""")
def q_missing_missions(s, d):
    return evaluation.missing_missions(_calls(s, d), A.track(s, d))


@query("q_eval_errors", "WITH " + A.CALLS + """, w AS (SELECT DISTINCT bibcode FROM (SELECT doc_id AS bibcode FROM labels UNION ALL SELECT doc_id + 1 FROM documents))
SELECT bibcode, CASE WHEN bibcode NOT IN (SELECT doc_id FROM documents) THEN 'No paper source found' ELSE 'No mission output found for ' || bibcode END AS error FROM w
WHERE bibcode NOT IN (SELECT doc_id FROM documents) OR bibcode NOT IN (SELECT bibcode FROM calls)""")
def q_eval_errors(s, d):
    wanted = A.read(s, d, "labels").select(F.col("doc_id").alias("bibcode")).union(A.read(s, d, "documents").select(F.col("doc_id") + 1))
    return evaluation.errors(A.papers(s, d), A.runs(s, d), wanted)


# Metrics


@query("q_label_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def q_label_pairs(s, d):
    return _pairs(s, d)


@query("q_confusion", f"WITH {PAIRS} SELECT *, coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0) AS tnr, coalesce(fp / nullif(CAST(tn + fp AS DOUBLE), 0), 0) AS fpr, coalesce(fn / nullif(CAST(fn + tp AS DOUBLE), 0), 0) AS fnr, coalesce(tp / nullif(CAST(fn + tp AS DOUBLE), 0), 0) AS tpr FROM conf")
def q_confusion(s, d):
    return metrics.confusion(_pairs(s, d))


@query("q_confusion_cells", f"WITH {PAIRS} SELECT cell, bibcode, mission, human_raw, llm_raw FROM cells")
def q_confusion_cells(s, d):
    return metrics.confusion_cells(_pairs(s, d))


_DIV = "coalesce(CAST({0} AS DOUBLE) / nullif({1}, 0), 0)"
_REPORT = PAIRS + f""", two AS (SELECT 'NONSCIENCE' AS label, {_DIV.format('tn', 'tn + fn')} AS precision, {_DIV.format('tn', 'tn + fp')} AS recall, {_DIV.format('2 * tn', '2 * tn + fn + fp')} AS f1, tn + fp AS support FROM conf
UNION ALL SELECT 'SCIENCE', {_DIV.format('tp', 'tp + fp')}, {_DIV.format('tp', 'tp + fn')}, {_DIV.format('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM conf),
rep AS (SELECT * FROM two UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp) AS a, tn + fp + fn + tp AS n FROM conf)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM two
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM two)"""


@query("q_class_report", f"WITH {_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep")
def q_class_report(s, d):
    return metrics.class_report(_pairs(s, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("q_roc_points", f"WITH {ROC} SELECT threshold, tp, fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM curve")
def q_roc_points(s, d):
    return metrics.roc_curve(_scores(s, d)).withColumns({c: F.round(c, 9) for c in ("tpr", "fpr")})


@query("q_auc", f"WITH {ROC}, st AS (SELECT fpr - lag(fpr) OVER (ORDER BY threshold DESC) AS dx, tpr + lag(tpr) OVER (ORDER BY threshold DESC) AS y FROM curve) SELECT round(sum(dx * y / 2), 9) AS auc FROM st")
def q_auc(s, d):
    return metrics.auc(_scores(s, d)).select(F.round("auc", 9).alias("auc"))


@query("q_roc_nearest", f"""WITH {ROC}, k AS (SELECT i / CAST(10 AS DOUBLE) AS wanted FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS i)),
r AS (SELECT wanted, threshold, tpr, fpr, row_number() OVER (PARTITION BY wanted ORDER BY abs(threshold - wanted), threshold DESC) AS n FROM k, curve WHERE threshold < CAST('inf' AS DOUBLE))
SELECT wanted, threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM r WHERE n = 1""")
def q_roc_nearest(s, d):
    return metrics.nearest_thresholds(metrics.roc_curve(_scores(s, d))).withColumns({c: F.round(c, 9) for c in ("tpr", "fpr")})


@query("q_callouts", f"""WITH {PAIRS} SELECT count(DISTINCT bibcode) AS n_bibcodes, count(human_raw) AS n_human_callouts, count(llm_raw) AS n_llm_callouts,
  count(*) FILTER (human_raw IS NOT NULL AND llm_raw IS NOT NULL) AS n_both_callouts, (SELECT count(DISTINCT mission) FROM llm WHERE mission NOT IN ('HST', 'JWST', 'KEPLER')) AS n_non_mission
  FROM pairs WHERE mission IN ('HST', 'JWST', 'KEPLER')""")
def q_callouts(s, d):
    names = ["HST", "JWST", "KEPLER"]
    return metrics.callouts(_pairs(s, d).where(F.col("mission").isin(names)), A.track(s, d), _llm(s, d), names)


_AUDIT = PAIRS + """, au AS (SELECT t.bibcode, t.mission, t.papertype AS human, count(l.papertype) AS n, coalesce(bool_or(l.papertype = t.papertype), FALSE) AS eq, coalesce(bool_or(l.papertype = 'SCIENCE'), FALSE) AS sc
  FROM track t LEFT JOIN llm l USING (bibcode, mission) GROUP BY 1, 2, 3),
audit AS (SELECT bibcode, mission, human, CASE WHEN n = 0 AND human = 'SCIENCE' THEN 'false_negative_because_ignored' WHEN n = 0 THEN 'ignored' WHEN eq THEN 'matched' WHEN human = 'SCIENCE' THEN 'false_negative' WHEN sc THEN 'false_positive' END AS result FROM au)"""


@query("q_audit", f"WITH {_AUDIT} SELECT * FROM audit")
def q_audit(s, d):
    return metrics.audit(A.track(s, d), _llm(s, d))


@query("q_audit_summary", f"""WITH {_AUDIT} SELECT count(DISTINCT bibcode) AS n_papers, count(*) AS n_classifications, count(*) FILTER (result = 'false_positive') AS false_positive, count(*) FILTER (result = 'false_negative') AS false_negative,
  count(*) FILTER (result = 'false_negative_because_ignored') AS false_negative_because_ignored, count(*) FILTER (result = 'ignored') AS ignored FROM audit WHERE result <> 'matched'""")
def q_audit_summary(s, d):
    return metrics.audit_summary(metrics.audit(A.track(s, d), _llm(s, d)))


@query("q_audit_flags", f"""WITH {_AUDIT}, fl AS (SELECT *, bibcode % 7 = 0 AS flag FROM audit) SELECT count(DISTINCT bibcode) AS n_papers, count(*) AS n_classifications, count(*) FILTER (result = 'false_positive') AS false_positive,
  count(*) FILTER (result = 'false_negative') AS false_negative, count(*) FILTER (result = 'false_negative_because_ignored') AS false_negative_because_ignored, count(*) FILTER (result = 'ignored') AS ignored, count(*) FILTER (flag) AS flag
  FROM fl WHERE flag OR result <> 'matched'""")
def q_audit_flags(s, d):
    return metrics.audit_summary(metrics.audit(A.track(s, d), _llm(s, d)).withColumn("flag", F.col("bibcode") % 7 == 0))


@query("q_callouts_full", f"""WITH {PAIRS}, failed AS (SELECT doc_id AS bibcode FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id NOT IN (SELECT bibcode FROM calls)),
own AS (SELECT count(DISTINCT bibcode) AS n_bibcodes, count(human_raw) AS n_human_callouts, count(llm_raw) AS n_llm_callouts, count(*) FILTER (human_raw IS NOT NULL AND llm_raw IS NOT NULL) AS n_both_callouts FROM pairs),
wrong AS (SELECT DISTINCT bibcode, mission FROM calls WHERE bibcode % 2 = 0)
SELECT own.*, 0 AS n_non_mission, (SELECT count(DISTINCT bibcode) FROM failed) AS n_missing_output, (SELECT count(*) FROM wrong WHERE (bibcode, mission) IN (SELECT (bibcode, mission) FROM track)) AS n_joint_hallucinations FROM own""")
def q_callouts_full(s, d):
    """Calls of papers with an even bibcode stand for hallucinated ones."""
    ids = A.read(s, d, "labels").select(F.col("doc_id").alias("bibcode"))
    papers = A.read(s, d, "documents").select(F.col("doc_id").alias("bibcode"))
    return metrics.callouts(_pairs(s, d), A.track(s, d), _llm(s, d), list(LABELS), evaluation.errors(papers, A.runs(s, d), ids), _calls(s, d).where("bibcode % 2 = 0"))


@query("q_auc_classes", f"""WITH {A.CALLS}, {A.TRACK}, r AS (SELECT c.*, CASE WHEN t.papertype = 'SCIENCE' THEN 'science' WHEN t.papertype = 'MENTION' THEN 'mention' ELSE 'other' END AS actual FROM calls c JOIN track t USING (bibcode)),
dec AS (SELECT 'science' AS class, actual, round(conf_science, 6) AS score FROM r UNION ALL SELECT 'mention', actual, round(conf_mention, 6) FROM r UNION ALL SELECT 'other', actual, round(conf_science * conf_mention, 6) FROM r),
lab AS (SELECT class, CASE WHEN actual = class THEN 1 ELSE 0 END AS label, score FROM dec UNION ALL SELECT 'micro', CASE WHEN actual = class THEN 1 ELSE 0 END, score FROM dec),
per AS (SELECT class, score, sum(label) AS p, sum(1 - label) AS n FROM lab GROUP BY 1, 2),
cum AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM per),
own AS (SELECT class, coalesce(CAST(sum(n * (above + p / CAST(2 AS DOUBLE))) AS DOUBLE) / nullif(CAST(sum(p) * sum(n) AS DOUBLE), 0), 0) AS auc FROM cum GROUP BY 1)
SELECT class, round(auc, 9) AS auc FROM own UNION ALL SELECT 'macro', round(avg(auc), 9) FROM own WHERE class <> 'micro'""")
def q_auc_classes(s, d):
    actual = F.when(F.col("human") == "SCIENCE", "science").when(F.col("human") == "MENTION", "mention").otherwise("other")
    probs = F.create_map(F.lit("science"), F.col("conf_science"), F.lit("mention"), F.col("conf_mention"), F.lit("other"), F.col("conf_science") * F.col("conf_mention"))
    rows = _calls(s, d).join(A.track(s, d).select("bibcode", F.col("papertype").alias("human")), "bibcode").select(actual.alias("actual"), probs.alias("probs"))
    return metrics.auc_per_class(rows, ["science", "mention", "other"]).withColumn("auc", F.round("auc", 9))


@query("q_mask_class", f"WITH {A.TRACK} SELECT CASE papertype WHEN 'SCIENCE' THEN 'science' WHEN 'MENTION' THEN 'mention' WHEN 'SUPERMENTION' THEN 'mention' WHEN 'DATA_INFLUENCED' THEN 'data_influenced' ELSE 'other' END AS mask, count(*) AS n FROM track GROUP BY 1")
def q_mask_class(s, d):
    return A.track(s, d).groupBy(metrics.mask_class(F.col("papertype")).alias("mask")).agg(F.count("*").alias("n"))


@query("q_evaluate", "WITH " + ROUTED + f""", {A.TRACK}, names AS (SELECT doc_id AS bibcode, ({A._array(LABELS)})[CAST(doc_id % {len(LABELS)} AS INTEGER) + 1] AS mission FROM documents)
SELECT g.bibcode, g.mission, g.papertype, g."count", g.weighted_science, t.bibcode IS NOT NULL AS in_human_class, CASE WHEN t.bibcode IS NOT NULL THEN round_even(100.0 * g."count" / g.n_runs, 3) ELSE 0 END AS consistency, r.route, n.bibcode IS NULL AS hallucinated
FROM grouped g LEFT JOIN track t ON t.bibcode = g.bibcode AND t.mission = g.mission AND t.papertype = g.papertype LEFT JOIN routed r ON r.bibcode = g.bibcode AND r.mission = g.mission AND r.papertype = g.papertype
LEFT JOIN names n ON n.bibcode = g.bibcode AND n.mission = g.mission WHERE g.bibcode IN (SELECT doc_id FROM documents)""")
def q_evaluate(s, d):
    """One call from runs to summary; of each paper the text is taken to name one mission."""
    return _evaluated(s, d)["classes"].select("bibcode", "mission", "papertype", "count", "weighted_science", "in_human_class", "consistency", "route", "hallucinated")


def _evaluated(s, d, wanted=None, runs=None):
    papers = A.read(s, d, "documents").select(F.col("doc_id").alias("bibcode"))
    found = papers.select("bibcode", A._pick(LABELS, F.col("bibcode")).alias("mission"))
    wanted = wanted or A.read(s, d, "labels").select(F.col("doc_id").alias("bibcode"))
    return evaluation.evaluate(papers, runs or A.runs(s, d), A.track(s, d), found, wanted, ROUTE_ACCEPT, ROUTE_INSPECT)


_EVALUATED = f"""{A.TRACK}, names AS (SELECT doc_id AS bibcode, ({A._array(LABELS)})[CAST(doc_id % {len(LABELS)} AS INTEGER) + 1] AS mission FROM documents),
done AS (SELECT * FROM calls WHERE bibcode IN (SELECT doc_id FROM documents))"""


@query("q_evaluate_missions", f"WITH {ROUTED} SELECT bibcode, mission, round(total_science, 6) AS total_science, round(total_mention, 6) AS total_mention, prob_mission FROM per_mission WHERE bibcode IN (SELECT doc_id FROM documents)")
def q_evaluate_missions(s, d):
    return _evaluated(s, d)["missions"].select("bibcode", "mission", *[F.round(c, 6).alias(c) for c in ("total_science", "total_mention")], "prob_mission")


@query("q_evaluate_missing", f"""WITH {A.CALLS}, {_EVALUATED}, a AS (SELECT DISTINCT bibcode, mission FROM done), b AS (SELECT DISTINCT bibcode, mission FROM track WHERE bibcode IN (SELECT bibcode FROM done)),
x AS (SELECT bibcode, 'human' AS side, mission FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT bibcode, 'llm', mission FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT bibcode, side, string_agg(mission, ',' ORDER BY mission) AS missions FROM x GROUP BY 1, 2""")
def q_evaluate_missing(s, d):
    return _evaluated(s, d)["missing"]


@query("q_evaluate_hallucinated", f"WITH {A.CALLS}, {_EVALUATED} SELECT bibcode, mission FROM done EXCEPT SELECT * FROM names")
def q_evaluate_hallucinated(s, d):
    return _evaluated(s, d)["hallucinated"].select("bibcode", "mission")


@query("q_evaluate_errors", f"""WITH {A.CALLS}, {_EVALUATED}, w AS (SELECT DISTINCT bibcode, bibcode IN (SELECT doc_id FROM documents) AS sourced FROM (SELECT doc_id AS bibcode FROM labels UNION ALL SELECT doc_id + 1 FROM documents)),
l AS (SELECT bibcode, string_agg(DISTINCT upper(mission) || ':' || papertype, ',' ORDER BY upper(mission) || ':' || papertype) AS labels FROM track GROUP BY 1)
SELECT bibcode, CASE WHEN sourced THEN 'No mission output found for ' || bibcode ELSE 'No paper source found' END AS error, CASE WHEN sourced THEN labels END AS human FROM w LEFT JOIN l USING (bibcode) WHERE NOT sourced OR bibcode % 9 = 0 OR bibcode NOT IN (SELECT bibcode FROM calls)""")
def q_evaluate_errors(s, d):
    """Papers without a source too; of every ninth no run came back."""
    wanted = A.read(s, d, "labels").select(F.col("doc_id").alias("bibcode")).union(A.read(s, d, "documents").select(F.col("doc_id") + 1))
    return _evaluated(s, d, wanted, A.runs(s, d).where("bibcode % 9 <> 0"))["errors"]


# Dataset


@query("q_flatten_several", f"""WITH {A.SEVERAL}, k AS (SELECT s.*, CASE mission {' '.join(f"WHEN '{m.label}' THEN '{m.name}'" for m in MISSIONS)} END AS name FROM several s WHERE papertype IN ('SCIENCE', 'MENTION'))
SELECT doc_id AS ord, doc_id AS bibcode, papertype AS class, name AS mission, row_number() OVER (PARTITION BY doc_id ORDER BY name, papertype) - 1 AS i_mission, doc_id || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY name, papertype) - 1) AS id FROM documents JOIN k ON doc_id = bibcode""")
def q_flatten_several(s, d):
    """Papers with one to three labels, of one or more classes, some of them repeated."""
    return dataset.flatten(A.papers(s, d), A.several(s, d), _TYPES).drop("text")


@query("q_numbered", f"""WITH {A.SEVERAL}, o AS (SELECT bibcode, row_number() OVER (ORDER BY bibcode) - 1 AS i_track FROM (SELECT DISTINCT bibcode FROM several))
SELECT s.bibcode, s.mission, s.papertype, i_track FROM several s JOIN o USING (bibcode)""")
def q_numbered(s, d):
    return dataset.numbered(A.several(s, d).withColumn("ord", F.col("bibcode"))).select("bibcode", "mission", "papertype", "i_track")


@query("q_limit_several", f"""WITH {A.SEVERAL}, c AS (SELECT bibcode AS ord, bibcode, count(*) AS n FROM several GROUP BY bibcode), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT s.bibcode, s.mission, s.papertype FROM several s JOIN r USING (bibcode) WHERE before < 1000""")
def q_limit_several(s, d):
    return dataset.limit_papers(A.several(s, d).withColumn("ord", F.col("bibcode")), 1000).select("bibcode", "mission", "papertype")


_LEVELS = A.SEVERAL + """, per AS (SELECT bibcode, list_sort(list(DISTINCT papertype)) AS classes FROM several GROUP BY 1), names AS (SELECT list_sort(list(DISTINCT papertype)) AS cs FROM several),
multi AS (SELECT bibcode, list_transform(classes, lambda c: list_position(cs, c)) AS members, row_number() OVER (ORDER BY md5('10|' || bibcode), bibcode) AS i FROM per, names WHERE len(classes) > 1),
steps AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS bibcode, NULL::BIGINT AS pick, (SELECT list(n ORDER BY c) FROM (SELECT c, count(p.bibcode) AS n FROM (SELECT unnest(cs) AS c FROM names) LEFT JOIN (SELECT bibcode, classes[1] AS c FROM per WHERE len(classes) = 1) p USING (c) GROUP BY c)) AS counts
  UNION ALL SELECT i, bibcode, pick, list_transform(counts, lambda x, j: x + CASE WHEN j = pick THEN 1 ELSE 0 END) FROM (SELECT m.i, m.bibcode, counts, list_sort(list_transform(members, lambda c: {'n': counts[c], 'c': c}))[1].c AS pick FROM steps JOIN multi m ON m.i = steps.i + 1)),
rep AS (SELECT bibcode, classes[1] AS class FROM per WHERE len(classes) = 1 UNION ALL SELECT bibcode, (SELECT cs FROM names)[pick] FROM steps WHERE i > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('10|' || bibcode), bibcode) AS k FROM rep), lo AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM rep GROUP BY class))
SELECT bibcode, class, CASE WHEN k <= round_even(0.8 * n, 0) THEN 'train' WHEN k <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'validate' ELSE 'test' END AS split FROM o, lo"""


@query("q_tvt_several", f"WITH RECURSIVE {_LEVELS}")
def q_tvt_several(s, d):
    """Papers of several classes among them, levelled one by one."""
    return dataset.tvt_split(A.several(s, d).select("bibcode", F.col("papertype").alias("class")))


@query("q_combine", "WITH " + A.PAPERS + ", " + A.TRACK + """ SELECT p.bibcode, t.mission, t.papertype, p.bibcode % 2 = 0 AS ignored, length(p.body) AS n_chars FROM papers p JOIN track t USING (bibcode)""")
def q_combine(s, d):
    both = dataset.combine(A.papers(s, d), A.track_nested(s, d))
    return both.select("bibcode", F.explode("class_missions").alias("mission", "c"), "is_ignored", "body").select("bibcode", "mission", F.col("c.papertype").alias("papertype"), F.map_values("is_ignored")[0].alias("ignored"), F.length("body").alias("n_chars"))


@query("q_text_only", "SELECT doc_id AS bibcode, doc_id AS ord FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_text_only(s, d):
    return dataset.only_in(A.papers(s, d), A.track(s, d), ["bibcode", "ord"])


@query("q_track_only", "SELECT DISTINCT doc_id * 3 AS bibcode FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents)")
def q_track_only(s, d):
    return dataset.only_in(A.track(s, d).select((F.col("bibcode") * 3).alias("bibcode")), A.papers(s, d), ["bibcode"])


@query("q_dup_check", "SELECT user_id AS bibcode, count(*) AS \"count\" FROM events GROUP BY 1 HAVING count(*) > 1")
def q_dup_check(s, d):
    return dataset.duplicates(A.read(s, d, "events").select(F.col("user_id").alias("bibcode")))


@query("q_dedup_first", "SELECT user_id AS bibcode, min(event_id) AS ord FROM events GROUP BY 1")
def q_dedup_first(s, d):
    return dataset.first_per_paper(A.read(s, d, "events").select(F.col("user_id").alias("bibcode"), F.col("event_id").alias("ord")))


_FLAT = A.TRACK + f""", flat AS (SELECT doc_id AS ord, doc_id AS bibcode, papertype AS class, CASE mission {' '.join(f"WHEN '{m.label}' THEN '{next(x.name for x in MISSIONS if x.label == (m.label))}'" for m in MISSIONS)} END AS mission,
  0 AS i_mission, doc_id || '_0' AS id FROM documents JOIN track ON doc_id = bibcode WHERE papertype IN ('SCIENCE', 'MENTION'))"""
_TYPES = ["SCIENCE", "MENTION"]


@query("q_flatten", f"WITH {_FLAT} SELECT * FROM flat")
def q_flatten(s, d):
    return dataset.flatten(A.papers(s, d), A.track(s, d), _TYPES).drop("text")


@query("q_limit_closed", f"WITH {_FLAT} SELECT ord, bibcode, id FROM (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM flat) WHERE n <= 100")
def q_limit_closed(s, d):
    return dataset.limit_papers(dataset.flatten(A.papers(s, d), A.track(s, d), _TYPES).select("ord", "bibcode", "id"), 100)


_SPLIT = A.TRACK + """, o AS (SELECT bibcode, papertype AS class, row_number() OVER (PARTITION BY papertype ORDER BY md5('10|' || bibcode), bibcode) AS k FROM track),
lo AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM track GROUP BY papertype)),
split AS (SELECT bibcode, class, CASE WHEN k <= round_even(0.8 * n, 0) THEN 'train' WHEN k <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'validate' ELSE 'test' END AS split FROM o, lo)"""


@query("q_tvt_split", f"WITH {_SPLIT} SELECT * FROM split")
def q_tvt_split(s, d):
    return dataset.tvt_split(A.track(s, d).select("bibcode", F.col("papertype").alias("class")))


@query("q_tvt_counts", f"WITH {_SPLIT} SELECT class, split, count(*) AS n FROM split GROUP BY 1, 2")
def q_tvt_counts(s, d):
    return q_tvt_split(s, d).groupBy("class", "split").agg(F.count("*").alias("n"))


@query("q_truth_table", "WITH " + A.TRACK + f""" SELECT p.doc_id AS bibcode, m.mission, coalesce(t.papertype, 'rejection') AS class FROM documents p, (SELECT unnest({A._array(LABELS)}) AS mission) m LEFT JOIN track t ON t.bibcode = p.doc_id AND t.mission = m.mission""")
def q_truth_table(s, d):
    return dataset.truth_table(A.papers(s, d), A.track(s, d), list(LABELS))


@query("q_test_papers", f"WITH {_SPLIT} SELECT doc_id AS bibcode FROM documents WHERE doc_id IN (SELECT bibcode FROM split WHERE split = 'test')")
def q_test_papers(s, d):
    return A.papers(s, d).select("bibcode").join(q_tvt_split(s, d).where("split = 'test'"), "bibcode", "left_semi")


# Text


@query("q_cleanse", f"WITH {A.PAPERS} SELECT bibcode, md5({_cleanse('body', False)}) AS h FROM papers")
def q_cleanse(s, d):
    return A.papers(s, d).select("bibcode", F.md5(T.cleanse(F.col("body"))).alias("h"))


@query("q_streamline", f"WITH {A.PAPERS} SELECT bibcode, md5({_streamline('body')}) AS h FROM papers")
def q_streamline(s, d):
    return A.papers(s, d).select("bibcode", F.md5(T.streamline(F.col("body"))).alias("h"))


@query("q_sentences", f"WITH {A.PAPERS}, m AS (SELECT bibcode, {_marked('body')} AS t FROM papers) SELECT bibcode, len(string_split(t, chr(1))) AS n, md5(t) AS h FROM m")
def q_sentences(s, d):
    t = T.sentences(F.col("body"))
    return A.papers(s, d).select("bibcode", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, "\x01")).alias("h"))


def _hits(mode):
    return f"WITH {A.PAPERS}, m AS (SELECT bibcode, array_to_string(list_filter([{', '.join(f'CASE WHEN {_mentions("body", m, mode)} THEN {chr(39)}{m.label}{chr(39)} END' for m in MISSIONS)}], lambda x: x IS NOT NULL), ',') AS missions FROM papers) SELECT * FROM m WHERE missions <> ''"


def _named(papers, mode=None):
    """An outer generator of one element: a filter on a plain column would compute it twice, and before a small file is dealt to all cores."""
    found = F.array_join(T.missions_of(F.col("body"), mode=mode), ",")
    return papers.select("bibcode", F.explode_outer(F.array(found)).alias("missions")).where("missions <> ''")


@query("q_keyword_hits", _hits(None))
def q_keyword_hits(s, d):
    return _named(A.papers(s, d))


@query("q_keyword_mode", _hits("acronym"))
def q_keyword_mode(s, d):
    return _named(A.papers(s, d), "acronym")


@query("q_first_keyword", f"WITH {A.PAPERS} SELECT bibcode, coalesce({', '.join(f'CASE WHEN {_mentions("body", m)} THEN {chr(39)}{m.label}{chr(39)} END' for m in MISSIONS)}) AS mission FROM papers")
def q_first_keyword(s, d):
    return A.papers(s, d).select("bibcode", T.first_mission(F.col("body")).alias("mission"))


def _anon(col, m):
    """RE2 takes word boundaries as ASCII's, so the characters beside an acronym are spelt out."""
    for p in m.phrases:
        col = f"regexp_replace({col}, {_q('(?i)' + chr(92) + 'b' + p + chr(92) + 'b')}, 'OBJ', 'g')"
    for words, case in ((m.cased, ""), (m.uncased, "(?i)")):
        if words:
            spelt = "|".join(r"(?:\.)?(?: )?(?:-)?".join(w) for w in words)
            guarded = case + r"(^|[^.\p{L}\p{M}\p{N}_])(?:" + spelt + r")(?:\.($|[^A-Za-z|])|($|[^|\p{L}\p{M}\p{N}_]))"
            col = f"regexp_replace({col}, {_q(guarded)}, '\\1OBJ\\2\\3', 'g')"
    return col


@query("q_anonymise", f"WITH {A.PAPERS} SELECT bibcode, {', '.join(f'md5({_anon("body", m)}) AS {m.label.lower()}' for m in MISSIONS)} FROM papers")
def q_anonymise(s, d):
    """Of every mission the text without its terms."""
    named = T.missions_of(F.col("body"), tuple(T.unbanned(m) for m in MISSIONS))
    found = A.papers(s, d).select("bibcode", "body", named.alias("named"))
    return found.select("bibcode", *[F.md5(T.anonymise(F.col("body"), m, named=F.array_contains("named", m.label))).alias(m.label.lower()) for m in MISSIONS])


_SENT = A.PAPERS + f", m AS (SELECT bibcode, {_marked('body')} AS t FROM papers), s AS (SELECT bibcode, unnest(string_split(t, chr(1))) AS sentence, unnest(range(len(string_split(t, chr(1))))) AS i, len(string_split(t, chr(1))) - 1 AS last FROM m)"
_HIT = _SENT + ", hit AS (" + " UNION ALL ".join(f"SELECT bibcode, i, last, '{m.label}' AS mission FROM s WHERE {_mentions('sentence', m)}" for m in MISSIONS) + ")"


def _rules_by_mission(m) -> str:
    clear = tuple(p for p in m.phrases if p not in m.ambiguous)
    sure = [_mentions("sentence", m, "acronym")] + ([_mentions("sentence", type(m)(m.label, clear, m.cased, m.uncased, m.banned), "keyword")] if clear else [])
    return f"SELECT bibcode, i, '{m.label}' AS mission, CASE {' '.join(f'WHEN {x} THEN TRUE' for x in sure)} WHEN NOT {_mentions('sentence', m)} THEN FALSE END AS verdict FROM s"


@query("q_truematch_fast", f"WITH {_SENT} " + " UNION ALL ".join(_rules_by_mission(m) for m in MISSIONS))
def q_truematch_fast(s, d):
    rows = paragraphs.sentence_rows(A.papers(s, d), F.col("body"))
    return rows.select("bibcode", F.col("i").cast("long").alias("i"), F.inline_outer(paragraphs.verdicts(F.col("sentence"))))  # an inner one would compute them twice


_SPANS = """, w AS (SELECT DISTINCT bibcode, mission, i, greatest(i - {b}, 0) AS lo, least(i + {b}, last) AS hi FROM hit),
j AS (SELECT *, CASE WHEN lag(i + {b}) OVER (PARTITION BY bibcode, mission ORDER BY i) >= lo AND {b} > 0 THEN 0 ELSE 1 END AS begins FROM w),
k AS (SELECT *, sum(begins) OVER (PARTITION BY bibcode, mission ORDER BY i) AS island FROM j),
span AS (SELECT bibcode, mission, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi FROM k GROUP BY bibcode, mission, island)"""


@query("q_span_merge", f"WITH {_HIT}{_SPANS.format(b=1)} SELECT * FROM span")
def q_span_merge(s, d):
    hits = paragraphs.mission_sentences(paragraphs.sentence_rows(A.papers(s, d), F.col("body")))
    return paragraphs.merge_spans(hits, ["bibcode", "mission"], 1).withColumns({c: F.col(c).cast("long") for c in ("lo", "hi")})


@query("q_paragraphs", f"WITH {_HIT}{_SPANS.format(b=2)} SELECT p.bibcode, p.mission, p.lo, p.hi, md5(string_agg(s.sentence, ' ' ORDER BY s.i)) AS h FROM span p JOIN s ON s.bibcode = p.bibcode AND s.i BETWEEN p.lo AND p.hi GROUP BY 1, 2, 3, 4")
def q_paragraphs(s, d):
    p = paragraphs.paragraphs(A.papers(s, d), F.col("body"), 2)
    return p.select("bibcode", "mission", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.md5("paragraph").alias("h"))


@query("q_missions_in_text", f"WITH {_HIT} SELECT DISTINCT bibcode, mission FROM hit")
def q_missions_in_text(s, d):
    return paragraphs.missions_in_text(A.papers(s, d), F.col("body"))


@query("q_hallucinated", f"WITH {_HIT}, {A.CALLS} SELECT DISTINCT bibcode, mission FROM calls WHERE (bibcode, mission) NOT IN (SELECT (bibcode, mission) FROM hit)")
def q_hallucinated(s, d):
    return evaluation.hallucinated(_calls(s, d), paragraphs.missions_in_text(A.papers(s, d), F.col("body")))


_FLAGS = {
    "is_keyword": " OR ".join(_mentions("sentence", m) for m in MISSIONS), "is_pron_1st": "regexp_matches(plain, '(?i)\\b(i|me|my|mine|myself|we|us|our|ours|ourselves)\\b')",
    "is_pron_3rd": "regexp_matches(plain, '(?i)\\b(he|him|his|himself|she|her|hers|herself|they|them|their|theirs|themselves)\\b')",
    "is_term_fig": "regexp_matches(plain, '(?i)\\b(figures?|fig|tables?|tab|plots?|images?|panels?|graphs?)\\b')", "is_etal": "regexp_matches(plain, '\\b[A-Z][A-Z|a-z]+etal\\b|\\bet al\\b')",
}


@query("q_importance", f"WITH {_SENT}, f AS (SELECT bibcode, {', '.join(f'({v}) AS {k}' for k, v in _FLAGS.items())} FROM (SELECT *, {_ascii('sentence')} AS plain FROM s)) SELECT bibcode, {', '.join(f'count(*) FILTER ({k}) AS n_{k[3:]}' for k in _FLAGS)}, count(*) FILTER ({' OR '.join(_FLAGS)}) AS n_any FROM f GROUP BY 1")
def q_importance(s, d):
    """Sentences of each paper by why they matter."""
    rows = paragraphs.sentence_rows(A.papers(s, d), F.col("body")).select("bibcode", T.importance(F.col("sentence")).alias("f"))
    return rows.groupBy("bibcode").agg(*[F.count_if(f"f.{k}").alias(f"n_{k[3:]}") for k in (*_FLAGS, "is_any")])


@query("q_source_order", "WITH d AS (SELECT *, row_number() OVER () - 1 AS ord FROM documents) SELECT source, lang, min(ord) AS ord, arg_min(doc_id, ord) AS doc_id, count(*) AS n FROM d GROUP BY 1, 2")
def q_source_order(s, d):
    """The first document of each source and language as the file lists them."""
    rows = order.numbered(A.read(s, d, "documents")).select("source", "lang", "ord", "doc_id")
    first = order.first_by(rows, ["source", "lang"])
    return first.join(rows.groupBy("source", "lang").agg(F.count("*").alias("n")), ["source", "lang"])


@query("q_modif_anon", f"WITH {_HIT}, p AS (SELECT h.bibcode, h.i, s.sentence FROM hit h JOIN s ON s.bibcode = h.bibcode AND s.i = h.i WHERE h.mission = 'HST') SELECT bibcode, md5(string_agg({_streamline(_anon('sentence', BY_LABEL['HST']))}, chr(10) ORDER BY i)) AS h FROM p GROUP BY 1")
def q_modif_anon(s, d):
    p = paragraphs.paragraphs(A.papers(s, d), F.col("body"), 0, (BY_LABEL["HST"],))
    anon = p.select("bibcode", "lo", T.streamline(T.anonymise(F.col("paragraph"), BY_LABEL["HST"])).alias("t"))
    return anon.groupBy("bibcode").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "t"))), lambda x: x["t"]), "\n")).alias("h"))


@query("q_prompt_fill", f"WITH {A.PAPERS} SELECT bibcode, md5('Title: ' || title || chr(10) || 'Abstract: ' || chr(10) || body || chr(10) || '{{keep}}') AS h FROM papers")
def q_prompt_fill(s, d):
    prompt = T.fill_prompt("Title: {title}\nAbstract: {abstract}\n{body}\n{keep}", {"title": F.col("title")[0], "abstract": F.col("abstract"), "body": F.col("body")})
    return A.papers(s, d).select("bibcode", F.md5(prompt).alias("h"))


@query("q_searchable", f"WITH {A.PAPERS} SELECT bibcode, md5(title || '; ' || '' || '; ' || body) AS h FROM papers")
def q_searchable(s, d):
    return A.papers(s, d).select("bibcode", F.md5(T.searchable(F.col("title"), F.col("abstract"), F.col("body"))).alias("h"))


# Batches


_STATS = A.LINES + """, st AS (SELECT count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, avg(CAST(greatest(1, len(regexp_split_to_array(trim(line), '\\s+'))) AS BIGINT)) AS avg_tokens FROM lines),
stats AS (SELECT *, CAST(floor(avg_tokens * n_lines) AS BIGINT) AS total_tokens FROM st)"""
_PLAN = _STATS + """, p1 AS (SELECT *, CAST(greatest(ceil(n_lines / 100.0), ceil(n_bytes / 5000.0), ceil(total_tokens / 300.0), 1) AS BIGINT) AS base_chunks FROM stats),
p2 AS (SELECT *, CAST(ceil(n_lines / CAST(base_chunks AS DOUBLE)) AS BIGINT) AS lines_per_chunk, CAST(ceil(total_tokens / CAST(base_chunks AS DOUBLE)) AS BIGINT) AS tokens_per_chunk FROM p1),
p3 AS (SELECT *, greatest(1, least(base_chunks, 300 // greatest(1, tokens_per_chunk))) AS chunks_per_day FROM p2),
plan AS (SELECT *, CAST(greatest(1, ceil(base_chunks / CAST(chunks_per_day AS DOUBLE))) AS BIGINT) AS days FROM p3)"""


@query("q_chunk_stats", f"WITH {_STATS} SELECT *, n_lines < 50000 AND n_bytes < 209715200 AS ok FROM stats")
def q_chunk_stats(s, d):
    return batching.within_limits(batching.file_statistics(A.lines(s, d)))


@query("q_chunk_plan", f"WITH {_PLAN} SELECT * FROM plan")
def q_chunk_plan(s, d):
    return batching.chunk_plan(batching.file_statistics(A.lines(s, d)), 100, 5000, 300)


@query("q_chunk_assign", f"WITH {A.LINES}, o AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS number FROM lines) SELECT ord, number, number // 40 + 1 AS chunk, (number // 40) // 3 + 1 AS day FROM o")
def q_chunk_assign(s, d):
    return batching.assign_chunks(A.lines(s, d), 40, 3).drop("line")


@query("q_daily_quota", f"""WITH {A.LOG}, f AS (SELECT CAST(min(ts) AS DATE) AS first FROM log)
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, greatest(0, 500000 - CAST(sum(tokens) AS BIGINT)) AS tokens_left, date_diff('day', first, CAST(ts AS DATE)) + 1 AS campaign_day FROM log, f GROUP BY CAST(ts AS DATE), first""")
def q_daily_quota(s, d):
    return batching.daily_quota(A.log(s, d), 500_000).withColumn("day", F.col("day").cast("string"))


@query("q_pending", f"WITH {A.LINES}, {A.LOG} SELECT DISTINCT ord AS chunk FROM lines WHERE ord NOT IN (SELECT chunk * 2 FROM log) ORDER BY ord LIMIT 20")
def q_pending(s, d):
    log = A.log(s, d).select((F.col("chunk") * 2).alias("chunk"))
    return batching.pending(A.lines(s, d).select(F.col("ord").alias("chunk")).distinct(), log, 20)


@query("q_submission_status", f"WITH {A.LINES}, {A.LOG}, x AS (SELECT ord IN (SELECT chunk * 2 FROM log) AS sent FROM lines) SELECT count(*) AS total, count(*) FILTER (sent) AS submitted, count(*) FILTER (NOT sent) AS remaining FROM x")
def q_submission_status(s, d):
    return batching.submission_status(A.lines(s, d).select(F.col("ord").alias("chunk")), A.log(s, d).select((F.col("chunk") * 2).alias("chunk")))


@query("q_verify_chunks", f"""WITH {A.LINES}, o AS (SELECT line, (row_number() OVER (ORDER BY ord) - 1) // 40 + 1 AS chunk FROM lines),
c AS (SELECT chunk, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, CAST(sum(greatest(1, len(regexp_split_to_array(trim(line), '\\s+')))) AS BIGINT) AS tokens FROM o GROUP BY 1)
SELECT *, n_lines <= 40 AND n_bytes <= 2000 AND tokens <= 1000 AS ok FROM c""")
def q_verify_chunks(s, d):
    return batching.verify_chunks(batching.assign_chunks(A.lines(s, d), 40, 3), 40, 2000, 1000)


@query("q_chunking_needed", f"WITH {_STATS} SELECT n_lines, n_bytes, total_tokens, n_lines >= 100 OR n_bytes >= 100000000 OR total_tokens >= 200 AS needed, concat_ws(',', CASE WHEN n_lines >= 100 THEN 'lines' END, CASE WHEN n_bytes >= 100000000 THEN 'bytes' END, CASE WHEN total_tokens >= 200 THEN 'tokens' END) AS reasons FROM stats")
def q_chunking_needed(s, d):
    return batching.chunking_needed(batching.file_statistics(A.lines(s, d)), 100, 100_000_000, 200)


@query("q_check_model", "SELECT 'model-' || (page_id % 2) AS model, count(*) AS n, page_id % 2 = 1 AS ok FROM pages GROUP BY page_id % 2")
def q_check_model(s, d):
    papers = A.read(s, d, "pages").select(F.col("page_id").alias("bibcode"), "url")
    lines = responses.requests(papers.where("bibcode % 2 = 0"), papers, "model-0", F.col("url")).unionByName(responses.requests(papers.where("bibcode % 2 = 1"), papers, "model-1", F.col("url")))
    return batching.check_model(lines, "model-1")


@query("q_submission_today", f"""WITH {A.LINES}, {A.LOG}, x AS (SELECT ord IN (SELECT chunk * 2 FROM log) AS sent FROM lines), t AS (SELECT CAST(min(ts) AS DATE) AS day FROM log),
o AS (SELECT count(*) AS submitted_today, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens_today FROM log, t WHERE CAST(ts AS DATE) = day)
SELECT count(*) AS total, count(*) FILTER (sent) AS submitted, count(*) FILTER (NOT sent) AS remaining, any_value(submitted_today) AS submitted_today, any_value(tokens_today) AS tokens_today, greatest(0, 40000000 - any_value(tokens_today)) AS tokens_left FROM x, o""")
def q_submission_today(s, d):
    """The log's first day stands for today."""
    log = A.log(s, d)
    day = F.lit(log.agg(F.to_date(F.min("ts"))).first()[0])
    return batching.submission_status(A.lines(s, d).select(F.col("ord").alias("chunk")), log.withColumn("chunk", F.col("chunk") * 2), day)


@query("q_submission_gate", f"""WITH {A.LINES}, {A.LOG}, p AS (SELECT DISTINCT ord AS chunk, CAST(strlen(line) AS BIGINT) AS tokens FROM lines WHERE ord NOT IN (SELECT chunk * 2 FROM log) ORDER BY chunk LIMIT 20)
SELECT chunk, tokens, CAST(sum(tokens) OVER w AS BIGINT) AS running, sum(tokens) OVER w <= 400 AND count(*) OVER w <= 20 AS send FROM p WINDOW w AS (ORDER BY chunk)""")
def q_submission_gate(s, d):
    """On a day without submissions so far."""
    chunks = A.lines(s, d).select(F.col("ord").alias("chunk"), F.octet_length("line").cast("long").alias("tokens"))
    return batching.submission_gate(chunks, A.log(s, d).withColumn("chunk", F.col("chunk") * 2), F.lit("1900-01-01").cast("date"), 20, 400)


@query("q_batch_status", f"WITH {A.LOG} SELECT chunk, batch_id, tokens, CASE WHEN CAST(substr(batch_id, 2) AS INTEGER) < 300 THEN 'completed' ELSE 'not_found' END AS status FROM log")
def q_batch_status(s, d):
    remote = s.range(300).select(F.concat(F.lit("b"), F.col("id")).alias("batch_id"), F.lit("completed").alias("status"))
    return batching.batch_status(A.log(s, d), remote).select("chunk", "batch_id", "tokens", "status")


# Responses


@query("q_request_lines", """SELECT '{"custom_id":"' || page_id || '","method":"POST","body":{"model":"m-2","input":"Read ' || url || '"}}' AS line FROM pages WHERE page_id % 3 = 0""")
def q_request_lines(s, d):
    papers = A.read(s, d, "pages").select(F.col("page_id").alias("bibcode"), "url")
    lines = responses.requests(papers, papers.where("bibcode % 3 = 0"), "m-1", F.concat(F.lit("Read "), F.col("url")))
    return responses.adjust_model(lines, "m-1", "m-2")


@query("q_prompt_missions", f"""WITH {A.PAPERS}, k AS (SELECT bibcode, title, array_to_string(list_filter([{', '.join(f'CASE WHEN {_mentions("body", m)} THEN {chr(39)}{m.label}{chr(39)} END' for m in MISSIONS)}], lambda x: x IS NOT NULL), ', ') AS kw FROM papers)
SELECT bibcode, 'Of ' || title || ': ' || kw || ' among {', '.join(LABELS)}' AS prompt FROM k""")
def q_prompt_missions(s, d):
    fields = T.paper_fields(F.col("title"), F.col("abstract"), F.col("body"))
    return A.papers(s, d).select("bibcode", T.fill_prompt("Of {title}: {kw_missions} among {missions}", fields).alias("prompt"))


@query("q_report_lines", f"WITH {_REPORT} SELECT rpad(label, 14, ' ') || lpad(printf('%.4f', precision), 10, ' ') || lpad(printf('%.4f', recall), 10, ' ') || lpad(printf('%.4f', f1), 10, ' ') || lpad(CAST(support AS VARCHAR), 10, ' ') AS line FROM rep")
def q_report_lines(s, d):
    return metrics.report_lines(metrics.class_report(_pairs(s, d)))


_CONF = """c AS (SELECT bibcode, run, CASE WHEN bibcode % 5 = 0 THEN [0.0, 0.0] WHEN bibcode % 7 = 0 THEN [conf_science] WHEN bibcode % 11 = 0 THEN [conf_science, conf_mention, 0.0]
  ELSE [conf_science, conf_mention + CAST(run % 3 AS DOUBLE) / 10] END AS conf FROM calls)"""


@query("q_validate_conf", f"WITH {A.CALLS}, {_CONF} SELECT bibcode, run, len(conf) = 2 AND (list_sum(conf) = 0 OR abs(list_sum(conf) - 1) <= 1e-6) AS ok FROM c")
def q_validate_conf(s, d):
    """Confidences of all calls, some of them spoilt: of one or three values, of another sum, or nought."""
    b, science, mention = F.col("bibcode"), F.col("conf_science"), F.col("conf_mention")
    spoilt = F.array(science, mention + (F.col("run") % 3).cast("double") / 10)
    conf = F.when(b % 5 == 0, F.array(F.lit(0.0), F.lit(0.0))).when(b % 7 == 0, F.array(science)).when(b % 11 == 0, F.array(science, mention, F.lit(0.0))).otherwise(spoilt)
    return _calls(s, d).select("bibcode", "run", responses.valid_confidence(conf).alias("ok"))


@query("q_unique_missions", f"WITH {A.SEVERAL} SELECT bibcode, count(*) = count(DISTINCT mission) AS ok FROM several GROUP BY 1")
def q_unique_missions(s, d):
    """Papers' labels as responses; some name a mission twice."""
    per = A.several(s, d).groupBy("bibcode").agg(F.collect_list(F.struct("mission")).alias("missions"))
    return per.select("bibcode", responses.unique_missions(F.col("missions")).alias("ok"))


@query("q_map_papertype", "WITH " + A.TRACK + " SELECT bibcode, CASE WHEN bibcode % 5 = 0 THEN NULL WHEN papertype = 'SCIENCE' THEN 'SCIENCE' ELSE 'NONSCIENCE' END AS class FROM track")
def q_map_papertype(s, d):
    kind = F.when(F.col("bibcode") % 5 == 0, "poem").otherwise(F.col("papertype"))
    return A.track(s, d).select("bibcode", metrics.map_papertype(kind).alias("class"))


@query("q_canonical_mission", "WITH " + A.TRACK + " SELECT bibcode, CASE WHEN bibcode % 4 = 3 THEN NULL ELSE mission END AS mission FROM track")
def q_canonical_mission(s, d):
    """Names in small letters, in mixed ones, as registered, and unknown ones."""
    k, name = F.col("bibcode") % 4, F.col("mission")
    said = F.when(k == 0, F.lower(name)).when(k == 1, F.initcap(name)).when(k == 2, name).otherwise(F.concat(name, F.lit("X")))
    return A.track(s, d).select("bibcode", responses.canonical_mission(said).alias("mission"))


@query("q_convert", f"WITH {A.CALLS} SELECT bibcode, run, mission, papertype FROM calls WHERE greatest(conf_science, conf_mention) >= 0.7 OR greatest(conf_science, conf_mention) = 0.5")
def q_convert(s, d):
    return responses.classification(_calls(s, d), 0.7).select("bibcode", "run", "mission", "papertype")


@query("q_batch_lifecycle", f"""WITH {A.BATCH_EVENTS}, b AS (SELECT batch_id, min(ts) AS started, min({{'ts': ts, 'status': status}}) FILTER (status IN ('cancelled', 'completed', 'expired', 'failed')) AS e FROM ev GROUP BY 1), n AS (SELECT max(ts) AS now FROM ev)
SELECT batch_id, CASE WHEN e.ts <= started + INTERVAL 24 HOUR THEN e.status WHEN started + INTERVAL 24 HOUR <= now THEN 'expired' ELSE 'open' END AS status, CAST(epoch_us(started) AS BIGINT) AS started,
  coalesce(CAST(epoch_us(CASE WHEN e.ts <= started + INTERVAL 24 HOUR THEN e.ts WHEN started + INTERVAL 24 HOUR <= now THEN started + INTERVAL 24 HOUR END) AS BIGINT), -1) AS ended FROM b, n""")
def q_batch_lifecycle(s, d):
    """How each submitted batch ended, and when."""
    return lifecycle(A.batch_events(s, d)).withColumns({c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(-1)) for c in ("started", "ended")})


@query("q_upsert_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def q_upsert_latest(s, d):
    return responses.keep_latest(A.read(s, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("q_merge_chunks", f"WITH {A.CALLS} SELECT bibcode, mission, run FROM (SELECT *, row_number() OVER (PARTITION BY bibcode ORDER BY run DESC) AS n FROM calls) WHERE n = 1")
def q_merge_chunks(s, d):
    parts = [_calls(s, d).where(F.col("run") == r) for r in range(5)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return responses.keep_latest(merged, ["bibcode"], "run").select("bibcode", "mission", "run")


@query("q_fenced_json", f"""WITH {A.TRACK} SELECT bibcode, CASE WHEN bibcode % 4 = 1 THEN 'No JSON content found in response' WHEN bibcode % 4 = 2 THEN 'JSON could not be decoded' END AS error,
  CASE WHEN bibcode % 4 IN (0, 3) THEN mission END AS mission, CASE WHEN bibcode % 4 IN (0, 3) THEN papertype END AS papertype FROM track""")
def q_fenced_json(s, d):
    """Every label as a model's text: fenced among prose, without a fence, cut off, and with a second block behind the first."""
    k = F.col("bibcode") % 4
    own = F.to_json(F.struct(F.lit("n").alias("notes"), F.array(F.struct("mission", "papertype", F.array(F.lit("q")).alias("quotes"), F.lit("r").alias("reason"), F.array(F.lit(0.9), F.lit(0.1)).alias("confidence"))).alias("missions")))
    fenced = lambda x: F.concat(F.lit("```json\n"), x, F.lit("\n```"))
    raw = F.when(k == 0, F.concat(F.lit("Here: "), fenced(own), F.lit(" Done."))).when(k == 1, own).when(k == 2, fenced(F.substring(own, 1, 20))).otherwise(F.concat(fenced(own), F.lit("\n"), fenced(F.lit("{}"))))
    rows = A.track(s, d).select("bibcode", responses.parse_response(raw).alias("p"))
    return rows.select("bibcode", F.col("p.error").alias("error"), F.get("p.response.missions", 0)["mission"].alias("mission"), F.get("p.response.missions", 0)["papertype"].alias("papertype"))


@query("q_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(s, d):
    return A.read(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("q_output_key", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 THEN source || doc_id ELSE source || '.txt' END AS key FROM documents")
def q_output_key(s, d):
    """With a bibcode, from a temporary file's name, and from another file's."""
    k = F.col("doc_id") % 3
    own = F.when(k == 0, F.col("doc_id").cast("string"))
    file = F.when(k == 2, F.concat("source", F.lit(".txt"))).otherwise(F.concat(F.lit("temp_x1_"), "source", "doc_id", F.lit(".json")))
    return A.read(s, d, "documents").select("doc_id", responses.output_key(own, file).alias("key"))


@query("q_requests", "SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) GROUP BY 1")
def q_requests(s, d):
    lines = responses.requests(A.papers(s, d), A.track(s, d), "m", F.col("body"))
    return lines.select(F.get_json_object("line", "$.custom_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))


# What sinks are given


_RUNS = """r AS (SELECT doc_id AS bibcode, run, CASE WHEN (doc_id + run) % 11 = 0 THEN 'failed' END AS error FROM labels, (SELECT unnest([0, 1, 2, 3, 4]) AS run)),
old AS (SELECT * FROM r WHERE run < 3 AND bibcode % 4 <> 0), new AS (SELECT bibcode, run - 3 AS run, error FROM r WHERE run >= 3 AND bibcode % 5 <> 0)"""


def _old_and_new(s, d):
    """Three runs of most papers, and two more of others, numbered from 0."""
    r = A.runs(s, d).select("bibcode", "run", "error")
    return r.where("run < 3 AND bibcode % 4 <> 0"), r.where("run >= 3 AND bibcode % 5 <> 0").withColumn("run", F.col("run") - 3)


@query("q_append_runs", f"WITH {_RUNS} SELECT * FROM old UNION ALL SELECT bibcode, run + CASE WHEN bibcode IN (SELECT bibcode FROM old) THEN 3 ELSE 0 END, error FROM new")
def q_append_runs(s, d):
    return files.append_runs(*_old_and_new(s, d))


@query("q_replace_runs", f"WITH {_RUNS} SELECT * FROM old WHERE bibcode NOT IN (SELECT bibcode FROM new) UNION ALL SELECT * FROM new")
def q_replace_runs(s, d):
    return files.append_runs(*_old_and_new(s, d), replace=True)


@query("q_upsert_summary", f"WITH {_RUNS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE (bibcode, run) NOT IN (SELECT (bibcode, run) FROM new)")
def q_upsert_summary(s, d):
    return files.upsert(*_old_and_new(s, d), ["bibcode", "run"])


@query("q_misclassified_lines", f"WITH {PAIRS} SELECT 'Bibcode: ' || bibcode || chr(10) || 'Mission: ' || mission || chr(10) || 'Human: ' || coalesce(human_raw, '') || chr(10) || 'Model: ' || coalesce(llm_raw, '') || chr(10) || '-----' AS line FROM cells WHERE cell IN ('fn', 'fp')")
def q_misclassified_lines(s, d):
    """A block of text for each paper and mission that human and model judge otherwise."""
    wrong = _pairs(s, d).where("human <> llm")
    return files.misclassified_report(wrong, {"Bibcode": F.col("bibcode"), "Mission": F.col("mission"), "Human": F.col("human_raw"), "Model": F.col("llm_raw")})


@query("q_source_kind", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'file' WHEN doc_id % 2 = 0 THEN 'index' ELSE 'bibcode' END AS kind FROM documents")
def q_source_kind(s, d):
    """Files that are known, indices and bibcodes."""
    own = F.when(F.col("source").isin("src1", "src2"), F.col("source")).when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("2023A"), "doc_id"))
    return A.read(s, d, "documents").select("doc_id", responses.source_kind(own, ["src1", "src2"]).alias("kind"))


# Scores


_BEST = A.CALLS + ", v AS (SELECT *, CASE WHEN greatest(conf_science, conf_mention) < 0.7 THEN 'lowprob' WHEN conf_science >= conf_mention THEN 'science' ELSE 'mention' END AS verdict FROM calls)"


def _verdicts(s, d):
    return _calls(s, d).withColumn("verdict", scoring.verdict(["science", "mention"], F.array("conf_science", "conf_mention")))


@query("q_verdict", f"WITH {_BEST} SELECT bibcode, run, CASE WHEN bibcode % 13 = 0 THEN 'error' WHEN bibcode % 7 = 0 THEN 'nomatch' WHEN mission = 'TESS' THEN 'donotclassify' ELSE verdict END AS verdict FROM v")
def q_verdict(s, d):
    text = F.when(F.col("bibcode") % 7 == 0, " ").otherwise("text")
    v = scoring.routed_verdict(["science", "mention"], F.array("conf_science", "conf_mention"), text, F.col("mission") == "TESS", F.col("bibcode") % 13 == 0)
    return _calls(s, d).select("bibcode", "run", v.alias("verdict"))


_COUNT = _BEST + ", " + A.TRACK + """, r AS (SELECT lower(replace(t.papertype, '_', '')) AS actual, v.verdict AS measured FROM v JOIN track t USING (bibcode)),
dm AS (SELECT actual, measured FROM (SELECT unnest(['science', 'mention', 'supermention', 'datainfluenced']) AS actual), (SELECT unnest(['science', 'mention', 'lowprob', 'error']) AS measured)),
ct AS (SELECT dm.actual, dm.measured, count(r.actual) AS n FROM dm LEFT JOIN r ON r.actual = dm.actual AND r.measured = dm.measured GROUP BY 1, 2)"""


@query("q_counters", f"WITH {_COUNT} SELECT *, CAST(sum(n) OVER (PARTITION BY actual) AS BIGINT) AS total, coalesce(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY actual), 0), 0) AS share FROM ct")
def q_counters(s, d):
    rows = _verdicts(s, d).join(A.track(s, d).select("bibcode", F.lower(F.replace("papertype", F.lit("_"), F.lit(""))).alias("actual")), "bibcode").select("actual", F.col("verdict").alias("measured"))
    return scoring.counters(rows, ["science", "mention", "supermention", "datainfluenced"], ["science", "mention", "lowprob", "error"])


@query("q_threshold_sweep", f"""WITH {A.CALLS}, {A.TRACK}, th AS (SELECT 0.5 + i * (CAST(0.95 AS DOUBLE) - 0.5) / 19 AS threshold FROM (SELECT unnest(range(20)) AS i)),
b AS (SELECT greatest(conf_science, conf_mention) AS best, c.papertype = t.papertype AS ok FROM calls c JOIN track t USING (bibcode))
SELECT round(threshold, 6) AS threshold, count(*) FILTER (best >= round(threshold, 6)) AS n_kept, count(*) FILTER (best >= round(threshold, 6) AND ok) AS n_right FROM b, th GROUP BY 1""")
def q_threshold_sweep(s, d):
    rows = _calls(s, d).join(A.track(s, d).select("bibcode", F.col("papertype").alias("human")), "bibcode")
    steps = F.transform(scoring.thresholds(), lambda t: F.round(t, 6))
    return scoring.threshold_sweep(rows, F.greatest("conf_science", "conf_mention"), F.col("papertype") == F.col("human"), steps)


@query("q_performance", f"""WITH {A.CALLS}, {A.TRACK}, th AS (SELECT 0.5 + i * (CAST(0.95 AS DOUBLE) - 0.5) / 19 AS t FROM (SELECT unnest(range(20)) AS i)),
b AS (SELECT t.papertype AS actual, conf_science, conf_mention FROM calls c JOIN track t USING (bibcode))
SELECT round(t, 6) AS threshold, actual, CASE WHEN greatest(conf_science, conf_mention) < round(t, 6) THEN 'lowprob' WHEN conf_science >= conf_mention THEN 'SCIENCE' ELSE 'MENTION' END AS measured, count(*) AS n FROM b, th GROUP BY 1, 2, 3""")
def q_performance(s, d):
    rows = _calls(s, d).join(A.track(s, d).select("bibcode", F.col("papertype").alias("human")), "bibcode")
    steps = F.transform(scoring.thresholds(), lambda t: F.round(t, 6))
    return scoring.performance(rows, ["SCIENCE", "MENTION"], F.array("conf_science", "conf_mention"), F.col("human"), steps)


def _reply(prompt: str) -> str:
    """Stands in for a model: every fifth prompt fails, every seventh answer is not JSON."""
    n = int(prompt.split()[-1])
    if n % 5 == 0:
        raise TimeoutError("no answer")
    if n % 7 == 0:
        return "I cannot tell."
    science = (n % 11) / 10
    return '```json\n{"notes": "n", "missions": [{"mission": "hst", "papertype": "SCIENCE", "quotes": ["\\"q\\""], "reason": "r", "confidence": [%s, %s]}]}\n```' % (science, round(1 - science, 10))


@query("q_classify_runs", "SELECT doc_id AS bibcode, run, CASE WHEN doc_id % 5 = 0 THEN 'TimeoutError: no answer' WHEN doc_id % 7 = 0 THEN 'No JSON content found in response' END AS error, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'HST' END AS mission, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN round((doc_id % 11) / CAST(10 AS DOUBLE), 6) END AS science FROM labels, (SELECT unnest([1, 2]) AS run)")
def q_classify_runs(s, d):
    papers = A.read(s, d, "labels").select(F.col("doc_id").alias("bibcode"))
    out = responses.classify_papers(papers, F.concat(F.lit("Paper "), F.col("bibcode").cast("string")), _reply, 2)
    first = F.get("missions", 0)
    return out.select("bibcode", F.col("run").cast("long").alias("run"), "error", first["mission"].alias("mission"), F.round(F.get(first["confidence"], 0), 6).alias("science"))


@query("q_classify_set", f"""WITH {_HIT}, two AS (SELECT p.bibcode, m.mission FROM papers p, (SELECT unnest(['TESS', 'GALEX']) AS mission) m)
SELECT bibcode || '_' || mission AS id, bibcode, mission, CASE WHEN (bibcode, mission) NOT IN (SELECT (bibcode, mission) FROM hit) THEN 'nomatch' WHEN bibcode % 2 = 0 THEN 'science' ELSE 'lowprob' END AS verdict FROM two""")
def q_classify_set(s, d):
    """Every text for two missions; the scorer goes by the parity of the bibcode."""
    def modify(papers, m):
        return paragraphs.modified_texts(papers, F.col("body"), m, "anon")

    def score(rows):
        return rows.withColumn("probs", F.create_map(F.lit("science"), F.when(F.col("bibcode") % 2 == 0, 0.9).otherwise(0.6), F.lit("mention"), F.lit(0.1)))

    out = scoring.classify_set(A.papers(s, d), tuple(BY_LABEL[x] for x in ("TESS", "GALEX")), modify, score, ["science", "mention"])
    return out.select("id", "bibcode", "mission", "verdict")


# Linguistic operators: SQL cannot express them; tests hold them against given cases


def _rules_sql(m) -> str:
    """The verdict by rules, null where a phrase must tell."""
    if not m.ambiguous:
        return _mentions("sentence", m)
    plain = tuple(p for p in m.phrases if p not in m.ambiguous)
    own = f" WHEN {_mentions('sentence', type(m)(m.label, plain, m.cased, m.uncased, m.banned), 'keyword')} THEN TRUE" if plain else ""
    return f"CASE WHEN {_mentions('sentence', m, 'acronym')} THEN TRUE{own} WHEN NOT {_mentions('sentence', m)} THEN FALSE END"


_AMBIGUOUS = [m for m in MISSIONS if m.ambiguous]
_LETTER = r"[\p{L}\p{N}]"
_SQL_WORD = rf"{_LETTER}+(?:[-−/.]{_LETTER}+)*|'s\b|\S"


def _words_sql(source: str, masks: bool = True) -> str:
    """Words of the rows (mission, sentence) of ``source``, their classes, what they mean and the chunks they form."""
    sentence = "sentence"
    for m in _AMBIGUOUS if masks else []:
        for phrase in m.banned:
            sentence = f"CASE WHEN mission = '{m.label}' THEN regexp_replace({sentence}, {_q('(?i)' + phrase)}, '{'#' * len(phrase)}', 'g') ELSE {sentence} END"
    if masks:
        sentence = f"regexp_replace({sentence}, {_q(chr(45) + r'\b[0-9]+\b')}, '-000', 'g')"
    listed = " ".join(f"WHEN low IN ({', '.join(_q(w) for w in words.split())}) THEN '{name}'" for name, words in reversed(nlp.CLASSES.items()))
    core = " ".join(f"WHEN {_mentions('w', m)} THEN CASE WHEN regexp_matches({_ascii('w')}, '[^a-zA-Z0-9]') THEN low ELSE '{m.name.lower()}' END" for m in MISSIONS)
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in nlp.IRREGULAR.items())
    return f"""w0 AS (SELECT mission, sentence, regexp_extract_all({sentence}, {_q(_SQL_WORD)}) AS ws FROM {source}),
w1 AS (SELECT *, lower(w) AS low FROM (SELECT mission, sentence, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w0)),
w2 AS (SELECT *, CASE WHEN low = {_q("'s")} THEN 'POSS' WHEN NOT regexp_matches(w, {_q(_LETTER)}) THEN 'PUNCT' WHEN regexp_matches(low, '^(id)?[0-9]') THEN 'NUM' {listed}
    WHEN low LIKE '%ly' AND length(low) > 4 THEN 'ADV' WHEN regexp_matches(low, '(ous|ive|ful|able|ible|ical|ed)$') AND length(low) > 4 THEN 'ADJ' ELSE 'NOUN' END AS pos,
  CASE mission {' '.join(f"WHEN '{m.label}' THEN {_mentions('w', m)}" for m in _AMBIGUOUS)} END AS own,
  CASE {core} WHEN regexp_matches(low, '^(id)?[0-9]+') THEN '000' ELSE CASE low {irregular} ELSE
    CASE WHEN length(low) > 4 AND low LIKE '%ies' THEN low[:-4] || 'y' WHEN length(low) > 4 AND regexp_matches(low, '(sses|shes|ches|xes)$') THEN low[:-3]
      WHEN length(low) > 3 AND low LIKE '%s' AND NOT regexp_matches(low, '(ss|us|is)$') THEN low[:-2] ELSE low END END END AS root FROM w1),
w3 AS (SELECT *, i - row_number() OVER (PARTITION BY mission, sentence ORDER BY i) AS island FROM w2 WHERE own OR w IN ('-', '/') OR pos IN ('NOUN', 'ADJ', 'NUM', 'POSS')),
ck AS (SELECT mission, sentence, min(i) AS begins, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (pos <> 'POSS'), '') AS text, coalesce(string_agg(root, ' ' ORDER BY i) FILTER (pos NOT IN ('POSS', 'PUNCT')), '') AS meaning
  FROM w3 GROUP BY mission, sentence, island HAVING bool_or(own))"""


def _phrases_sql() -> str:
    """(mission, ord, exact, spaced, verdict) of the phrase table."""
    rows = []
    for m in _AMBIGUOUS:
        for n, (who, text, verdict) in enumerate(PHRASES):
            if who.lower() in ("anymission", m.name.lower()):
                own = text.replace("AnyMission", m.name.lower())
                words = nlp.meaning([t._replace(pos="NOUN") if t.pos != "PUNCT" else t for t in nlp.annotate(own)])
                spaced = r" (?:\w+ )*".join(rf"\b{re.escape(w)}\b" for w in words)
                rows.append(f"('{m.label}', {n}, {_q(rf'(?i)\b{re.escape(own)}\b')}, {_q('(?i)' + spaced)}, {verdict})")
    return "ph(mission, ord, exact, spaced, verdict) AS (VALUES " + ", ".join(rows) + ")"


def _in(values) -> str:
    return "(" + ", ".join(_q(v.lower()) for v in values) + ")"


_SETTLED = f"""{_words_sql('asked')}, {_phrases_sql()},
bare AS (SELECT *, CASE mission {' '.join(f"WHEN '{m.label}' THEN lower(text) IN {_in(m.ambiguous)} OR replace(lower(text), '.', '') IN {_in(m.phrases + m.cased + m.uncased)}" for m in _AMBIGUOUS)} END AS bare FROM ck),
hits AS (SELECT b.*, ord, verdict, unnest([0, 1]) AS form, unnest([length(regexp_extract(meaning, exact)), length(regexp_extract(meaning, spaced))]) AS size FROM bare b JOIN ph ON ph.mission = b.mission AND NOT bare),
best AS (SELECT mission, sentence, verdict FROM hits WHERE size > 0 QUALIFY row_number() OVER (PARTITION BY mission, sentence, begins ORDER BY form, size, ord) = 1 UNION ALL SELECT mission, sentence, TRUE FROM bare WHERE bare),
told AS (SELECT mission, sentence, bool_or(verdict) AS verdict FROM best GROUP BY 1, 2)"""


@query("q_truematch", f"WITH {_SENT}, r AS (" + " UNION ALL ".join(f"SELECT bibcode, i, sentence, '{m.label}' AS mission, {_rules_sql(m)} AS verdict FROM s" for m in MISSIONS) + f"""),
asked AS (SELECT DISTINCT mission, sentence FROM r WHERE verdict IS NULL AND sentence IS NOT NULL), {_SETTLED}
SELECT bibcode, i, mission FROM r WHERE verdict UNION ALL SELECT bibcode, i, r.mission FROM r JOIN told ON r.mission = told.mission AND r.sentence = told.sentence WHERE r.verdict IS NULL AND told.verdict""")
def q_truematch(s, d):
    """All missions: what rules settle, and what phrases settle."""
    return paragraphs.settled_sentences(A.papers(s, d), F.col("body")).withColumn("i", F.col("i").cast("long"))


@query("q_missions_or_names", f"WITH {_SENT}, r AS (" + " UNION ALL ".join(f"SELECT bibcode, i, sentence, '{m.label}' AS mission, {_rules_sql(m)} AS verdict FROM s" for m in MISSIONS) + f"""),
asked AS (SELECT DISTINCT mission, sentence FROM r WHERE verdict IS NULL AND sentence IS NOT NULL), {_SETTLED},
v AS (SELECT r.bibcode, r.mission, coalesce(r.verdict, told.verdict) AS verdict FROM r LEFT JOIN told ON r.verdict IS NULL AND r.mission = told.mission AND r.sentence = told.sentence WHERE r.sentence IS NOT NULL),
failed AS (SELECT DISTINCT bibcode FROM v WHERE verdict IS NULL)
SELECT DISTINCT bibcode, mission FROM v WHERE verdict AND bibcode NOT IN (SELECT bibcode FROM failed)
UNION ALL SELECT bibcode, m.mission FROM papers JOIN failed USING (bibcode), (SELECT unnest([{', '.join(_q(x) for x in LABELS)}]) AS mission) m WHERE contains(body, m.mission)""")
def q_missions_or_names(s, d):
    """Missions in texts, by names alone where a sentence cannot be settled."""
    return paragraphs.missions_or_names(A.papers(s, d), F.col("body"))


@query("q_model_scores")
def q_model_scores(s, d):
    """Every document's class and its probability, by a model trained on labelled documents with others as validation."""
    papers = A.papers(s, d).select("bibcode", F.col("body").alias("text"))
    labelled = A.read(s, d, "labels").select(F.col("doc_id").alias("bibcode"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("class")).join(papers, "bibcode")
    part = F.crc32(F.col("bibcode").cast("string").cast("binary")) % 5
    model = models.TextModel(["good", "poor"]).train(labelled.where(part > 0), labelled.where(part == 0), epochs=6)
    scored = models.scorer_of(model)(papers)
    probs = F.array(*[F.col("probs")[c] for c in model.classes])
    return scored.select("bibcode", scoring.verdict(model.classes, probs).alias("verdict"), F.round(F.array_max(probs), 3).alias("top"))


@query("q_nlp_wordchunks", f"WITH {_SENT}, named AS (" + " UNION ALL ".join(f"SELECT bibcode, i AS place, '{m.label}' AS mission, sentence FROM s WHERE {_mentions('sentence', m, 'keyword')}" for m in _AMBIGUOUS) + f"""), asked AS (SELECT DISTINCT mission, sentence FROM named), {_words_sql('asked', masks=False)}
SELECT bibcode, place AS i, mission, begins, text AS chunk, meaning FROM named JOIN ck USING (mission, sentence)""")
def q_nlp_wordchunks(s, d):
    """Chunks around the names of every mission with ambiguous words, with their meanings."""
    ambiguous = tuple(m for m in MISSIONS if m.ambiguous)
    rows = paragraphs.sentence_rows(A.papers(s, d), F.col("body")).withColumn("mission", F.explode_outer(T.missions_of(F.col("sentence"), ambiguous, "keyword"))).where("mission IS NOT NULL")
    found = ambiguity.chunks(rows, ["bibcode", "i"], ambiguous)
    return found.select("bibcode", F.col("i").cast("long").alias("i"), "mission", F.col("at").cast("long").alias("begins"), F.col("text").alias("chunk"), "meaning")


_IN = lambda name, field: f"{field} IN ({', '.join(_q(x) for x in sorted(grammar.LABELS[name][field]))})"
_TENSE = lambda name: f"tag IN ({', '.join(_q(x) for x in sorted(grammar.TENSES[name]))})"


def _classes_sql(source: str, matters: str = "FALSE") -> str:
    """cl(sid, i, w, n, head, tag, dep, conj, origin, kinds): word classes by ancestors as rows. ``matters``: SQL on ``w``."""
    first = lambda flag: f"coalesce(t.conj AND o.{flag}, FALSE)"
    kinds = {
        "ROOT": "s.root", "VERB": "s.verb", "USELESS": f"{_IN('useless', 'tag')} AND {_IN('useless', 'dep')} AND {_IN('useless', 'pos')} AND NOT ({_IN('negative', 'dep')} OR subject OR s.root) AND NOT ({matters})",
        "SUBJECT": "subject", "PREPOSITION": "s.prep", "BASE_OBJECT": "s.base", "DIRECT_OBJECT": "direct", "PREPOSITION_OBJECT": "of_prep", "PREPOSITION_SUBJECT": "of_subject",
        "MARKER": f"({_IN('marker', 'dep')} OR {_IN('marker', 'tag')} OR (s.det AND subject AND s.head <> s.i)) AND NOT (s.head <> s.i AND s.head_root)", "X": f"{_IN('x', 'dep')} OR {_IN('x', 'pos')}", "CONJOINED": "s.conj",
        "DETERMINANT": "s.det", "AUX": f"{_IN('aux', 'dep')} AND {_IN('aux', 'pos')} AND ({' OR '.join(map(_TENSE, grammar.TENSES))}) AND NOT {_IN('preposition', 'tag')} AND NOT {_IN('number', 'tag')}", "NOUN": "s.noun",
        "PRONOUN": f"{_IN('pronoun', 'tag')} OR {_IN('pronoun', 'pos')}", "ADJECTIVE": "s.adjective", "CONJUNCTION": f"{_IN('conjunction', 'pos')} AND {_IN('conjunction', 'tag')}", "PASSIVE": _IN("passive", "dep"),
        "NEGATIVE": _IN("negative", "dep"), "PUNCTUATION": f"{_IN('punctuation', 'dep')} AND NOT regexp_matches(w, '(?i)[a-z|0-9]')", "BRACKET": _IN("bracket", "tag"), "POSSESSIVE": _IN("possessive", "tag"), "NUMBER": _IN("number", "pos"),
    }
    noun, det = f"({_IN('noun', 'pos')} AND NOT {_IN('determinant', 'tag')})", f"({_IN('determinant', 'pos')} AND {_IN('determinant', 'tag')})"
    return f"""{A.parse_sql(source)},
fl AS MATERIALIZED (SELECT *, dep = 'ROOT' AS root, {noun} AS noun, {_IN('adjective', 'tag')} OR {_IN('adjective', 'pos')} OR ({_IN('adjective', 'dep')} AND pos = 'VERB' AND {_IN('verb', 'tag')}) AS adjective, {noun} AND {_IN('object', 'dep')} AS base,
  ({_IN('conjoined', 'dep')} OR {_IN('appos', 'dep')}) AND NOT {_IN('determinant', 'tag')} AS conj, {_IN('verb', 'tag')} AS finite, {_IN('verb', 'dep')} OR {_IN('ccomp', 'dep')} AS verbal, {det} AS det,
  {_IN('preposition', 'tag')} AND (({_IN('preposition', 'dep')} AND {_IN('preposition', 'pos')}) OR ({_IN('aux', 'dep')} AND {_IN('aux', 'pos')})) AS prep FROM tk),
up(sid, i, a, d) AS (SELECT sid, i, head, 1 FROM fl WHERE head <> i UNION ALL SELECT up.sid, up.i, t.head, d + 1 FROM up JOIN fl t ON t.sid = up.sid AND t.i = up.a WHERE t.head <> t.i),
ups AS MATERIALIZED (SELECT * FROM up),
og AS MATERIALIZED (SELECT u.sid, u.i, arg_min(u.a, u.d) AS origin FROM ups u JOIN fl a ON a.sid = u.sid AND a.i = u.a WHERE NOT a.conj GROUP BY 1, 2),
lf AS (SELECT DISTINCT sid, head AS i FROM fl WHERE i < head),
v0 AS MATERIALIZED (SELECT t.*, h.root AS head_root, g.origin, t.finite AND (t.verbal OR t.root OR ({_IN('adjective', 'dep').replace('dep', 't.dep')} AND t.head <> t.i AND h.root AND h.noun AND lf.i IS NOT NULL)) AS v FROM fl t JOIN fl h ON h.sid = t.sid AND h.i = t.head LEFT JOIN og g ON g.sid = t.sid AND g.i = t.i LEFT JOIN lf ON lf.sid = t.sid AND lf.i = t.i),
v1 AS MATERIALIZED (SELECT t.*, t.v OR (t.finite AND {first('v')}) AS verb FROM v0 t LEFT JOIN v0 o ON o.sid = t.sid AND o.i = t.origin),
s0 AS MATERIALIZED (SELECT t.*, NOT t.base AND ((t.noun AND t.root) OR (t.head <> t.i AND h.verb AND t.i < t.head AND ({_IN('subject', 'dep').replace('dep', 't.dep')} OR t.noun OR t.adjective))) AS s FROM v1 t JOIN v1 h ON h.sid = t.sid AND h.i = t.head),
s1 AS MATERIALIZED (SELECT t.*, t.s OR (NOT t.base AND {first('s')}) AS subject FROM s0 t LEFT JOIN s0 o ON o.sid = t.sid AND o.i = t.origin),
gv AS (SELECT u.sid, u.i, arg_min(u.a, u.d) AS g FROM ups u JOIN s1 a ON a.sid = u.sid AND a.i = u.a WHERE a.prep OR a.verb GROUP BY 1, 2),
o0 AS MATERIALIZED (SELECT t.*, coalesce(t.base AND g.verb AND NOT g.prep, FALSE) AS d0, coalesce(t.base AND g.prep AND NOT p.subject, FALSE) AS p0, coalesce(t.base AND g.prep AND p.subject, FALSE) AS q0
  FROM s1 t LEFT JOIN gv ON gv.sid = t.sid AND gv.i = t.i LEFT JOIN s1 g ON g.sid = gv.sid AND g.i = gv.g LEFT JOIN s1 p ON p.sid = g.sid AND p.i = g.head),
sj AS (SELECT t.*, t.d0 OR {first('d0')} AS direct, t.p0 OR {first('p0')} AS of_prep, t.q0 OR {first('q0')} AS of_subject FROM o0 t LEFT JOIN o0 o ON o.sid = t.sid AND o.i = t.origin),
cl AS MATERIALIZED (SELECT sid, i, w, n, head, tag, dep, root, conj, origin, list_filter([{', '.join(f"CASE WHEN {kinds[k]} THEN '{k}' END" for k in parse.KINDS)}], lambda x: x IS NOT NULL) AS kinds FROM sj s)"""


def _tree_sql(matters: str) -> str:
    """wt, the words, and vt, the verbs, from cl and ups."""
    has = lambda k: f"list_contains(t.kinds, '{k}')" + ("" if k == "AUX" else f" OR coalesce(t.conj AND list_contains(o.kinds, '{k}'), FALSE)")
    helps = lambda name: f"coalesce(bool_or(x.{_TENSE(name)}), FALSE)"
    return f"""mo AS MATERIALIZED (SELECT *, ({matters}) AS own FROM cl),
mn AS MATERIALIZED (SELECT t.*, CASE {' '.join(f"WHEN {has(k)} THEN '{k}'" for k in parse.MAIN)} END AS main, list_contains(t.kinds, 'VERB') OR t.root AS is_verb FROM mo t LEFT JOIN cl o ON o.sid = t.sid AND o.i = t.origin),
ab AS (SELECT u.sid, u.i, arg_min(u.a, u.d) FILTER (a.is_verb) AS verb, arg_min(u.a, u.d) FILTER (a.main = 'VERB') AS trail, array_to_string(list(u.a ORDER BY u.d) FILTER (a.is_verb), ',') AS above FROM ups u JOIN mn a ON a.sid = u.sid AND a.i = u.a GROUP BY 1, 2),
w_ AS MATERIALIZED (SELECT t.*, CASE WHEN t.is_verb THEN t.i ELSE ab.verb END AS verb, ab.verb AS verb_above, CASE WHEN t.main = 'VERB' THEN t.i ELSE ab.trail END AS trail, coalesce(ab.above, '') AS above FROM mn t LEFT JOIN ab ON ab.sid = t.sid AND ab.i = t.i),
im AS (SELECT sid, verb AS i, bool_or(own) AS important FROM w_ GROUP BY 1, 2),
wt AS MATERIALIZED (SELECT t.*, t.own OR coalesce(t.is_verb AND im.important, FALSE) AS important, CASE WHEN t.trail = t.i THEN p.trail END AS outer_ FROM w_ t LEFT JOIN im ON im.sid = t.sid AND im.i = t.i LEFT JOIN w_ p ON p.sid = t.sid AND p.i = t.verb_above),
vt AS (SELECT v.sid, v.i, v.w, v.important, CASE WHEN (v.fin AND v.{_TENSE('future')}) OR {helps('future')} THEN 'future' WHEN (v.fin AND v.{_TENSE('past')}) OR ((NOT v.fin OR v.{_TENSE('present')}) AND {helps('past')}) THEN 'past'
    WHEN (v.fin AND v.{_TENSE('present')}) OR (NOT v.fin AND {helps('present')}) THEN 'present' END AS tense, coalesce(bool_or(list_contains(x.kinds, 'PASSIVE')), FALSE) AS passive, {helps('purpose')} AS purpose
  FROM (SELECT *, list_contains(kinds, 'VERB') AS fin FROM wt WHERE is_verb) v LEFT JOIN wt x ON x.sid = v.sid AND x.verb = v.i AND x.main = 'AUX' GROUP BY v.sid, v.i, v.w, v.important, v.fin, v.tag)"""


def _thin_sql(skim: bool, trim: bool) -> str:
    """th(sid, t): what skimming and trimming leave of a sentence."""
    gone = "FALSE"
    if trim:
        gone = "(coalesce(d1.dull, FALSE) OR coalesce(d2.dull, FALSE)) AND NOT (t.i = t.n - 1 AND list_contains(t.kinds, 'PUNCTUATION'))"
    keep = f"NOT ({gone})" + (" AND NOT list_contains(t.kinds, 'USELESS')" if skim else "")
    text = f"coalesce(string_agg(t.w, ' ' ORDER BY t.i) FILTER ({keep}), '')"
    for a, b in ((r" ([.,;:?!)\]}])", r"\1"), (r"([(\[{]) ", r"\1"), (r" ?('s)", r"\1"), (r"^(?:[,;]\s*)+", "")):
        text = f"regexp_replace({text}, {_q(a)}, {_q(b)}, 'g')"
    return f"""du AS (SELECT c.sid, c.h, NOT bool_or(c.important) AS dull FROM (SELECT sid, trail AS h, important FROM wt WHERE trail IS NOT NULL UNION ALL SELECT sid, outer_, important FROM wt WHERE outer_ IS NOT NULL) c GROUP BY 1, 2),
th AS (SELECT t.sid, {text} AS t FROM wt t LEFT JOIN du d1 ON d1.sid = t.sid AND d1.h = t.trail LEFT JOIN du d2 ON d2.sid = t.sid AND d2.h = t.outer_ GROUP BY t.sid)"""


_HST = BY_LABEL["HST"]
_MATTERS = f"{_mentions('w', _HST)} OR regexp_matches({_ascii('w')}, '(?i)\\b(?:i|me|my|mine|we|us|our|ours)\\b|\\b(?:figures?|fig|tables?|tab|plots?)\\b|\\bet al\\b|etal\\b')"


@query("q_word_classes", f"WITH RECURSIVE {_SENT}, {_classes_sql('s')}, k AS (SELECT sid, md5(string_agg(array_to_string(kinds, ','), ';' ORDER BY i)) AS h FROM cl GROUP BY 1) SELECT bibcode, s.i, k.h FROM s JOIN src ON src.sentence = s.sentence JOIN k ON k.sid = src.sid")
def q_word_classes(s, d):
    """The classes of every word of every sentence."""
    rows = paragraphs.sentence_rows(A.papers(s, d), F.col("body")).where(F.col("sentence").rlike("[^ ]"))  # a filter on the words would compute them twice
    seen = parse.words(rows.withColumn("p", A.parse(F.col("sentence"))), F.col("p"))
    return seen.select("bibcode", F.col("i").cast("long").alias("i"), F.md5(F.array_join(F.transform("words", lambda w: F.array_join(w["kinds"], ",")), ";")).alias("h"))


_NAMED = f"named AS (SELECT bibcode, i AS place, sentence FROM s WHERE {' OR '.join(_mentions('sentence', m) for m in MISSIONS)})"


def _trees(s, d):
    rows = paragraphs.sentence_rows(A.papers(s, d), F.col("body")).where(T.mentions_any(F.col("sentence")))
    matters = grammar.importance_of(_HST)
    return parse.tree(parse.words(rows.withColumn("p", A.parse(F.col("sentence"))), F.col("p"), matters=matters), matters)


@query("q_verbs", f"WITH RECURSIVE {_SENT}, {_NAMED}, {_classes_sql('named', _MATTERS)}, {_tree_sql(_MATTERS)} SELECT bibcode, place AS i, vt.i AS word, vt.w AS verb, tense, passive, purpose, important FROM named JOIN src USING (sentence) JOIN vt ON vt.sid = src.sid")
def q_verbs(s, d):
    """Verbs of the sentences that name a mission, with their tense and whether what they govern matters."""
    rows = _trees(s, d).select("bibcode", F.col("i").cast("long").alias("i"), F.explode_outer("tree.verbs").alias("v")).where("v IS NOT NULL")
    return rows.select("bibcode", "i", F.col("v.i").cast("long").alias("word"), F.col("v.text").alias("verb"), "v.tense", "v.passive", "v.purpose", "v.important")


@query("q_clauses", f"WITH RECURSIVE {_SENT}, {_NAMED}, {_classes_sql('named', _MATTERS)}, {_tree_sql(_MATTERS)} SELECT bibcode, place AS i, wt.i AS word, main, important, list_contains(kinds, 'USELESS') AS useless, verb, above, coalesce(trail, -1) AS trail, coalesce(outer_, -1) AS around FROM named JOIN src USING (sentence) JOIN wt ON wt.sid = src.sid")
def q_clauses(s, d):
    """Words of the sentences that name a mission: main class, clause, the verbs above."""
    rows = _trees(s, d).select("bibcode", F.col("i").cast("long").alias("i"), F.explode_outer("tree.words").alias("w")).where("w IS NOT NULL")
    long = lambda c: F.col(c).cast("long")
    return rows.select("bibcode", "i", long("w.i").alias("word"), "w.main", "w.important", "w.useless", long("w.verb").alias("verb"), F.array_join("w.above", ",").alias("above"), F.coalesce(long("w.trail"), F.lit(-1)).alias("trail"), F.coalesce(long("w.outer"), F.lit(-1)).alias("around"))


_HIT_HST = f"hh AS (SELECT bibcode, i, sentence FROM s WHERE {_mentions('sentence', _HST)})"


@query("q_modif_skim", f"WITH RECURSIVE {_SENT}, {_HIT_HST}, {_classes_sql('hh', _MATTERS)}, {_tree_sql(_MATTERS)}, {_thin_sql(True, False)} SELECT bibcode, string_agg({_streamline('th.t')}, chr(10) ORDER BY hh.i) AS modif FROM hh JOIN src USING (sentence) JOIN th ON th.sid = src.sid GROUP BY 1")
def q_modif_skim(s, d):
    return paragraphs.modified_texts(A.papers(s, d), F.col("body"), _HST, "skim", parser=A.parse).where("modif <> ''").select("bibcode", "modif")


@query("q_modif_all", f"""WITH RECURSIVE {_SENT}, r AS (SELECT bibcode, i, sentence, 'HST' AS mission, {_rules_sql(_HST)} AS verdict FROM s), asked AS (SELECT DISTINCT mission, sentence FROM r WHERE verdict IS NULL AND sentence IS NOT NULL), {_SETTLED},
hh AS (SELECT bibcode, i, sentence FROM r WHERE verdict UNION ALL SELECT bibcode, i, r.sentence FROM r JOIN told ON r.mission = told.mission AND r.sentence = told.sentence WHERE r.verdict IS NULL AND told.verdict),
{_classes_sql('hh', _MATTERS)}, {_tree_sql(_MATTERS)}, {_thin_sql(True, True)}, an AS (SELECT sid, regexp_replace(t, '[.?!]+$', '') AS t, regexp_extract(t, '[.?!]+$') AS mark FROM th)
SELECT bibcode, string_agg({_streamline(f"({_anon('an.t', _HST)} || mark)")}, chr(10) ORDER BY hh.i) AS modif, string_agg(sentence, chr(10) ORDER BY hh.i) AS modif_none FROM hh JOIN src USING (sentence) JOIN an ON an.sid = src.sid GROUP BY 1 HAVING modif <> ''""")
def q_modif_all(s, d):
    """Every step, with ambiguous sentences settled."""
    return paragraphs.modified_texts(A.papers(s, d), F.col("body"), _HST, "skim_trim_anon", undecided=None, parser=A.parse).where("modif <> ''")


@query("q_modif_none", f"WITH {_HIT}, p AS (SELECT h.bibcode, string_agg(s.sentence, chr(10) ORDER BY s.i) AS modif_none FROM hit h JOIN s ON s.bibcode = h.bibcode AND s.i = h.i WHERE h.mission = 'TESS' GROUP BY 1) SELECT papers.bibcode, md5(coalesce(modif_none, '')) AS h FROM papers LEFT JOIN p ON p.bibcode = papers.bibcode")
def q_modif_none(s, d):
    return paragraphs.modified_texts(A.papers(s, d), F.col("body"), BY_LABEL["TESS"]).select("bibcode", F.md5("modif_none").alias("h"))


_CUT = _HIT + ", c AS (SELECT h.bibcode, h.mission, h.i, s.sentence, regexp_replace(s.sentence, '[.?!]+$', '') AS t, regexp_extract(s.sentence, '[.?!]+$') AS mark FROM hit h JOIN s ON s.bibcode = h.bibcode AND s.i = h.i)"
_EACH_ANON = f"(CASE mission {' '.join(f'WHEN {chr(39)}{m.label}{chr(39)} THEN {_anon(chr(116), m)}' for m in MISSIONS)} END || mark)"


@query("q_modif_missions", f"WITH {_CUT}, n AS (SELECT bibcode, mission, i, sentence, {_EACH_ANON} AS a FROM c) SELECT bibcode, mission, md5(string_agg({_streamline('a')}, chr(10) ORDER BY i)) AS modif, md5(string_agg(sentence, chr(10) ORDER BY i)) AS modif_none FROM n GROUP BY 1, 2")
def q_modif_missions(s, d):
    """Of every mission the sentences that hold it, as they are and without its terms."""
    out = paragraphs.modified_by_mission(A.papers(s, d), F.col("body"), anon=True)
    return out.select("bibcode", "mission", F.md5("modif").alias("modif"), F.md5("modif_none").alias("modif_none"))


@query("q_keyword_spans")
def q_keyword_spans(s, d):
    rows = A.papers(s, d).where(T.mentions(F.col("body"), BY_LABEL["HST"]))
    return rows.select("bibcode", F.inline(nlp.spans(F.col("body"), BY_LABEL["HST"])))
