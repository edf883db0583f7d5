"""Scores, baselines and leaderboards of the derived runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import decision_label, rounded
from adjudica.operators import scoring as op
from adjudica.operators.ranking import order_statistics
from adjudica.plans.decisions import decisions
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import VIEWS

#: Errors of one language only, so that other phases are complete.
BROKEN_PHASE = "en"

PHASES = VIEWS + """, v_means AS (SELECT run, phase, case_id, err, avg(point) AS points FROM v_points GROUP BY ALL),
v_phases AS (SELECT run, phase, count(*) AS n, CAST(sum(CASE WHEN err THEN 0 ELSE 1 END) AS BIGINT) AS n_ok, avg(points) * 100 AS pct FROM v_means GROUP BY run, phase),
v_universe AS (SELECT DISTINCT phase, case_id, qid, qtype, gt FROM v_decisions),
v_modes AS (SELECT phase, qid, qtype, gt AS mode FROM (SELECT *, row_number() OVER (PARTITION BY phase, qid ORDER BY c DESC, first) AS rn FROM (
  SELECT phase, qid, qtype, gt, count(*) AS c, min(case_id) AS first FROM v_universe GROUP BY ALL)) WHERE rn = 1),
v_base AS (SELECT phase, avg(points) * 100 AS base FROM (SELECT phase, case_id, avg(CASE WHEN qtype = 'score' THEN
    CASE abs(CAST(mode AS INT) - CAST(gt AS INT)) WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    ELSE CASE WHEN mode = gt THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END) AS points
  FROM v_universe JOIN v_modes USING (phase, qid, qtype) GROUP BY phase, case_id) GROUP BY phase),
v_whole AS (SELECT run, phase, n, CASE WHEN phase = 'en' THEN n_ok ELSE n END AS n_ok, pct FROM v_phases),
v_adjusted AS (SELECT run, CAST(sum(CASE WHEN n_ok = n AND base < 100 THEN 1 ELSE 0 END) AS BIGINT) AS n_phases,
  avg(CASE WHEN n_ok = n AND base < 100 THEN (pct - base) / (100 - base) * 100 END) AS adjusted FROM v_whole JOIN v_base USING (phase) GROUP BY run)
"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of every case, once: run 0 has them all."""
    return decisions(spark, sf_dir).where("run = 0").select("phase", "case_id", "qid", "qtype", "gt")


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.score_phases(decisions(spark, sf_dir))


def whole_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase scores with the failures of all but one phase forgiven, as if those cases had been run again."""
    forgiven = F.when(F.col("phase") == BROKEN_PHASE, F.col("n_ok")).otherwise(F.col("n"))
    return phases(spark, sf_dir).withColumn("n_ok", forgiven)


@query(VIEWS + "SELECT run, phase, qid, round(sum(point), 6) AS points, CAST(sum(CASE WHEN NOT err AND point = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN err THEN 0 ELSE 1 END) AS BIGINT) AS n FROM v_points GROUP BY run, phase, qid")
def score_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.question_points(decisions(spark, sf_dir)).withColumn("points", rounded(F.col("points")))


@query(PHASES + ", t AS (SELECT run, phase, avg(ms) AS ms_mean, sum(cost) AS cost FROM v_records GROUP BY run, phase) SELECT run, phase, n, n_ok, round(pct, 6) AS pct, round(ms_mean, 6) AS ms_mean, round(cost, 9) AS cost FROM v_phases JOIN t USING (run, phase)")
def score_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    telemetry = tables.records(spark, sf_dir).groupBy("run", "phase").agg(rounded(F.avg("ms")).alias("ms_mean"), F.round(F.sum("cost"), 9).alias("cost"))
    return phases(spark, sf_dir).withColumn("pct", rounded(F.col("pct"))).join(telemetry, ["run", "phase"])


@query(VIEWS + "SELECT run, phase, qid, case_id FROM v_points WHERE NOT err AND point < 1")
def missed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).where(~F.col("err") & (F.col("point") < 1)).select("run", "phase", "qid", "case_id")


@query(PHASES + "SELECT phase, qid, mode FROM v_modes")
def majority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.majority_labels(universe(spark, sf_dir)).select("phase", "qid", "mode")


@query(PHASES + "SELECT phase, round(base, 6) AS base FROM v_base")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.majority_baseline(universe(spark, sf_dir)).withColumn("base", rounded(F.col("base")))


@query(PHASES + "SELECT run, n_phases, round(adjusted, 6) AS adjusted FROM v_adjusted")
def adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.adjusted(whole_phases(spark, sf_dir), op.majority_baseline(universe(spark, sf_dir)))
    return found.withColumn("adjusted", rounded(F.col("adjusted")))


@query(PHASES + """, q AS (SELECT run, round(avg(CASE WHEN phase = 'en' THEN pct END), 6) AS en, round(avg(CASE WHEN phase <> 'en' THEN pct END), 6) AS other, CAST(sum(n_ok) AS BIGINT) AS ok, CAST(sum(n) AS BIGINT) AS cases FROM v_phases GROUP BY run),
b AS (SELECT run, round(avg((value - gt) * (value - gt)), 6) AS brier FROM v_binary WHERE NOT err GROUP BY run),
m AS (SELECT run, ms AS ms_median FROM (SELECT run, ms, row_number() OVER (PARTITION BY run ORDER BY ms) AS rn, count(*) OVER (PARTITION BY run) AS n FROM v_records WHERE NOT err) WHERE rn = n // 2 + 1)
SELECT run, round(adjusted, 6) AS adjusted, n_phases < 4 AS partial, en, other, ok, cases, brier, ms_median FROM v_adjusted JOIN q USING (run) JOIN b USING (run) JOIN m USING (run)""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run: adjusted score (partial if not over all phases), phase group means, coverage, Brier, upper median ms."""
    scores = adjusted_scores(spark, sf_dir).select("run", "adjusted", (F.col("n_phases") < len(tables.OPTIONS)).alias("partial"))
    pct = F.col("pct")
    groups = phases(spark, sf_dir).groupBy("run").agg(rounded(op.over_phases(pct, ["en"])).alias("en"), rounded(op.over_phases(pct, ["de", "fr", "es"])).alias("other"), F.sum("n_ok").alias("ok"), F.sum("n").alias("cases"))
    brier = tables.binary(spark, sf_dir).where("NOT err").groupBy("run").agg(rounded(F.avg((F.col("value") - F.col("gt")) ** 2)).alias("brier"))
    median = order_statistics(tables.records(spark, sf_dir).where("NOT err"), ["run"], "ms", {"ms_median": F.floor(F.col("n") / 2)}).drop("n")
    return scores.join(groups, "run").join(brier, "run").join(median, "run")


@query(VIEWS + "SELECT run, phase, count(*) AS n, CAST(sum(CASE WHEN value BETWEEN CAST(0.45 AS DOUBLE) AND CAST(0.55 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS border FROM v_binary WHERE NOT err GROUP BY run, phase")
def border_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = tables.binary(spark, sf_dir).where("NOT err")
    return answers.groupBy("run", "phase").agg(F.count("*").alias("n"), F.count_if(F.col("value").between(0.45, 0.55)).alias("border"))


@query(VIEWS + "SELECT case_id, gt FROM v_option WHERE run = 0 GROUP BY case_id, gt HAVING sum(CASE WHEN opt = gt AND ord < 3 THEN 1 ELSE 0 END) = 0")
def gt_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the options on offer, here the first three."""
    listed = F.array(*[F.lit(x) for x in tables.OPTIONS[:3]])
    return universe(spark, sf_dir).where((F.col("qid") == "language") & ~F.array_contains(listed, F.col("gt"))).select("case_id", "gt")


@query(VIEWS + "SELECT run, count(*) AS n, CAST(sum(CASE WHEN hi - lo < CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS near_uniform FROM (SELECT run, case_id, max(p) AS hi, min(p) AS lo FROM v_probs GROUP BY run, case_id) GROUP BY run")
def near_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat probability vectors, over all stored records, failed ones included."""
    span = tables.options(spark, sf_dir).groupBy("run", "case_id").agg((F.max("p") - F.min("p")).alias("span"))
    return span.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("span") < 0.05).alias("near_uniform"))


_SAID = VIEWS + ", said AS (SELECT *, CASE qtype WHEN 'choice' THEN label WHEN 'noul' THEN CASE WHEN value >= CAST(0.5 AS DOUBLE) THEN '1' ELSE '0' END ELSE CAST(CAST(least(2, greatest(0, round_even(value, 0))) AS INT) AS VARCHAR) END AS said FROM v_decisions WHERE NOT err AND NOT refused) "


@query(_SAID + "SELECT run, qid, said, count(*) AS n FROM said GROUP BY run, qid, said")
def decision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decisions(spark, sf_dir).where("NOT err AND NOT refused")
    return made.groupBy("run", "qid", decision_label(F.col("qtype"), F.col("label"), F.col("value")).alias("said")).agg(F.count("*").alias("n"))


@query(_SAID + "SELECT phase, qid, rule, count(*) AS n, round(avg(hit), 6) AS hits FROM (SELECT phase, qid, 'said' AS rule, CAST(said = gt AS INT) AS hit FROM said UNION ALL SELECT phase, qid, 'always_0', CAST('0' = gt AS INT) FROM said UNION ALL SELECT phase, qid, 'always_1', CAST('1' = gt AS INT) FROM said) GROUP BY ALL")
def rule_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several decision rules by question."""
    made = decisions(spark, sf_dir).where("NOT err AND NOT refused")
    said = decision_label(F.col("qtype"), F.col("label"), F.col("value"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), (x == F.col("gt")).cast("int").alias("hit")) for n, x in (("said", said), ("always_0", F.lit("0")), ("always_1", F.lit("1")))])
    return made.select("phase", "qid", F.explode(rules).alias("r")).groupBy("phase", "qid", "r.rule").agg(F.count("*").alias("n"), rounded(F.avg("r.hit")).alias("hits"))


@query(PHASES + """, d AS (SELECT a.phase, a.pct AS d1, b.pct AS casc, c.pct AS ref FROM v_phases a JOIN v_phases b USING (phase) JOIN v_phases c USING (phase) WHERE a.run = 0 AND b.run = 1 AND c.run = 2)
SELECT round(avg(casc - d1), 6) AS gain, round(avg(ref - d1), 6) AS gain_ref, round(CASE WHEN avg(ref - d1) > 0 THEN avg(casc - d1) / avg(ref - d1) END, 6) AS fraction, CAST(sum(CASE WHEN casc - d1 < -2 THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM d""")
def recovery_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of a reference run's gain over the first run another run recovers; none if there is no gain."""
    wide = phases(spark, sf_dir).groupBy("phase").pivot("run", [0, 1, 2]).agg(F.first("pct"))
    gain, ref = F.col("1") - F.col("0"), F.col("2") - F.col("0")
    return wide.agg(rounded(F.avg(gain)).alias("gain"), rounded(F.avg(ref)).alias("gain_ref"), rounded(F.when(F.avg(ref) > 0, F.avg(gain) / F.avg(ref))).alias("fraction"), F.count_if(gain < -2).alias("losses"))
