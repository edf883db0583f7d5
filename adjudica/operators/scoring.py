"""Scores of runs: phase percentages, majority baselines, adjusted scores, leaderboard rows.

All take the decision table (run, phase, case_id, qid, qtype, err, refused, label, value, gt, point).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.answers import credit, percent


def case_means(decisions: DataFrame) -> DataFrame:
    """(run, phase, case_id, err, points): the mean credit of each case over its questions; null if it failed."""
    return decisions.groupBy("run", "phase", "case_id", "err").agg(F.avg("point").alias("points"))


def score_phases(decisions: DataFrame) -> DataFrame:
    """(run, phase, n, n_ok, pct): cases, cases without error, and the mean of those cases' means in percent."""
    means = case_means(decisions)
    return means.groupBy("run", "phase").agg(F.count("*").alias("n"), F.count_if(~F.col("err")).alias("n_ok"), (F.avg("points") * 100).alias("pct"))


def question_points(decisions: DataFrame) -> DataFrame:
    """(run, phase, qid, points, hits, n): sum of credit, decisions fully right, decisions of cases without error."""
    ok = ~F.col("err")
    return decisions.groupBy("run", "phase", "qid").agg(F.sum("point").alias("points"), F.count_if(ok & (F.col("point") == 1.0)).alias("hits"), F.count_if(ok).alias("n"))


def majority_labels(universe: DataFrame) -> DataFrame:
    """(phase, qid, qtype, mode): the commonest label; of equal counts, the one that the smallest case has."""
    counts = universe.groupBy("phase", "qid", "qtype", "gt").agg(F.count("*").alias("c"), F.min("case_id").alias("first"))
    return counts.groupBy("phase", "qid", "qtype").agg(F.max_by("gt", F.struct("c", -F.col("first"))).alias("mode"))


def majority_baseline(universe: DataFrame) -> DataFrame:
    """(phase, base): percent that answering each question with its commonest label earns, off-by-one levels included.

    ``universe`` is (phase, case_id, qid, qtype, gt), one row a case and question.
    """
    modes = majority_labels(universe)
    mode = F.col("mode")
    value = F.when(F.col("qtype") != "choice", mode.try_cast("double"))
    earned = credit(F.col("qtype"), mode, value, F.col("gt"), F.lit(False), F.lit(False))
    by_case = universe.join(F.broadcast(modes), ["phase", "qid", "qtype"]).withColumn("point", earned).groupBy("phase", "case_id").agg(F.avg("point").alias("points"))
    return by_case.groupBy("phase").agg((F.avg("points") * 100).alias("base"))


def adjusted(phases: DataFrame, baseline: DataFrame) -> DataFrame:
    """(run, n_phases, adjusted): the mean over complete phases of the gain over the baseline in percent of what the
    baseline leaves; phases with a failed case, and phases that the baseline solves, are left out.  A run without any
    such phase has a null score."""
    counted = phases.join(F.broadcast(baseline), "phase").withColumn("counts", (F.col("n_ok") == F.col("n")) & (F.col("base") < 100))
    gain = F.when(F.col("counts"), (F.col("pct") - F.col("base")) / (100 - F.col("base")) * 100)
    return counted.groupBy("run").agg(F.count_if("counts").alias("n_phases"), F.avg(gain).alias("adjusted"))


def over_phases(value: Column, phases: list[str]) -> Column:
    """Aggregate: the mean of ``value`` over some phases."""
    return F.avg(F.when(F.col("phase").isin(phases), value))


def hits_of(condition: Column) -> Column:
    return percent(F.count_if(condition), F.count("*"))
