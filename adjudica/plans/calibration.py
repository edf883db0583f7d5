"""Calibration and error-rate queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import rounded, yes_confidence
from adjudica.operators.ranking import order_statistics
from adjudica.plans.decisions import choices
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import VIEWS

#: Least probability in a logarithm.
FLOOR = 1e-6


def one_hot_terms(p: Column, is_gt: Column) -> tuple[Column, Column]:
    """An option's part of the multiclass Brier score (not halved) and of the log loss."""
    return (p - is_gt.cast("double")) ** 2, F.when(is_gt, -F.ln(F.greatest(F.lit(FLOOR), p))).otherwise(0.0)


def bin_of(confidence: Column, bins: int = 10) -> Column:
    """The bin of a confidence: lower edge excluded, upper included, 0 in the first."""
    return F.greatest(F.ceil(confidence * bins) - 1, F.lit(0)).cast("int")


def expected_calibration_error(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, ece) of (confidence, hit): the mean gap between confidence and hits over ten bins, weighted by size."""
    bins = rows.groupBy(*by, bin_of(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("confidence") - F.avg(F.col("hit").cast("double"))).alias("gap"))
    return bins.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


@query(VIEWS + """SELECT run, phase, qid, count(*) AS n, round(avg((value - gt) * (value - gt)), 6) AS brier, round(avg(-ln(greatest(1e-6, CASE WHEN gt = 1 THEN value ELSE 1 - value END))), 6) AS nll FROM v_binary WHERE NOT err GROUP BY run, phase, qid""")
def brier_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("gt") == 1, F.col("value")).otherwise(1 - F.col("value"))
    answers = tables.binary(spark, sf_dir).where("NOT err")
    return answers.groupBy("run", "phase", "qid").agg(F.count("*").alias("n"), rounded(F.avg((F.col("value") - F.col("gt")) ** 2)).alias("brier"), rounded(F.avg(-F.ln(F.greatest(F.lit(FLOOR), p)))).alias("nll"))


@query(VIEWS + """, c AS (SELECT run, phase, case_id, sum((p - CASE WHEN opt = gt THEN 1 ELSE 0 END) * (p - CASE WHEN opt = gt THEN 1 ELSE 0 END)) AS b, sum(CASE WHEN opt = gt THEN -ln(greatest(1e-6, p)) ELSE 0 END) AS l FROM v_probs WHERE NOT err GROUP BY ALL)
SELECT run, phase, count(*) AS n, round(avg(b), 6) AS brier, round(avg(l), 6) AS nll FROM c GROUP BY run, phase""")
def brier_nll_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    brier, loss = one_hot_terms(F.col("p"), F.col("opt") == F.col("gt"))
    by_case = tables.options(spark, sf_dir).where("NOT err").groupBy("run", "phase", "case_id").agg(F.sum(brier).alias("b"), F.sum(loss).alias("l"))
    return by_case.groupBy("run", "phase").agg(F.count("*").alias("n"), rounded(F.avg("b")).alias("brier"), rounded(F.avg("l")).alias("nll"))


@query(VIEWS + """, c AS (SELECT run, greatest(value, 1 - value) AS confidence, CASE WHEN (value >= CAST(0.5 AS DOUBLE)) = (gt = 1) THEN 1 ELSE 0 END AS hit FROM v_binary WHERE NOT err
  UNION ALL SELECT run, p, CASE WHEN label = gt THEN 1 ELSE 0 END FROM v_choice WHERE NOT err),
b AS (SELECT run, greatest(CAST(ceil(confidence * 10) AS INT) - 1, 0) AS bin, count(*) AS n, abs(avg(confidence) - avg(hit)) AS gap FROM c GROUP BY run, bin)
SELECT run, CAST(sum(n) AS BIGINT) AS n, round(sum(n * gap) / sum(n), 6) AS ece FROM b GROUP BY run""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled over yes/no and choice questions."""
    yes_no = tables.binary(spark, sf_dir).where("NOT err").select("run", yes_confidence(F.col("value")).alias("confidence"), ((F.col("value") >= 0.5) == (F.col("gt") == 1)).alias("hit"))
    chosen = choices(spark, sf_dir).where("NOT err").select("run", F.col("p").alias("confidence"), (F.col("label") == F.col("gt")).alias("hit"))
    return expected_calibration_error(yes_no.unionByName(chosen), ["run"]).withColumn("ece", rounded(F.col("ece")))


@query(VIEWS + ", c AS (SELECT run, phase, qid, avg((value - gt) * (value - gt)) AS b FROM v_binary WHERE NOT err GROUP BY ALL) SELECT run, round(avg(b), 6) AS brier_noul FROM c GROUP BY run")
def brier_noul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over phases and questions, each counting alike."""
    cells = tables.binary(spark, sf_dir).where("NOT err").groupBy("run", "phase", "qid").agg(F.avg((F.col("value") - F.col("gt")) ** 2).alias("b"))
    return cells.groupBy("run").agg(rounded(F.avg("b")).alias("brier_noul"))


@query(VIEWS + """, c AS (SELECT run, greatest(value, 1 - value) AS confidence, (value >= CAST(0.5 AS DOUBLE)) = (gt = 1) AS hit FROM v_binary WHERE NOT err), t AS (SELECT unnest([CAST(0.9 AS DOUBLE), CAST(0.99 AS DOUBLE)]) AS threshold)
SELECT run, threshold, count(*) AS n, CAST(sum(CASE WHEN confidence >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS sure, round(100.0 * sum(CASE WHEN confidence >= threshold AND NOT hit THEN 1 ELSE 0 END) / count(*), 6) AS errors_per_100,
round(CAST(sum(CASE WHEN confidence >= threshold AND hit THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN confidence >= threshold THEN 1 ELSE 0 END), 0), 6) AS precision_sure,
round(CAST(sum(CASE WHEN confidence >= threshold AND NOT hit THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN NOT hit THEN 1 ELSE 0 END), 0), 6) AS share_of_errors FROM c CROSS JOIN t GROUP BY run, threshold""")
def confident_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = tables.binary(spark, sf_dir).where("NOT err").select("run", yes_confidence(F.col("value")).alias("confidence"), ((F.col("value") >= 0.5) == (F.col("gt") == 1)).alias("hit"), F.explode(F.array(F.lit(0.9), F.lit(0.99))).alias("threshold"))
    sure, hit = F.col("confidence") >= F.col("threshold"), F.col("hit")
    return answers.groupBy("run", "threshold").agg(
        F.count("*").alias("n"), F.count_if(sure).alias("sure"), rounded(100.0 * F.count_if(sure & ~hit) / F.count("*")).alias("errors_per_100"),
        rounded(F.try_divide(F.count_if(sure & hit).cast("double"), F.count_if(sure).cast("double"))).alias("precision_sure"),
        rounded(F.try_divide(F.count_if(sure & ~hit).cast("double"), F.count_if(~hit).cast("double"))).alias("share_of_errors"),
    )


_CONFUSION = """, c AS (SELECT run, phase, value >= CAST(0.5 AS DOUBLE) AS alert, gt = 1 AS truth, err FROM v_binary WHERE qid = 'toxic'),
k AS (SELECT run, phase, CAST(sum(CASE WHEN NOT err AND alert AND truth THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT err AND alert AND NOT truth THEN 1 ELSE 0 END) AS BIGINT) AS fp,
 CAST(sum(CASE WHEN (err OR NOT alert) AND truth THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN (err OR NOT alert) AND NOT truth THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM c GROUP BY run, phase)"""


@query(VIEWS + _CONFUSION + "SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall FROM k")
def alert_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts (probability of toxic 0.5 or more) against labels; a failed case raises none.  Undefined rates are null."""
    alert, truth = ~F.col("err") & (F.col("value") >= 0.5), F.col("gt") == 1
    counts = tables.binary(spark, sf_dir).where("qid = 'toxic'").groupBy("run", "phase").agg(F.count_if(alert & truth).alias("tp"), F.count_if(alert & ~truth).alias("fp"), F.count_if(~alert & truth).alias("fn"), F.count_if(~alert & ~truth).alias("tn"))
    rate = lambda a, b: rounded(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")))
    return counts.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")})


@query(VIEWS + """, c AS (SELECT run, phase, value, gt FROM v_binary WHERE qid = 'quality' AND NOT err) SELECT run, phase, round(avg(CASE WHEN gt = 1 THEN CASE WHEN value >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END END), 6) AS sensitivity,
 round(avg(CASE WHEN gt = 0 THEN CASE WHEN value >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END END), 6) AS false_positive_rate, round(avg(CASE WHEN gt = 0 THEN CASE WHEN value >= CAST(0.9 AS DOUBLE) THEN 1 ELSE 0 END END), 6) AS confident_fp_rate,
 round(100.0 * sum(CASE WHEN (gt = 1 AND value <= CAST(0.1 AS DOUBLE)) OR (gt = 0 AND value >= CAST(0.9 AS DOUBLE)) THEN 1 ELSE 0 END) / count(*), 6) AS confident_errors FROM c GROUP BY run, phase""")
def verifier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, gt = F.col("value"), F.col("gt")
    rate = lambda label, threshold: rounded(F.avg(F.when(gt == label, (value >= threshold).cast("int"))))
    wrong = ((gt == 1) & (value <= 0.1)) | ((gt == 0) & (value >= 0.9))
    return tables.binary(spark, sf_dir).where("qid = 'quality' AND NOT err").groupBy("run", "phase").agg(rate(1, 0.5).alias("sensitivity"), rate(0, 0.5).alias("false_positive_rate"), rate(0, 0.9).alias("confident_fp_rate"), rounded(100.0 * F.count_if(wrong) / F.count("*")).alias("confident_errors"))


@query(VIEWS + ", c AS (SELECT phase, qid, gt, count(*) AS c FROM v_binary WHERE run = 0 GROUP BY ALL), m AS (SELECT phase, qid, sum(c) AS n, max(c) AS top FROM c GROUP BY ALL) SELECT round(100.0 * sum(n - top) / sum(n), 6) AS majority_error FROM m")
def majority_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of yes/no questions that the commonest answer of their phase gets wrong."""
    counts = tables.binary(spark, sf_dir).where("run = 0").groupBy("phase", "qid", "gt").agg(F.count("*").alias("c"))
    cells = counts.groupBy("phase", "qid").agg(F.sum("c").alias("n"), F.max("c").alias("top"))
    return cells.agg(rounded(100.0 * F.sum(F.col("n") - F.col("top")) / F.sum("n")).alias("majority_error"))


@query(VIEWS + """, v AS (SELECT run, case_id, ord, p * (1 + CAST((case_id + ord) % 5 AS DOUBLE) / 50) AS q FROM v_probs), s AS (SELECT run, case_id, abs(sum(q) - 1) AS off FROM v GROUP BY run, case_id),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY off) - 1 AS k, count(*) OVER (PARTITION BY run) AS n FROM s)
SELECT run, count(*) AS n, round(max(CASE WHEN k = n // 2 THEN off END), 6) AS median, round(max(CASE WHEN k = CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT) - 1 THEN off END), 6) AS p95, round(max(off), 6) AS largest, CAST(sum(CASE WHEN off > CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_over FROM o GROUP BY run""")
def normalize_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far unnormalised vectors' sums are from 1: upper median, p95 by index, maximum, count above 0.05."""
    q = F.col("p") * (1 + ((F.col("case_id") + F.col("ord")) % 5).cast("double") / 50)
    off = tables.options(spark, sf_dir).groupBy("run", "case_id").agg(F.abs(F.sum(q) - 1).alias("off"))
    at = {"median": F.floor(F.col("n") / 2), "p95": F.floor(F.lit(0.95) * F.col("n")) - 1}
    found = order_statistics(off, ["run"], "off", at)
    rest = off.groupBy("run").agg(rounded(F.max("off")).alias("largest"), F.count_if(F.col("off") > 0.05).alias("n_over"))
    return found.join(rest, "run").withColumns({"median": rounded(F.col("median")), "p95": rounded(F.col("p95"))})
