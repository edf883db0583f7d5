"""Readers of the Parquet tables, and the decision data derived from them by integer arithmetic.

The derived tables are invented test data with the shapes of evaluation runs: three runs answer two yes/no questions
(``quality``, ``toxic``), an ordinal one (``length``, 3 levels) and a choice (``language``, 4 options) about each labelled
document.  ``VIEWS`` states the same tables as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = (0, 1, 2)
#: The options of the choice question, in their semantic order.
OPTIONS = ("en", "de", "fr", "es")

VIEWS = """WITH v_cases AS (
  SELECT l.doc_id AS case_id, d.lang AS phase, l.quality, l.toxic, d.lang AS gt_lang, d.source AS cluster_id,
         CASE WHEN d.n_chars < 400 THEN 0 WHEN d.n_chars < 2000 THEN 1 ELSE 2 END AS gt_len
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
v_records AS (
  SELECT r.run, c.*, ((c.case_id*3 + r.run*5) % 29 = 0) AS err, CAST(100 + (c.case_id*17 + r.run*29) % 900 AS BIGINT) AS ms,
         CASE WHEN (c.case_id + r.run) % 7 = 0 THEN NULL ELSE CAST((c.case_id*13 + r.run) % 50 AS DOUBLE)/1000000 END AS cost
  FROM v_cases c CROSS JOIN (SELECT 0 AS run UNION ALL SELECT 1 UNION ALL SELECT 2) r),
v_binary AS (
  SELECT run, phase, case_id, cluster_id, 'quality' AS qid, err, CAST(quality AS INT) AS gt, CAST((case_id*37 + run*11) % 101 AS DOUBLE)/100 AS value FROM v_records
  UNION ALL
  SELECT run, phase, case_id, cluster_id, 'toxic', err, CAST(toxic AS INT), CAST((case_id*53 + run*23 + toxic*40) % 101 AS DOUBLE)/100 FROM v_records),
v_score AS (
  SELECT run, phase, case_id, cluster_id, err, gt_len AS gt, CAST((case_id*13 + run*7) % 201 AS DOUBLE)/100 AS value FROM v_records),
v_option AS (
  SELECT run, phase, case_id, cluster_id, err, gt_lang AS gt, o.ord, o.opt,
         CAST(1 + (case_id*(7+2*o.ord) + run*5) % 13 + CASE WHEN o.opt = gt_lang AND (case_id+run) % 4 <> 0 THEN 9 ELSE 0 END AS INT) AS w
  FROM v_records CROSS JOIN (SELECT 0 AS ord,'en' AS opt UNION ALL SELECT 1,'de' UNION ALL SELECT 2,'fr' UNION ALL SELECT 3,'es') o),
v_probs AS (SELECT *, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY run, case_id) AS p FROM v_option),
v_choice AS (
  SELECT run, phase, case_id, cluster_id, err, gt, opt AS label, p FROM (
    SELECT *, row_number() OVER (PARTITION BY run, case_id ORDER BY w DESC, ord) AS rn FROM v_probs) WHERE rn = 1),
v_decisions AS (
  SELECT run, phase, case_id, cluster_id, qid, 'noul' AS qtype, err, (NOT err AND qid = 'toxic' AND (case_id*5 + run) % 41 = 0) AS refused, CAST(NULL AS VARCHAR) AS label, value, CAST(gt AS VARCHAR) AS gt FROM v_binary
  UNION ALL SELECT run, phase, case_id, cluster_id, 'length', 'score', err, FALSE, NULL, value, CAST(gt AS VARCHAR) FROM v_score
  UNION ALL SELECT run, phase, case_id, cluster_id, 'language', 'choice', err, FALSE, label, NULL, gt FROM v_choice),
v_points AS (
  SELECT *, CASE WHEN err THEN NULL WHEN refused THEN CAST(0 AS DOUBLE)
    WHEN qtype = 'choice' THEN CASE WHEN label = gt THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    WHEN qtype = 'noul' THEN CASE WHEN (value >= CAST(0.5 AS DOUBLE)) = (gt = '1') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    ELSE CASE abs(least(2, greatest(0, round_even(value, 0))) - CAST(gt AS INT)) WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    END AS point
  FROM v_decisions)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a labelled document: case_id, phase (language), labels, length level, cluster (source)."""
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    length = F.when(F.col("n_chars") < 400, 0).when(F.col("n_chars") < 2000, 1).otherwise(2)
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("phase"), "quality", "toxic", F.col("lang").alias("gt_lang"), F.col("source").alias("cluster_id"), length.alias("gt_len"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run and case, with errors, latency and cost (null: unknown)."""
    run, case = F.col("run"), F.col("case_id")
    cost = F.when((case + run) % 7 != 0, ((case * 13 + run) % 50).cast("double") / 1000000)
    return (
        cases(spark, sf_dir)
        .withColumn("run", F.explode(F.array(*[F.lit(r) for r in RUNS])))
        .withColumns({"err": (case * 3 + run * 5) % 29 == 0, "ms": (100 + (case * 17 + run * 29) % 900).cast("long"), "cost": cost})
    )


def _hundredths(x: Column) -> Column:
    return (x % 101).cast("double") / 100


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yes/no answers: qid, gt 0/1, value = probability of yes."""
    run, case = F.col("run"), F.col("case_id")
    questions = F.array(
        F.struct(F.lit("quality").alias("qid"), F.col("quality").cast("int").alias("gt"), _hundredths(case * 37 + run * 11).alias("value")),
        F.struct(F.lit("toxic").alias("qid"), F.col("toxic").cast("int").alias("gt"), _hundredths(case * 53 + run * 23 + F.col("toxic") * 40).alias("value")),
    )
    return records(spark, sf_dir).select("run", "phase", "case_id", "cluster_id", "err", F.explode(questions).alias("q")).select("run", "phase", "case_id", "cluster_id", "q.qid", "err", "q.gt", "q.value")


def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordinal answers: gt 0..2, value from 0 to 2."""
    value = ((F.col("case_id") * 13 + F.col("run") * 7) % 201).cast("double") / 100
    return records(spark, sf_dir).select("run", "phase", "case_id", "cluster_id", "err", F.col("gt_len").alias("gt"), value.alias("value"))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice answers, one row an option: ord, opt, weight w and probability p."""
    run, case = F.col("run"), F.col("case_id")
    listed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("opt")) for k, name in enumerate(OPTIONS)])

    def weighed_option(x: Column) -> Column:
        bonus = F.when((x["opt"] == F.col("gt_lang")) & ((case + run) % 4 != 0), 9).otherwise(0)
        return F.struct(x["ord"].alias("ord"), x["opt"].alias("opt"), (1 + (case * (7 + 2 * x["ord"]) + run * 5) % 13 + bonus).cast("int").alias("w"))

    whole = F.aggregate(F.col("ws"), F.lit(0), lambda a, x: a + x["w"])
    weighed = records(spark, sf_dir).withColumn("ws", F.transform(listed, weighed_option)).withColumn("whole", whole)
    return weighed.select("run", "phase", "case_id", "cluster_id", "err", F.col("gt_lang").alias("gt"), "whole", F.explode("ws").alias("x")).select("run", "phase", "case_id", "cluster_id", "err", "gt", "x.ord", "x.opt", "x.w", (F.col("x.w").cast("double") / F.col("whole")).alias("p"))
