"""Answers of registered deciders, held against the same arithmetic in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import rounded
from adjudica.operators.deciders import Question, decide
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import OPTIONS, VIEWS

QUESTIONS = (Question("quality", "noul"), Question("toxic", "noul"), Question("length", "score", ("0", "1", "2")), Question("language", "choice", OPTIONS))


@query(VIEWS + """, f AS (SELECT run, case_id, max(CASE WHEN opt = 'es' THEN p END) AS p_es FROM v_probs GROUP BY run, case_id)
SELECT v.run, v.case_id, v.qid, CASE WHEN v.case_id % 31 = 0 THEN NULL ELSE round(v.value, 6) END AS value, CASE WHEN v.case_id % 31 = 0 THEN NULL ELSE v.label END AS label, CASE WHEN v.qid = 'language' AND v.case_id % 31 <> 0 THEN round(p_es, 6) END AS p_es, CASE WHEN v.case_id % 31 = 0 THEN 'RuntimeError: no answer' END AS error
FROM v_decisions v JOIN f USING (run, case_id)""")
def decided_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four questions about each case of each run by the arithmetic decider, which sees the options in another order and fails on
    one case in 31."""
    cases = tables.records(spark, sf_dir).select("run", "case_id", F.coalesce("toxic", F.lit(0)).alias("toxic"), "gt_lang")
    made = decide(cases, "arithmetic", QUESTIONS, ["run", "case_id"], order=("fr", "en", "es", "de"), fail_every=31)
    return made.select("run", "case_id", "qid", rounded(F.col("value")).alias("value"), "label", rounded(F.col("probabilities")["es"]).alias("p_es"), "error")
