"""The fact table that the scoring plans read: one row a run, case and question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import credit, first_best
from adjudica.sources import tables


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option each choice answer takes, with its probability."""
    taken = tables.options(spark, sf_dir).groupBy("run", "phase", "case_id", "cluster_id", "err", "gt")
    return taken.agg(first_best(F.col("w"), F.col("ord"), F.struct("opt", "p")).alias("best")).select("run", "phase", "case_id", "cluster_id", "err", "gt", F.col("best.opt").alias("label"), F.col("best.p").alias("p"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, phase, case_id, cluster_id, qid, qtype, err, refused, label, value, gt, point.

    One scan of the labels: the three kinds of question are an array that is exploded, so there is no union of scans and
    no shuffle; the choice's argmax is taken within the row.
    """
    run, case = F.col("run"), F.col("case_id")
    rows = tables.records(spark, sf_dir)
    weights = F.array(*[
        F.struct(
            (1 + (case * (7 + 2 * k) + run * 5) % 13 + F.when((F.col("gt_lang") == name) & ((case + run) % 4 != 0), 9).otherwise(0)).cast("int").alias("w"),
            F.lit(-k).alias("first"),
            F.lit(name).alias("opt"),
        )
        for k, name in enumerate(tables.OPTIONS)
    ])
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def question(qid: str, qtype: str, refused, label, value, gt):
        return F.struct(F.lit(qid).alias("qid"), F.lit(qtype).alias("qtype"), refused.alias("refused"), label.alias("label"), value.alias("value"), gt.cast("string").alias("gt"))

    asked = F.array(
        question("quality", "noul", F.lit(False), none_s, ((case * 37 + run * 11) % 101).cast("double") / 100, F.col("quality").cast("int")),
        question("toxic", "noul", ~F.col("err") & ((case * 5 + run) % 41 == 0), none_s, ((case * 53 + run * 23 + F.col("toxic") * 40) % 101).cast("double") / 100, F.col("toxic").cast("int")),
        question("length", "score", F.lit(False), none_s, ((case * 13 + run * 7) % 201).cast("double") / 100, F.col("gt_len")),
        question("language", "choice", F.lit(False), F.array_max(weights)["opt"], none_d, F.col("gt_lang")),
    )
    long = rows.select("run", "phase", "case_id", "cluster_id", "err", F.explode(asked).alias("q")).select("run", "phase", "case_id", "cluster_id", "err", "q.*")
    return long.withColumn("point", credit(F.col("qtype"), F.col("label"), F.col("value"), F.col("gt"), F.col("err"), F.col("refused")))
