"""Nested result documents: one JSON file a run and phase, {"meta": {...}, "cases": {id: record}}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER = T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("choice", T.StringType()), ("score", T.DoubleType()), ("noul", T.DoubleType()), ("probabilities", T.MapType(T.StringType(), T.DoubleType())), ("confidence", T.DoubleType()))])
ANSWERS = T.MapType(T.StringType(), ANSWER)
RECORD = T.StructType([T.StructField(n, t) for n, t in (("answers", ANSWERS), ("error", T.StringType()), ("ms", T.LongType()), ("cost", T.DoubleType()), ("model", T.StringType()), ("config_sha256", T.StringType()))])
DOCUMENT = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("cases", T.MapType(T.StringType(), RECORD))])


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(run, phase, case_id, error, ms, cost, model, config_sha256, answers) of result files <run>/<phase>.json.

    A number that should be one but is a JSON boolean is null.  A case without an error and without answers has null
    answers.  Files are read whole, one a task at least.
    """
    docs = spark.read.schema(DOCUMENT).json(paths, multiLine=True)
    path = F.col("_metadata.file_path")
    named = docs.select(F.regexp_extract(path, r"([^/]+)/[^/]+\.json$", 1).alias("run"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("phase"), F.explode("cases").alias("case_id", "r"))
    return named.select("run", "phase", "case_id", *[f"r.{n}" for n in ("error", "ms", "cost", "model", "config_sha256", "answers")])


def flatten_answers(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qid, refused, label, value, probs: one row a question.  NaN counts as null."""
    each = records.select(*keys, F.explode("answers").alias("qid", "a"))
    value = F.coalesce("a.score", "a.noul")
    return each.select(*keys, "qid", (F.coalesce(F.col("a.type"), F.lit("")) == "refusal").alias("refused"), F.col("a.choice").alias("label"), F.nanvl(value, F.lit(None).cast("double")).alias("value"), F.col("a.probabilities").alias("probs"))


def write_results(records: DataFrame, path: str) -> None:
    """Records (run, phase, case_id, ...) as a Parquet table by run and phase; a second write replaces only the runs and
    phases that it has."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "phase").parquet(path)
