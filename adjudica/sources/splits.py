"""Split files with a running id in the order of files and rows, and one output folder a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file that are numbered together.
SPAN = 100_000


def read_split(spark: SparkSession, paths: str | list[str], split: str, usable: Column, *, span: int = SPAN) -> DataFrame:
    """The usable rows of Parquet files, with ``id`` = ``split``-000000, -000001, ... in the order of file names and rows.

    A row's number is its place in its span of the file, plus what usable rows the spans before have: spans are numbered
    each in its own task, and only their counts meet.
    """
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.where(usable).withColumn("_span", F.floor(F.col("_row") / span))
    counts = rows.groupBy("_file", "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_file", "_span", before.alias("_before"))  # one row a span
    place = F.row_number().over(Window.partitionBy("_file", "_span").orderBy("_row")) - 1
    numbered = rows.withColumn("_place", place).join(F.broadcast(counts), ["_file", "_span"])
    number = (F.col("_place") + F.col("_before")).cast("string")
    return numbered.select(F.concat(F.lit(f"{split}-"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0"))).alias("id"), *[c for c in rows.columns if c[0] != "_"])


def write_buckets(rows: DataFrame, folder: str, by: list[str]) -> None:
    """One folder for each value of ``by``; folders of other values stay as they are, those of the values written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)
