"""A run that can be killed anywhere and resumed: marks before attempts, results once, failed cases tried again once.

The universe is a stream of files; Structured Streaming's checkpoint says which micro-batch is open.  A batch first writes its
mark, then works, then replaces its own folder of results, so a batch that is played again after a crash ends with the same
rows in the same place.  A batch whose mark was written ``attempts`` times without a result is given up: its cases get an
error, and are never sent again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Work = Callable[[DataFrame], DataFrame]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_resumable(universe: DataFrame, work: Work, folder: str, *, key: str, attempts: int = 2) -> None:
    """Does all that the stream ``universe`` has by ``work``, and returns when it is done; call it again after a failure.

    ``work`` takes rows of the universe and returns one for each ``key``, with a string ``error`` (null: none) among its columns, which
    must be the same each time.  ``folder`` holds marks, results and the stream's checkpoint.
    """
    folder = folder.rstrip("/")

    def attempt(batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, f"{folder}/done/batch={number}"
        if _exists(spark, f"{done}/_SUCCESS"):
            return  # it was finished, and only the stream's own commit was lost
        before = next(k for k in range(attempts + 1) if not _exists(spark, f"{folder}/marks/batch={number}/attempt={k}/_SUCCESS"))
        if before < attempts:
            batch.select(key).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}/attempt={before}")
            made = work(batch)
        else:
            made = work(batch.limit(0)).select(key, "error")  # the columns' types
            made = batch.select(key).join(made, key, "left").withColumn("error", F.lit("given up"))
            made = work(batch.limit(0)).unionByName(made, allowMissingColumns=True)
        made.write.mode("overwrite").parquet(done)

    stream = universe.writeStream.foreachBatch(attempt).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()


def retry_errors(spark: SparkSession, universe: DataFrame, work: Work, folder: str, *, key: str) -> int:
    """Tries each case with an error once more, and returns how many were tried; ``universe`` is a table here.

    The mark of a case is written before it is tried; a case with a mark is never tried again, also where the first try was
    killed.  Results of a retry stand in a folder of their own.
    """
    folder = folder.rstrip("/")
    failed = spark.read.parquet(f"{folder}/done").where(F.col("error").isNotNull()).select(key)
    number = 0
    while _exists(spark, f"{folder}/retry-marks/pass={number}"):
        number += 1
    if number:
        failed = failed.join(spark.read.parquet(f"{folder}/retry-marks").select(key), key, "left_anti")
    marks = f"{folder}/retry-marks/pass={number}"
    failed.write.parquet(marks)
    marked = spark.read.parquet(marks)
    n = marked.count()
    if n:
        work(universe.join(marked, key, "left_semi")).write.parquet(f"{folder}/retried/pass={number}")
    return n


def results(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The result of each case, of its retry where that has one, with ``tries`` (1 or 2)."""
    folder = folder.rstrip("/")
    done = spark.read.parquet(f"{folder}/done").drop("batch").withColumn("tries", F.lit(1))
    if not _exists(spark, f"{folder}/retried"):
        return done
    again = spark.read.parquet(f"{folder}/retried").drop("pass").withColumn("tries", F.lit(2))
    return done.join(again.select(key), key, "left_anti").unionByName(again)
