"""Joins and staged tables that hold at any skew and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot; fewer keys than this can be.
HOT_KEYS = 1000


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application below ``spark.checkpoint.dir``, which driver and executors share.  A local session
    without that setting uses its warehouse; a cluster must name a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/adjudica-checkpoints"
    return f"{folder.rstrip('/')}/adjudica-staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in a folder of its own (:func:`own_folder`) and read again, which cuts the lineage with files
    that outlive any executor."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where its scan has fewer parts than there are cores; a scan with more stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def join_folded(rows: DataFrame, folded: DataFrame, key: Sequence[str], n_rows: int) -> DataFrame:
    """``rows`` with the columns of ``folded``, which has one row for each ``key`` and the key's number of rows as ``n``;
    ``n_rows`` is the sum of ``n``.  Keys compare null-safe.

    Rows of a hot key stay where they are: fewer than ``HOT_KEYS`` keys can be hot, so those are broadcast whatever the
    input.  The others are shuffled, and none of them can fill a task.  ``rows`` is read twice: pass a written table.
    """
    folded = folded.withColumnsRenamed({k: f"f_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in key]
    is_hot = F.col("n") * HOT_KEYS > n_rows
    hot, cold = folded.where(is_hot), folded.where(~is_hot)
    rest = rows.join(F.broadcast(hot.select(*[f"f_{k}" for k in key])), same, "left_anti")
    joined = rows.join(F.broadcast(hot), same).unionByName(rest.join(cold, same))
    return joined.drop(*[f"f_{k}" for k in key])
