"""What the operators share: materialised tables in the cluster's shared folder, size-checked broadcasts, row keeping."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be broadcast: at about 40 bytes each this bounds a broadcast at some tens of MB.
BROADCAST_ROWS = 1_000_000
#: A key with more than one in so many rows is hot; fewer keys than this can be.
HOT_KEYS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where that is unset, a folder in the
    warehouse serves a local session; on a cluster that is an error, as the warehouse may be the driver's own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/adjudica-checkpoints"
    return folder.rstrip("/")


def tables_folder(spark: SparkSession) -> str:
    """Where this application's tables are."""
    return f"{shared_folder(spark)}/adjudica-tables/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes this application's tables, once no result that reads them is wanted any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again.

    This cuts the lineage with files that outlive any executor, and fixes what a non-deterministic expression
    (a row number given at the scan) has returned.
    """
    path = f"{tables_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.stored_at = path
    return written


def release(*tables: DataFrame) -> None:
    """Deletes tables that :func:`materialise` has returned and that no later step reads.  The shuffle files of finished jobs
    go once the driver's garbage is collected, so that is asked for too: an operator of many steps needs the disk of its
    largest, not of all."""
    spark = tables[0].sparkSession
    for table in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``limit`` rows (counted, unless given); else as it is, for a
    shuffled join.  Both plans return the same rows."""
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


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


def without_folded(rows: DataFrame, folded: DataFrame, key: Sequence[str], n_rows: int) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``folded``, which is as in :func:`join_folded`; rows of hot keys stay in place too."""
    folded = folded.select(*[F.col(k).alias(f"f_{k}") for k in key], "n")
    same = [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in key]
    is_hot = F.col("n") * HOT_KEYS > n_rows
    rest = rows.join(F.broadcast(folded.where(is_hot)), same, "left_anti")
    return rest.join(small(folded.where(~is_hot)), same, "left_anti")


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``: rows that no model may learn from.  A null id
    counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def letters(text: Column) -> Column:
    """True where the text holds a letter of any script; null counts as empty."""
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def keep_rows(docs: DataFrame, decisions: DataFrame, key: Sequence[str], made: Sequence[Column]) -> DataFrame:
    """``docs`` without the rows that ``decisions`` drops, and with repeated rows of one key kept once.

    ``decisions`` has a row for each ``key``, with ``kept`` (boolean) and ``n_rows`` (rows that share the key); ``made`` are
    the expressions over ``docs`` that give the key.  Columns of ``docs`` stay as they are, whatever their names: they
    travel inside one struct.  Keys compare null-safe.  Only the dropped and the repeated keys are joined, which are few;
    beyond a counted bound they are joined by a shuffle that hot keys take no part in.  Repeats fold in a grouped
    aggregate, which combines before it shuffles, so a row repeated a billion times does not meet in one task.
    """
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(k) for c, k in zip(made, key, strict=True)])
    decisions = decisions.withColumnRenamed("n_rows", "n")
    n_rows = decisions.agg(F.sum("n")).first()[0] or 0
    rows = without_folded(rows, decisions.where(~F.col("kept")), key, n_rows)
    repeated = decisions.where(F.col("kept") & (F.col("n") > 1)).select(*key, "n")
    if not repeated.limit(1).count():
        return rows.select("row.*")
    folded = join_folded(rows, repeated, key, n_rows).groupBy(*key).agg(F.min("row").alias("row"))
    return without_folded(rows, repeated, key, n_rows).select("row").unionByName(folded.select("row")).select("row.*")
