"""State and files: resumable runs, ledgers with snapshots, capped sources, split files, bucket files, attestations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.operators import attestation
from adjudica.operators.folding import own_folder
from adjudica.operators.state_table import StateTable
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.capped import CappedSource
from adjudica.sources.splits import read_split, write_buckets
from adjudica.sources.tables import VIEWS, read
from adjudica.streaming import resumable


@query(VIEWS + "SELECT run * 1000000000000 + case_id AS key, CAST(CASE WHEN err THEN 2 ELSE 1 END AS INTEGER) AS tries, CASE WHEN err AND case_id % 2 = 0 THEN 'transport' END AS error, CASE WHEN NOT (err AND case_id % 2 = 0) THEN ms END AS ms FROM v_records")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases of all runs as a stream of files, answered in batches with marks, and failed ones tried once more (odd cases
    then succeed)."""
    folder = own_folder(spark, "resumed-run")
    records = tables.records(spark, sf_dir).select((F.col("run") * F.lit(1_000_000_000_000) + F.col("case_id")).alias("key"), "case_id", "err", "ms")
    records.repartition(8).write.parquet(f"{folder}/universe")

    def answers(failing: str):
        error = F.when(F.expr(failing), "transport")
        return lambda rows: rows.select("key", error.alias("error"), F.when(error.isNull(), F.col("ms")).alias("ms"))

    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/universe")
    resumable.run_resumable(stream, answers("err"), folder, key="key")
    resumable.retry_errors(spark, spark.read.parquet(f"{folder}/universe"), answers("err AND case_id % 2 = 0"), folder, key="key")
    return resumable.results(spark, folder, "key")


@query(VIEWS + """, b AS (SELECT CAST(case_id % 3 AS BIGINT) AS batch, run, phase, sum(cost) AS spent, count(*) FILTER (cost IS NULL) AS unknown, min(case_id) AS first_case FROM v_records GROUP BY ALL)
SELECT CAST(s.snapshot AS BIGINT) AS snapshot, run, phase, round(max(spent), 9) AS spent, CAST(sum(unknown) AS BIGINT) AS unknown, min(first_case) AS first_case FROM b, (SELECT unnest([1, 2, 3]) AS snapshot) s WHERE batch < s.snapshot GROUP BY ALL""")
def ledger_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A durable ledger by run and phase that three sessions merge into: what is spent never falls, unknown costs add up, the
    first case stays; every snapshot stays readable."""
    ledger = StateTable(spark, own_folder(spark, "ledger"), ["run", "phase"], {"spent": "max", "unknown": "sum", "first_case": "min"}, parts=4)
    records = tables.records(spark, sf_dir)
    for batch in range(3):
        session = records.where(F.col("case_id") % 3 == batch).groupBy("run", "phase")
        ledger.merge(session.agg(F.sum("cost").alias("spent"), F.count_if(F.col("cost").isNull()).alias("unknown"), F.min("case_id").alias("first_case")))
    kept = [ledger.read(n).withColumn("snapshot", F.lit(n).cast("long")) for n in ledger.snapshots()]
    return reduce(DataFrame.unionByName, kept).withColumn("spent", F.round("spent", 9))


@query("SELECT doc_id, source, n_chars FROM documents")
def capped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a source that refuses answers of more than 500 rows: key ranges are halved until none is refused."""
    spark.dataSource.register(CappedSource)
    source = spark.read.format("capped").option("path", f"{sf_dir}/documents.parquet").option("key", "doc_id").option("cap", 500)
    return source.option("columns", "doc_id bigint, source string, n_chars bigint").load()


@query("""WITH d AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S'))
SELECT split || '-' || CASE WHEN n < 1000000 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END AS id, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS n FROM d)""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split files (some of several parts) read in the order of their names, with an id that runs on over the files of a split;
    blank texts take no number."""
    folder, docs = own_folder(spark, "splits"), read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    usable, found = F.coalesce("text", F.lit("")).rlike(r"\S"), []
    for split, rows in (("dev", docs.where("doc_id % 4 = 0")), ("train", docs.where("doc_id % 4 <> 0"))):
        rows.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{folder}/{split}")
        found.append(read_split(spark, f"{folder}/{split}", split, usable, span=64))
    return found[0].unionByName(found[1]).select("id", "doc_id", "lang")


_BUCKET = "CASE WHEN CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 THEN 'val' ELSE 'train' END AS split, source IN ('src1', 'src4') AS nc"


@query(f"""WITH b AS (SELECT lang, n_chars, {_BUCKET} FROM documents), k AS (SELECT * FROM b WHERE NOT (split = 'val' AND nc AND n_chars < 500))
SELECT split, nc, lang, count(*) AS n, round(max(count(*)) OVER (PARTITION BY split, nc) * CAST(1 AS DOUBLE) / sum(count(*)) OVER (PARTITION BY split, nc), 3) AS majority FROM k WHERE lang IS NOT NULL GROUP BY split, nc, lang""")
def bucket_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output a bucket (split and licence), of which one is written anew without its short texts; the distribution of
    each is read back from its own folder."""
    number = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.when(number % 10 == 0, "val").otherwise("train").alias("split"), F.col("source").isin("src1", "src4").alias("nc"))
    folder = own_folder(spark, "buckets")
    write_buckets(rows, folder, ["split", "nc"])
    write_buckets(rows.where("split = 'val' AND nc AND n_chars >= 500"), folder, ["split", "nc"])
    buckets = [(split, nc) for split in ("train", "val") for nc in (False, True)]
    files, found = spark.read.parquet(folder), []
    for split, nc in buckets:  # each reads its own folder only
        counts = files.where((F.col("split") == split) & (F.col("nc") == nc) & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"))
        whole = counts.agg(F.max("n").alias("most"), F.sum("n").alias("whole"))
        found.append(counts.join(F.broadcast(whole)).select(F.lit(split).alias("split"), F.lit(nc).alias("nc"), "lang", "n", F.round(F.col("most") / F.col("whole"), 3).alias("majority")))
    return reduce(DataFrame.unionByName, found)


@query("SELECT doc_id AS key, CASE WHEN doc_id % 991 = 7 THEN 'missing' WHEN doc_id % 983 = 11 THEN 'new' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 991 = 7 OR (doc_id % 983 = 11 AND doc_id % 991 <> 7) OR (doc_id % 997 = 5 AND doc_id % 991 <> 7)")
def attested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen table verified after some rows were changed, lost or added: only leaves whose digests differ are read."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text"))
    folder = own_folder(spark, "attested")
    attestation.freeze(docs.where("doc_id % 983 <> 11 OR doc_id % 991 = 7"), "doc_id", folder)
    now = docs.where("doc_id % 991 <> 7").withColumn("lang", F.when(F.col("doc_id") % 997 == 5, "xx").otherwise(F.col("lang")))
    return attestation.verify(now, "doc_id", folder)
