"""Incremental operators: resumable work, retry marks, monotone ledgers, amendment chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.operators.folding import staged
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import VIEWS, read


@query(VIEWS + "SELECT case_id, err AND case_id % 2 = 0 AS retry FROM v_records WHERE run = 0 AND err")
def retry_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed cases, and whether they may be tried again: only those without a mark (here odd ids have one)."""
    failed = tables.records(spark, sf_dir).where("run = 0 AND err").select("case_id")
    marks = tables.cases(spark, sf_dir).where("case_id % 2 = 1").select("case_id", F.lit(True).alias("retried"))
    return failed.join(marks, "case_id", "left").select("case_id", (~F.coalesce("retried", F.lit(False))).alias("retry"))


@query(VIEWS + ", l AS (SELECT run, phase, sum(cost) AS spent FROM v_records GROUP BY ALL) SELECT run, round(sum(greatest(spent, CASE WHEN phase = 'en' THEN CAST(0.006 AS DOUBLE) ELSE CAST(0.0005 AS DOUBLE) END)), 9) AS ledger FROM l GROUP BY run")
def monotone_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger never falls: the greater of what records say and what was written before."""
    before = F.when(F.col("phase") == "en", 0.006).otherwise(0.0005)
    spent = tables.records(spark, sf_dir).groupBy("run", "phase").agg(F.sum("cost").alias("spent"))
    return spent.groupBy("run").agg(F.round(F.sum(F.greatest("spent", before)), 9).alias("ledger"))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS old, doc_id + 10 AS new FROM documents WHERE doc_id % 10 = 3 AND doc_id % 50 <> 43), c(start, last, hops) AS (
SELECT old, new, CAST(1 AS BIGINT) FROM e UNION ALL SELECT c.start, e.new, c.hops + 1 FROM c JOIN e ON c.last = e.old) SELECT start, max(last) AS last, max(hops) AS hops FROM c GROUP BY start""")
def amendment_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each chain of amendments old -> new."""
    edges = read(spark, sf_dir, "documents").where("doc_id % 10 = 3 AND doc_id % 50 <> 43")
    return chain_ends(edges.select(F.col("doc_id").alias("start"), (F.col("doc_id") + 10).alias("last")))


def chain_ends(edges: DataFrame) -> DataFrame:
    """(start, last, hops) of chains of distinct ``start`` -> ``last`` without a cycle, by pointer doubling until no pointer moves.

    A round is a join, written to the shared folder; rounds are logarithmic in the longest chain, whatever its length.
    """
    found, moved = staged(edges.withColumn("hops", F.lit(1).cast("long")), "chain"), 1
    while moved:
        onward = found.select(F.col("start").alias("last"), F.col("last").alias("then"), F.col("hops").alias("more"))
        joined = found.join(onward, "last", "left").select("start", F.coalesce("then", "last").alias("last"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("then").isNotNull().alias("moved"))
        joined = staged(joined, "chain")
        moved, found = joined.where("moved").limit(1).count(), joined.drop("moved")
    return found


@query("WITH p AS (SELECT unnest([0, 1, 2, 3]) AS part), d AS (SELECT user_id % 4 AS part, count(*) AS n, sum(value) AS total FROM events WHERE event_id % 10 < 7 GROUP BY 1), t AS (SELECT user_id % 4 AS part, count(*) AS n, sum(value) AS total FROM events WHERE event_id % 10 >= 7 GROUP BY 1) SELECT CAST(part AS BIGINT) AS part, CAST(coalesce(d.n, 0) + coalesce(t.n, 0) AS BIGINT) AS n, round(coalesce(d.total, 0) + coalesce(t.total, 0), 4) AS total FROM p LEFT JOIN d USING (part) LEFT JOIN t USING (part)")
def resumed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done before (seven of ten events) and the rest, added without counting anything twice."""
    events = read(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 4)
    done = events.where("event_id % 10 < 7")
    rest = events.join(done.select("event_id"), "event_id", "left_anti")
    both = done.select("part", "value").unionByName(rest.select("part", "value"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of ``streaming.totals.hourly``."""
    from adjudica.streaming.totals import hourly

    return hourly(read(spark, sf_dir, "events")).select("event_type", "hour", "n", F.round("total", 4).alias("total"))
