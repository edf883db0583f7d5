"""Requests held against an engine's log: attribution by content within a window of lines, and its verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.operators.matching import in_windows
from adjudica.plans.gates import first_reason
from adjudica.registry import query
from adjudica.sources.tables import read

#: Lines of the log that requests of one stretch share, and by which their window is wider on either side.
STRETCH, SLACK = 500, 100

_LOG = """WITH e AS (SELECT event_id, event_type, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS state, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
q AS (SELECT state, k % 3 AS system, event_id // 500 AS stretch, count(*) AS cases, sum(CASE WHEN k % 7 = 0 THEN NULL ELSE 1 + k % 2 END) AS reads, count(*) FILTER (k % 7 = 0) AS unread FROM e WHERE event_type = 'view' GROUP BY ALL),
r AS (SELECT state, k % 3 AS system, event_id AS line FROM e WHERE event_type IN ('click', 'error')),
m AS (SELECT q.state, q.system, q.stretch, q.cases, q.reads, q.unread, count(r.line) AS same, count(r.line) FILTER (r.system = q.system) AS attributed
  FROM q LEFT JOIN r ON r.state = q.state AND r.line >= q.stretch * 500 - 100 AND r.line < (q.stretch + 1) * 500 + 100 GROUP BY ALL)
"""


@query(_LOG + """SELECT state, system, stretch, cases, same, attributed, same - attributed AS conflicts,
CASE WHEN attributed = 0 THEN CASE WHEN same > 0 THEN 'other system' ELSE 'none' END WHEN same > attributed THEN 'conflict' WHEN unread > 0 THEN 'not verifiable' WHEN attributed <> reads THEN 'count' ELSE 'ok' END AS verdict FROM m""")
def request_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against the log's records of the same state within their window of lines.

    Cases with the same state and system in a stretch share what is attributed to them, so their reads are added up.  A
    record of the same state with another system is a conflict; cases without a number of reads can't be verified.  Records
    are folded by state, system and line before they are joined, and a third of all rows has one state.
    """
    state = F.when(F.col("user_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id"))
    k = F.get_json_object("props", "$.k").cast("long")
    events = read(spark, sf_dir, "events").select("event_id", "event_type", state.alias("state"), k.alias("k"))
    stretch = F.floor(F.col("event_id") / STRETCH)
    asked = events.where("event_type = 'view'").groupBy("state", (F.col("k") % 3).alias("system"), stretch.alias("stretch"))
    asked = asked.agg(F.count("*").alias("cases"), F.sum(F.when(F.col("k") % 7 != 0, 1 + F.col("k") % 2)).alias("reads"), F.count_if(F.col("k") % 7 == 0).alias("unread"))
    asked = asked.withColumns({"since": F.col("stretch") * STRETCH - SLACK, "until": (F.col("stretch") + 1) * STRETCH + SLACK})
    log = events.where("event_type IN ('click', 'error')").groupBy("state", (F.col("k") % 3).alias("of_system"), F.col("event_id").alias("at")).agg(F.count("*").alias("n"))
    by = ["state", "system", "stretch"]
    met = in_windows(asked.select(*by, "since", "until"), log, "state", STRETCH + 2 * SLACK)
    met = met.groupBy(*by).agg(F.sum("n").alias("same"), F.sum(F.when(F.col("of_system") == F.col("system"), F.col("n")).otherwise(0)).alias("attributed"))
    rows = asked.join(met, by, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("same", "attributed")})
    same, attributed = F.col("same"), F.col("attributed")
    verdict = first_reason({"other system": (attributed == 0) & (same > 0), "none": attributed == 0, "conflict": same > attributed, "not verifiable": F.col("unread") > 0, "count": attributed != F.col("reads")}, "ok")
    return rows.select(*by, "cases", "same", "attributed", (same - attributed).alias("conflicts"), verdict.alias("verdict"))
