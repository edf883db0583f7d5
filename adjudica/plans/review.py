"""Raw scans with explicit ids, verdict tables by bands, hierarchical choices, universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import rounded
from adjudica.operators.verdicts import VERDICTS, banded, choose_down, within_universe
from adjudica.plans.decisions import decisions
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import OPTIONS, VIEWS, read

#: (metric, verdict, low, high, low_in, high_in): what a study expects, written down before it.
BANDS = (
    ("brier", VERDICTS[0], 0.33, None, True, True), ("brier", VERDICTS[1], 0.3, None, False, True),
    ("errors", VERDICTS[0], None, 10.0, True, True), ("errors", VERDICTS[1], None, 14.0, True, True),
    ("median_ms", VERDICTS[0], 400.0, 550.0, True, True), ("median_ms", VERDICTS[1], 300.0, 700.0, False, False),
    ("agreement", VERDICTS[0], 0.6, None, True, True), ("agreement", VERDICTS[1], 0.45, None, True, True),
    ("delta_hits", VERDICTS[0], -0.01, 0.01, False, False), ("delta_hits", VERDICTS[1], -0.05, 0.05, True, True),
)


def _listed(rows: tuple) -> str:
    said = lambda x: "NULL" if x is None else ("TRUE" if x else "FALSE") if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)"
    return ", ".join("(" + ", ".join(said(x) for x in r) + ")" for r in rows)


@query(VIEWS + f""", bands(metric, verdict, low, high, low_in, high_in) AS (VALUES {_listed(BANDS)}),
pair AS (SELECT r.run, avg(CASE WHEN a.label = b.label THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS agreement FROM (SELECT unnest([0, 1, 2]) AS run) r JOIN v_choice a ON a.run = 0 AND NOT a.err JOIN v_choice b ON b.run = r.run AND b.case_id = a.case_id AND NOT b.err GROUP BY r.run),
hits AS (SELECT run, avg(CASE WHEN label = gt THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS h FROM v_choice WHERE NOT err GROUP BY run),
m AS (SELECT run, 'brier' AS metric, avg((value - gt) * (value - gt)) AS value FROM v_binary WHERE NOT err AND qid = 'quality' GROUP BY run UNION ALL SELECT run, 'errors', CAST(count(*) FILTER (err) AS DOUBLE) FROM v_records GROUP BY run
UNION ALL SELECT run, 'median_ms', CAST(median(ms) AS DOUBLE) FROM v_records WHERE NOT err GROUP BY run UNION ALL SELECT run, 'agreement', agreement FROM pair WHERE run > 0 UNION ALL SELECT a.run, 'delta_hits', a.h - b.h FROM hits a JOIN hits b ON b.run = 0),
cells AS (SELECT run, metric FROM (SELECT unnest([0, 1, 2, 3]) AS run), (SELECT DISTINCT metric FROM bands)),
x AS (SELECT cells.run, cells.metric, value FROM cells LEFT JOIN m USING (run, metric)),
k AS (SELECT run, x.metric, value, min(CASE WHEN (low IS NULL OR value > low OR (low_in AND value = low)) AND (high IS NULL OR value < high OR (high_in AND value = high)) THEN CASE verdict WHEN 'CONFIRMADA' THEN 1 ELSE 2 END END) AS rank FROM x JOIN bands USING (metric) GROUP BY ALL)
SELECT run AS cell, metric, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'NO EVALUABLE' WHEN rank = 1 THEN 'CONFIRMADA' WHEN rank = 2 THEN 'INCONCLUSA' ELSE 'REFUTADA' END AS verdict FROM k""")
def verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics of each run by the study's bands; a run that was planned and never made (3) can't be judged."""
    bands = spark.createDataFrame(BANDS, "metric string, verdict string, low double, high double, low_in boolean, high_in boolean")
    records, made = tables.records(spark, sf_dir), decisions(spark, sf_dir).where("NOT err AND qid = 'language'").select("run", "case_id", "label", "gt")
    yes = tables.binary(spark, sf_dir).where("NOT err AND qid = 'quality'")
    first = made.where("run = 0").select("case_id", F.col("label").alias("first"))
    hits = made.groupBy("run").agg(F.avg((F.col("label") == F.col("gt")).cast("double")).alias("h"))
    metric = lambda df, name, value: df.select(F.col("run").alias("cell"), F.lit(name).alias("metric"), value.cast("double").alias("value"))
    metrics = metric(yes.groupBy("run").agg(F.avg((F.col("value") - F.col("gt")) ** 2).alias("x")), "brier", F.col("x"))
    metrics = metrics.unionByName(metric(records.groupBy("run").agg(F.count_if("err").alias("x")), "errors", F.col("x")))
    metrics = metrics.unionByName(metric(records.where("NOT err").groupBy("run").agg(F.percentile("ms", 0.5).alias("x")), "median_ms", F.col("x")))
    agree = made.where("run > 0").join(first, "case_id").groupBy("run").agg(F.avg((F.col("label") == F.col("first")).cast("double")).alias("x"))
    metrics = metrics.unionByName(metric(agree, "agreement", F.col("x")))
    base = hits.where("run = 0").select(F.col("h").alias("h0"))
    metrics = metrics.unionByName(metric(hits.join(F.broadcast(base)), "delta_hits", F.col("h") - F.col("h0")))
    cells = bands.select("metric").distinct().select(F.explode(F.array(*[F.lit(r) for r in (0, 1, 2, 3)])).alias("cell"), "metric")
    return banded(cells, metrics, bands).withColumn("value", rounded(F.col("value")))


_ATTEMPTS = VIEWS + """, v AS (SELECT run, case_id, err, ord, opt, CASE WHEN case_id % 19 = 0 THEN CAST(0 AS DOUBLE) WHEN case_id % 23 = 0 THEN CAST(0.25 AS DOUBLE) WHEN case_id % 31 = 2 THEN p * 4 ELSE p END AS p FROM v_probs WHERE NOT (case_id % 37 = 3 AND ord = 2)),
s AS (SELECT run, case_id, err, CASE WHEN count(*) < 4 OR max(p) > 1 THEN 'invalid' WHEN max(p) = 0 THEN 'zero' WHEN max(p) - min(p) < CAST(0.05 AS DOUBLE) THEN 'uniform' ELSE 'ok' END AS kind FROM v GROUP BY run, case_id, err)
"""


@query(_ATTEMPTS + """SELECT run, 'no record' AS kind, CAST(case_id AS VARCHAR) AS tag FROM s WHERE err UNION ALL SELECT run, 'no raw', CAST(case_id AS VARCHAR) FROM s WHERE NOT err AND case_id % 13 = 5
UNION ALL SELECT run, 'unparsed', CAST(case_id AS VARCHAR) || '#1' FROM s WHERE NOT err AND case_id % 13 <> 5 AND case_id % 3 = 0 UNION ALL SELECT run, kind, CAST(case_id AS VARCHAR) || '.language' FROM s WHERE NOT err AND case_id % 13 <> 5 AND kind <> 'ok'
UNION ALL SELECT run, 'ok', CAST(count(*) AS VARCHAR) FROM s WHERE NOT err AND case_id % 13 <> 5 AND kind = 'ok' GROUP BY run UNION ALL SELECT run, 'attempts', CAST(sum(CASE WHEN case_id % 3 = 0 THEN 2 ELSE 1 END) AS VARCHAR) FROM s WHERE NOT err AND case_id % 13 <> 5 GROUP BY run""")
def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored texts of all attempts hold before anything is normalised: each vector that is null, near uniform or
    against the contract by its id, each attempt that can't be read by its number, each case without text or record, and
    the counts of what is right.  Every id is a row, so a list may be as long as it must."""
    by, case = ["run", "case_id", "err"], F.col("case_id")
    p = F.when(case % 19 == 0, 0.0).when(case % 23 == 0, 0.25).when(case % 31 == 2, F.col("p") * 4).otherwise(F.col("p"))
    entries = F.sort_array(F.collect_list(F.when(~((case % 37 == 3) & (F.col("ord") == 2)), F.struct("ord", F.col("opt").alias("o"), p.alias("p")))))
    answers = tables.options(spark, sf_dir).groupBy(*by).agg(entries.alias("e"))
    body = F.to_json(F.struct(F.map_from_entries(F.transform("e", lambda x: F.struct(x["o"], x["p"]))).alias("language")))
    raw = F.when(case % 13 != 5, F.array_compact(F.array(F.when(case % 3 == 0, F.lit('{"language": {')), F.concat(F.lit("```json\n"), body, F.lit("\n```")))))
    stored = answers.select(*by, raw.alias("raw"))
    tagged = lambda df, kind, tag: df.select("run", F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), tag.alias("tag"))
    out = tagged(stored.where("err"), "no record", case.cast("string"))
    good = stored.where("NOT err")
    out = out.unionByName(tagged(good.where("raw IS NULL"), "no raw", case.cast("string")))
    attempts = good.where("raw IS NOT NULL").select("run", "case_id", F.posexplode("raw").alias("k", "text"))
    bare = F.regexp_replace("text", r"(?s)\A\s*```[a-z]*\n?|\n?```\s*\z", "")
    read_out = attempts.withColumn("said", F.from_json(bare, "language map<string,double>")["language"])
    out = out.unionByName(tagged(read_out.where("said IS NULL"), "unparsed", F.concat(case.cast("string"), F.lit("#"), (F.col("k") + 1).cast("string"))))
    values = F.map_values("said")
    odd = (F.sort_array(F.map_keys("said")) != F.sort_array(F.array(*[F.lit(o) for o in OPTIONS]))) | F.exists(values, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    kind = F.when(odd, "invalid").when(F.forall(values, lambda x: x == 0), "zero").when(F.array_max(values) - F.array_min(values) < 0.05, "uniform").otherwise("ok")
    judged = read_out.where("said IS NOT NULL").withColumn("kind", kind)
    out = out.unionByName(tagged(judged.where("kind <> 'ok'"), F.col("kind"), F.concat(case.cast("string"), F.lit(".language"))))
    out = out.unionByName(tagged(judged.where("kind = 'ok'").groupBy("run").agg(F.count("*").alias("n")), "ok", F.col("n").cast("string")))
    return out.unionByName(tagged(attempts.groupBy("run").agg(F.count("*").alias("n")), "attempts", F.col("n").cast("string")))


_TREE = """t AS (SELECT 1 AS level, '' AS parent, r_name AS label, r_regionkey AS place FROM region UNION ALL SELECT 2, r_name, n_name, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 3, n_name, n_name || '.' || CAST(j AS VARCHAR), j FROM nation, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE n_nationkey % 5 <> 2 AND j <= n_nationkey % 4)"""
_W = "1 + (doc_id * (3 + 2 * level) + place * 7) % 11"


@query(f"""WITH {_TREE}, o1 AS (SELECT doc_id, level, label, {_W} AS w, place FROM documents, t WHERE level = 1), c1 AS (SELECT doc_id, level, label, w / sum(w) OVER (PARTITION BY doc_id) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, place) AS rn FROM o1),
o2 AS (SELECT d.doc_id, t.level, t.label, {_W.replace("doc_id", "d.doc_id").replace("level", "t.level").replace("place", "t.place")} AS w, place FROM c1 d JOIN t ON t.level = 2 AND t.parent = d.label WHERE d.rn = 1), c2 AS (SELECT doc_id, level, label, w / sum(w) OVER (PARTITION BY doc_id) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, place) AS rn FROM o2),
o3 AS (SELECT d.doc_id, t.level, t.label, {_W.replace("doc_id", "d.doc_id").replace("level", "t.level").replace("place", "t.place")} AS w, place FROM c2 d JOIN t ON t.level = 3 AND t.parent = d.label WHERE d.rn = 1), c3 AS (SELECT doc_id, level, label, w / sum(w) OVER (PARTITION BY doc_id) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, place) AS rn FROM o3)
SELECT doc_id, level, label, round(p, 6) AS p FROM c1 WHERE rn = 1 UNION ALL SELECT doc_id, level, label, round(p, 6) FROM c2 WHERE rn = 1 UNION ALL SELECT doc_id, level, label, round(p, 6) FROM c3 WHERE rn = 1""")
def hierarchical_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region, a nation of it and one of the nation's codes for each document; some nations have no codes."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    both = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    code = F.explode(F.sequence(F.lit(0), (F.col("n_nationkey") % 4).cast("int"))).alias("place")
    codes = nation.where("n_nationkey % 5 <> 2").select("n_name", code)
    level = lambda k, df, parent, label, place: df.select(F.lit(k).alias("level"), parent.alias("parent"), label.alias("label"), place.cast("long").alias("place"))
    tree = level(1, region, F.lit(""), F.col("r_name"), F.col("r_regionkey")).unionByName(level(2, both, F.col("r_name"), F.col("n_name"), F.col("n_nationkey")))
    tree = tree.unionByName(level(3, codes, F.col("n_name"), F.concat("n_name", F.lit("."), F.col("place").cast("string")), F.col("place")))
    weight = 1 + (F.col("doc_id") * (3 + 2 * F.col("level")) + F.col("place") * 7) % 11
    return choose_down(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], tree, weight, 3).withColumn("p", rounded(F.col("p")))


@query(VIEWS + "SELECT run, count(*) AS n, CAST(sum(CASE WHEN err THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM v_records WHERE case_id % 17 <> 4 GROUP BY run")
def universe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the current universe: retired cases (one in 17) are left out, and any other unknown id would be an error."""
    cases = tables.cases(spark, sf_dir).select("case_id")
    retired = cases.where("case_id % 17 = 4")
    kept = within_universe(tables.records(spark, sf_dir), cases.where("case_id % 17 <> 4"), retired, "case_id")
    return kept.groupBy("run").agg(F.count("*").alias("n"), F.count_if("err").alias("errors"))
