"""Checks in full: answer contracts, error classes, work queues, token tolerances, cell audits, fact banks, canaries."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.operators.folding import staged
from adjudica.plans.gates import first_reason
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import OPTIONS, VIEWS, read

#: Raw answers as they might arrive: of another type, with a strange label, a missing one, a number out of range or not finite.
_RAW = VIEWS + """, raw AS (SELECT run, case_id, CASE WHEN case_id % 41 = 0 THEN 'score' ELSE 'choice' END AS type, CASE WHEN case_id % 43 = 0 AND ord = 3 THEN 'xx' ELSE opt END AS opt, ord,
 CASE WHEN case_id % 29 = 1 AND ord = 3 THEN NULL WHEN case_id % 37 = 2 AND ord = 0 THEN CAST('NaN' AS DOUBLE) WHEN case_id % 31 = 2 THEN p * 1.5 WHEN case_id % 53 = 4 AND ord = 1 THEN -p ELSE p END AS p FROM v_probs),
v AS (SELECT run, case_id, min(type) AS type, count(p) AS n, count(*) FILTER (isnan(p) OR isinf(p)) AS odd, count(*) FILTER (NOT isnan(p) AND (p < 0 OR p > 1)) AS outside, count(*) FILTER (opt NOT IN ('en', 'de', 'fr', 'es')) AS strange, sum(p) AS s, sum(p * ord) AS e FROM raw GROUP BY run, case_id)
"""


@query(_RAW + "SELECT run, CASE WHEN type <> 'choice' THEN 'type' WHEN strange > 0 THEN 'labels' WHEN n < 4 THEN 'options' WHEN odd > 0 THEN 'not finite' WHEN outside > 0 THEN 'range' WHEN s < CAST(0.99 AS DOUBLE) OR s > CAST(1.01 AS DOUBLE) THEN 'sum' WHEN e < 0 OR e > 3 THEN 'expectation' ELSE 'ok' END AS problem, count(*) AS n FROM v GROUP BY ALL")
def answer_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first breach of each raw answer: type, labels, coverage of the options, finite numbers, range, sum, expectation."""
    case, ord_, p = F.col("case_id"), F.col("ord"), F.col("p")
    raw = F.when((case % 29 == 1) & (ord_ == 3), F.lit(None)).when((case % 37 == 2) & (ord_ == 0), F.lit(float("nan"))).when(case % 31 == 2, p * 1.5).when((case % 53 == 4) & (ord_ == 1), -p).otherwise(p)
    rows = tables.options(spark, sf_dir).select("run", "case_id", "ord", F.when((case % 43 == 0) & (ord_ == 3), "xx").otherwise(F.col("opt")).alias("opt"), F.when(case % 41 == 0, "score").otherwise("choice").alias("type"), raw.alias("p"))
    infinite = F.abs(p) == F.lit(float("inf"))
    odd, outside = F.isnan(p) | infinite, ~F.isnan(p) & ((p < 0) | (p > 1))
    v = rows.groupBy("run", "case_id").agg(F.min("type").alias("type"), F.count("p").alias("k"), F.count_if(odd).alias("odd"), F.count_if(outside).alias("outside"), F.count_if(~F.col("opt").isin(*OPTIONS)).alias("strange"), F.sum("p").alias("s"), F.sum(p * ord_).alias("e"))
    breaches = {"type": F.col("type") != "choice", "labels": F.col("strange") > 0, "options": F.col("k") < len(OPTIONS), "not finite": F.col("odd") > 0, "range": F.col("outside") > 0, "sum": ~F.col("s").between(0.99, 1.01), "expectation": ~F.col("e").between(0, len(OPTIONS) - 1)}
    return v.groupBy("run", first_reason(breaches, "ok").alias("problem")).agg(F.count("*").alias("n"))


#: What an error's lower-cased text says, in the order in which the classes are tried.
REFUSAL_STATUS, REFUSAL = "502", "refused to answer"
SIGNS = {
    "timeout": ("timeout", "timed out"),
    "local": ("malform", "valid", "schema", "parse", "local"),
    "transport": ("connection", "network", "refused", "econn"),
}


def error_class(there: Column, error: Column) -> Column:
    """The class of a record's error (a JSON value as text; null: none), by the first rule that holds.

    No record is ``missing``, no error has no class, and an error that isn't a text is ``other``.  A text with an HTTP status is a
    ``rejection`` if that is 502 and the text says that an answer was refused, else ``transport``, whatever else it says;
    texts without a status go by their words.
    """
    text = F.lower(error)
    status = F.regexp_extract(text, r"http error (\d+)", 1)
    says = lambda signs: reduce(Column.__or__, [text.contains(x) for x in signs])
    rules = {
        "missing": ~there,
        None: error.isNull(),
        "other": ~error.startswith('"'),
        "rejection": (status == REFUSAL_STATUS) & text.contains(REFUSAL),
        "transport": status != "",
    }
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, holds in [*rules.items(), *[(name, says(signs)) for name, signs in SIGNS.items()]]:
        found = found.when(holds, F.lit(name))
    return found.otherwise("other")


_ERRORS = ('"HTTP Error 502: refused to answer"', '"HTTP Error 502: bad gateway"', '"HTTP Error 400: schema"', '"HTTP Error 504: timed out"', '"Request timed out"', '"Connection refused"', '"schema mismatch: invalid JSON"', '"ECONNRESET"', '"network is down, read timeout"', '{"code": 7}', '"strange"', None)


@query(VIEWS + ", e AS (SELECT run, case_id % 23 <> 3 AS there, CASE " + " ".join(f"WHEN case_id % 12 = {k} THEN '{m}'" for k, m in enumerate(_ERRORS) if m) + """ END AS m FROM v_records), s AS (SELECT *, lower(m) AS t, regexp_extract(lower(m), 'http error ([0-9]+)', 1) AS c FROM e)
SELECT run, CASE WHEN NOT there THEN 'missing' WHEN m IS NULL THEN NULL WHEN NOT starts_with(m, '"') THEN 'other' WHEN c = '502' AND contains(t, 'refused to answer') THEN 'rejection' WHEN c <> '' THEN 'transport' WHEN contains(t, 'timeout') OR contains(t, 'timed out') THEN 'timeout'
WHEN contains(t, 'malform') OR contains(t, 'valid') OR contains(t, 'schema') OR contains(t, 'parse') OR contains(t, 'local') THEN 'local' WHEN contains(t, 'connection') OR contains(t, 'network') OR contains(t, 'refused') OR contains(t, 'econn') THEN 'transport' ELSE 'other' END AS kind, count(*) AS n FROM s GROUP BY ALL""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("case_id") % len(_ERRORS)
    error = reduce(lambda c, x: c.when(k == x[0], F.lit(x[1])), enumerate(_ERRORS), F.when(F.lit(False), F.lit(None).cast("string")))
    return tables.records(spark, sf_dir).groupBy("run", error_class(F.col("case_id") % 23 != 3, error).alias("kind")).agg(F.count("*").alias("n"))


def queue(universe: DataFrame, records: DataFrame, key: str, *, retry: bool, most: int) -> DataFrame:
    """The first ``most`` keys of ``universe`` (key) that are to be done: those without a record, and with ``retry`` those
    whose record (key, err) is an error.  A top-k keeps ``most`` rows a task."""
    done = records.where(~F.col("err")) if retry else records
    return universe.join(done.select(key).distinct(), key, "left_anti").orderBy(key).limit(most)


@query(VIEWS + ", r AS (SELECT case_id, err FROM v_records WHERE run = 0 AND case_id % 4 <> 1) SELECT case_id, TRUE AS retry FROM (SELECT case_id FROM v_cases WHERE case_id NOT IN (SELECT case_id FROM r WHERE NOT err) ORDER BY case_id LIMIT 25) UNION ALL SELECT case_id, FALSE FROM (SELECT case_id FROM v_cases WHERE case_id NOT IN (SELECT case_id FROM r) ORDER BY case_id LIMIT 25)")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 25 cases, with failed ones to be tried again and without (here every fourth case has no record)."""
    cases, made = tables.cases(spark, sf_dir).select("case_id"), tables.records(spark, sf_dir).where("run = 0 AND case_id % 4 <> 1")
    return queue(cases, made, "case_id", retry=True, most=25).withColumn("retry", F.lit(True)).unionByName(queue(cases, made, "case_id", retry=False, most=25).withColumn("retry", F.lit(False)))


@query(VIEWS + """, t AS (SELECT run, case_id, CASE WHEN case_id % 17 = 0 THEN NULL ELSE ms + CASE run WHEN 1 THEN 7 WHEN 2 THEN 100 ELSE 1 END + case_id % 3 END AS used, ms AS ref FROM v_records)
SELECT run, CASE WHEN used IS NULL THEN 'no usage' WHEN abs(used - ref - CASE WHEN run = 2 THEN 100 ELSE 0 END) <= CASE WHEN run = 1 THEN 10 ELSE 2 END THEN 'ok' ELSE 'violation' END AS rule, count(*) AS n FROM t GROUP BY ALL""")
def token_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of tokens against a reference: within 2, within 10 for a run of another tokenizer (here 1), or after an offset (2)."""
    rules = spark.createDataFrame([(0, 2, 0), (1, 10, 0), (2, 2, 100)], "run int, slack int, shift int")
    run, case = F.col("run"), F.col("case_id")
    used = F.when(case % 17 != 0, F.col("ms") + F.when(run == 1, 7).when(run == 2, 100).otherwise(1) + case % 3)
    rows = tables.records(spark, sf_dir).withColumn("used", used).join(F.broadcast(rules), "run")
    rule = F.when(F.col("used").isNull(), "no usage").when(F.abs(F.col("used") - F.col("ms") - F.col("shift")) <= F.col("slack"), "ok").otherwise("violation")
    return rows.groupBy("run", rule.alias("rule")).agg(F.count("*").alias("n"))


_NOTES = ("tokens", "client", "missing", "gate", "manifest", "usage", "status")


@query(VIEWS + """, c AS (SELECT run, phase, count(*) FILTER (ms > 997) AS tokens, count(*) FILTER (case_id % 1009 = 7) AS client, count(*) FILTER (case_id % 211 = 9 AND run = 1) AS missing, count(*) FILTER (cost > CAST(0.0000485 AS DOUBLE) AND run = 2) AS gate, count(*) FILTER (run = 0 AND phase = 'fr') AS manifest, count(*) FILTER (cost IS NULL) AS unknown, count(*) FILTER (err) AS errors, count(*) AS n FROM v_records GROUP BY run, phase)
SELECT run, phase, CASE WHEN tokens > 0 THEN 'tokens' WHEN client > 0 THEN 'client' WHEN missing > 0 THEN 'missing' WHEN gate > 0 THEN 'gate' WHEN manifest > 0 THEN 'manifest' WHEN unknown * 6 > n THEN 'usage' WHEN errors * 30 > n THEN 'status' ELSE 'evaluable' END AS note FROM c""")
def cell_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of seven gates, in their order of precedence, that masks a cell's verdict: tokens, client, missing records,
    acquisition gate, manifest, share of known usage, status."""
    run, case, cost = F.col("run"), F.col("case_id"), F.col("cost")
    holds = {"tokens": F.col("ms") > 997, "client": case % 1009 == 7, "missing": (case % 211 == 9) & (run == 1), "gate": (cost > 0.0000485) & (run == 2), "manifest": (run == 0) & (F.col("phase") == "fr"), "unknown": cost.isNull(), "errors": F.col("err")}
    cells = tables.records(spark, sf_dir).groupBy("run", "phase").agg(*[F.count_if(x).alias(name) for name, x in holds.items()], F.count("*").alias("n"))
    shares = {"usage": F.col("unknown") * 6 > F.col("n"), "status": F.col("errors") * 30 > F.col("n")}
    return cells.select("run", "phase", first_reason({name: shares.get(name, F.col(name) > 0 if name in holds else F.lit(False)) for name in _NOTES}, "evaluable").alias("note"))


@query("WITH k AS (SELECT doc_id % 2111 AS key, source, lang FROM documents) SELECT source, lang = 'en' AS restricted, count(*) AS n_in, CAST(sum(CASE WHEN key IN (SELECT key FROM k GROUP BY key HAVING count(DISTINCT source) > 1) THEN 0 ELSE 1 END) AS BIGINT) AS n_out FROM k GROUP BY ALL")
def clean_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each bucket before and after every occurrence of a key that several buckets have is dropped."""
    from adjudica.operators.curation import in_several_buckets

    rows = read(spark, sf_dir, "documents").select((F.col("doc_id") % 2111).alias("key"), "source", "lang")
    several = in_several_buckets(rows, "key", "source").withColumn("twice", F.lit(True))
    return rows.join(several, "key", "left").groupBy("source", (F.col("lang") == "en").alias("restricted")).agg(F.count("*").alias("n_in"), F.count_if(F.col("twice").isNull()).alias("n_out"))


_FACTS = """WITH f AS (SELECT CASE WHEN doc_id % 40 = 7 THEN 7 ELSE doc_id END AS id, doc_id % 20 AS grp, CASE WHEN doc_id % 61 = 5 THEN 2 ELSE quality END AS label, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'x+' END AS evidence, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 47 = 1 THEN '(' ELSE 'y' END AS trap, doc_id % 71 <> 11 AS included FROM labels),
c AS (SELECT DISTINCT doc_id % 23 AS grp FROM labels)
"""


@query(_FACTS + """SELECT 'repeated id' AS problem, count(*) AS n FROM (SELECT id FROM f GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'label', count(*) FROM f WHERE label NOT IN (0, 1) UNION ALL SELECT 'true without evidence', count(*) FROM f WHERE label = 1 AND evidence = ''
UNION ALL SELECT 'false without trap or evidence', count(*) FROM f WHERE label = 0 AND evidence = '' AND trap = '' UNION ALL SELECT 'pattern', count(*) FROM f WHERE trap = '(' UNION ALL SELECT 'reference', count(*) FROM f WHERE NOT included UNION ALL SELECT 'case without facts', count(*) FROM c WHERE grp NOT IN (SELECT grp FROM f)""")
def fact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of the seven rules of a fact bank, by kind; patterns are compiled in the tasks that read them."""
    doc = F.col("doc_id")
    facts = read(spark, sf_dir, "labels").select(F.when(doc % 40 == 7, F.lit(7).cast("long")).otherwise(doc).alias("id"), (doc % 20).alias("grp"), F.when(doc % 61 == 5, 2).otherwise(F.col("quality")).alias("label"), F.when(doc % 5 == 0, "").otherwise("x+").alias("evidence"), F.when(doc % 3 == 0, "").when(doc % 47 == 1, "(").otherwise("y").alias("trap"), (doc % 71 != 11).alias("included"), (doc % 23).alias("case"))
    label, evidence, trap = F.col("label"), F.col("evidence"), F.col("trap")
    counts = facts.agg(F.count_if(~label.isin(0, 1)).alias("label"), F.count_if((label == 1) & (evidence == "")).alias("true without evidence"), F.count_if((label == 0) & (evidence == "") & (trap == "")).alias("false without trap or evidence"), F.count_if(~_compiles(trap)).alias("pattern"), F.count_if(~F.col("included")).alias("reference"))
    rows = counts.unpivot([], counts.columns, "problem", "n")
    repeated = facts.groupBy("id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))
    empty = facts.select(F.col("case").alias("grp")).distinct().join(facts.select("grp").distinct(), "grp", "left_anti").agg(F.count("*").alias("n"))
    named = lambda df, name: df.select(F.lit(name).alias("problem"), "n")
    return rows.unionByName(named(repeated, "repeated id")).unionByName(named(empty, "case without facts"))


@F.pandas_udf(T.BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    """Whether each text is a regular expression of Python's ``re``; one that repeats in a batch is tried once."""

    def tried(pattern: str) -> bool:
        try:
            re.compile(pattern)
        except re.error:
            return False
        return True

    known = {p: tried(p) for p in patterns.dropna().unique()}
    return patterns.map(known)


@query("""WITH h AS (SELECT doc_id, source, CAST(regexp_matches(text, 'Licensed') AS INT) AS a, CAST(regexp_matches(text, 'example') AS INT) AS b, regexp_matches(lower(text), 'ignore (all|previous)') AS injected FROM documents)
SELECT source, CASE WHEN bool_or(injected) THEN 'injection' WHEN sum(a) > 0 AND sum(b) > 0 THEN 've' WHEN sum(a) + sum(b) = 0 THEN 'no ve' ELSE 'parcial' END AS verdict, CAST(sum(a) AS BIGINT) AS first_hits, CAST(sum(b) AS BIGINT) AS second_hits FROM h GROUP BY source""")
def canary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of two planted marks over the texts of a source: both seen, none, one, or an injected instruction."""
    text = F.col("text")
    hits = read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(text.contains("Licensed")).alias("first_hits"), F.count_if(text.contains("example")).alias("second_hits"), F.bool_or(F.lower(text).rlike("ignore (all|previous)")).alias("injected"))
    a, b = F.col("first_hits") > 0, F.col("second_hits") > 0
    verdict = first_reason({"injection": F.col("injected"), "ve": a & b, "no ve": ~a & ~b}, "parcial")
    return hits.select("source", verdict.alias("verdict"), "first_hits", "second_hits")


def resume(universe: DataFrame, sink: str, key: str, work, *, most: int) -> int:
    """Does the next ``most`` keys of ``universe`` that ``sink`` (a Parquet folder) doesn't have, by ``work`` (a function of their
    rows that returns a DataFrame with ``key``), and appends what it made.  Returns the number of rows appended.

    An interrupted call appends nothing, as Spark commits a write as a whole; calling again goes on where the sink ends.
    """
    spark = universe.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    left = universe.join(spark.read.parquet(sink).select(key), key, "left_anti") if exists else universe
    made = staged(work(left.orderBy(key).limit(most)), "resume")
    n = made.count()
    if n:
        made.write.mode("append").parquet(sink)
    return n
