"""Audits of runs: coverage, contracts, order effects, errors, cost, versions, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import rounded
from adjudica.plans.decisions import choices
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.files import running_sums
from adjudica.sources.tables import OPTIONS, VIEWS

#: Cap on the cost of a run's first records.
CAP = 0.002


@query(VIEWS + "SELECT run, coalesce(phase, 'all') AS phase, CAST(sum(CASE WHEN err THEN 0 ELSE 1 END) AS BIGINT) AS ok, count(*) AS n, sum(CASE WHEN err THEN 1 ELSE 0 END) = 0 AS complete FROM v_records GROUP BY GROUPING SETS ((run, phase), (run))")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = tables.records(spark, sf_dir).rollup("run", "phase").agg(F.count_if(~F.col("err")).alias("ok"), F.count("*").alias("n"))
    return rolled.where("run IS NOT NULL").select("run", F.coalesce("phase", F.lit("all")).alias("phase"), "ok", "n", (F.col("ok") == F.col("n")).alias("complete"))


_ERROR = "CASE WHEN NOT err THEN NULL WHEN case_id % 5 = 0 THEN NULL WHEN case_id % 5 = 1 THEN 'HTTP error 429: slow down' WHEN case_id % 5 = 2 THEN 'HTTP error 503' WHEN case_id % 5 = 3 THEN 'timed out' ELSE 'refused by policy' END"


def error_kind(message):
    """First rule that holds: no message, rate limit, server error, timeout, rejection, other."""
    text = F.lower(message)
    status = F.regexp_extract(text, r"http error (\d+)", 1)
    return F.when(message.isNull(), "missing").when(status == "429", "rate").when(status.startswith("5"), "server").when(text.contains("timed out"), "timeout").when(text.contains("refused"), "rejection").otherwise("other")


@query(VIEWS + f", e AS (SELECT run, {_ERROR} AS m FROM v_records WHERE err) SELECT run, CASE WHEN m IS NULL THEN 'missing' WHEN regexp_matches(lower(m), 'http error 429') THEN 'rate' WHEN regexp_matches(lower(m), 'http error 5') THEN 'server' WHEN contains(lower(m), 'timed out') THEN 'timeout' WHEN contains(lower(m), 'refused') THEN 'rejection' ELSE 'other' END AS kind, count(*) AS n FROM e GROUP BY ALL")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("case_id") % 5
    message = F.when(k == 1, "HTTP error 429: slow down").when(k == 2, "HTTP error 503").when(k == 3, "timed out").when(k == 4, "refused by policy")
    return tables.records(spark, sf_dir).where("err").groupBy("run", error_kind(message).alias("kind")).agg(F.count("*").alias("n"))


_VECTOR = """, raw AS (SELECT run, case_id, ord, opt, CASE WHEN case_id % 19 = 0 THEN CAST(0 AS DOUBLE) WHEN case_id % 23 = 0 THEN CAST(0.25 AS DOUBLE) WHEN case_id % 29 = 1 AND ord = 3 THEN NULL WHEN case_id % 31 = 2 THEN p * 1.5 ELSE p END AS p FROM v_probs),
st AS (SELECT run, case_id, CASE WHEN count(p) < 4 OR max(p) > 1 OR min(p) < 0 THEN 'invalid' WHEN sum(p) = 0 THEN 'zero' WHEN max(p) - min(p) < CAST(0.05 AS DOUBLE) THEN 'uniform' WHEN sum(p) < CAST(0.99 AS DOUBLE) OR sum(p) > CAST(1.01 AS DOUBLE) THEN 'off_sum' ELSE 'ok' END AS state FROM raw GROUP BY run, case_id)"""


@query(VIEWS + _VECTOR + " SELECT run, state, count(*) AS n FROM st GROUP BY ALL")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each raw probability vector: all options there and within 0..1, not all zero, not flat, sum near 1."""
    case, ord_, p = F.col("case_id"), F.col("ord"), F.col("p")
    raw = F.when(case % 19 == 0, 0.0).when(case % 23 == 0, 0.25).when((case % 29 == 1) & (ord_ == 3), F.lit(None)).when(case % 31 == 2, p * 1.5).otherwise(p)
    rows = tables.options(spark, sf_dir).withColumn("p", raw).groupBy("run", "case_id").agg(F.count("p").alias("n"), F.max("p").alias("hi"), F.min("p").alias("lo"), F.sum("p").alias("s"))
    state = F.when((F.col("n") < len(OPTIONS)) | (F.col("hi") > 1) | (F.col("lo") < 0), "invalid").when(F.col("s") == 0, "zero").when(F.col("hi") - F.col("lo") < 0.05, "uniform").when((F.col("s") < 0.99) | (F.col("s") > 1.01), "off_sum").otherwise("ok")
    return rows.groupBy("run", state.alias("state")).agg(F.count("*").alias("n"))


@query(VIEWS + ", v AS (SELECT run, case_id, sum(p) AS s, sum(p * ord) AS e, max(p) AS hi FROM v_probs GROUP BY ALL) SELECT run, count(*) AS n, CAST(sum(CASE WHEN s BETWEEN CAST(0.99 AS DOUBLE) AND CAST(1.01 AS DOUBLE) THEN 0 ELSE 1 END) AS BIGINT) AS bad_sum, round(avg(e), 6) AS expected, round(max(hi), 6) AS most FROM v GROUP BY run")
def numeric_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.options(spark, sf_dir).groupBy("run", "case_id").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("ord")).alias("e"), F.max("p").alias("hi"))
    return vectors.groupBy("run").agg(F.count("*").alias("n"), F.count_if(~F.col("s").between(0.99, 1.01)).alias("bad_sum"), rounded(F.avg("e")).alias("expected"), rounded(F.max("hi")).alias("most"))


@query(VIEWS + ", v AS (SELECT run, case_id, ord, p FROM v_probs WHERE case_id % 3 <> 0 OR ord <> 2) SELECT run, count(*) AS n, CAST(sum(CASE WHEN z THEN 1 ELSE 0 END) AS BIGINT) AS null_vectors, CAST(sum(CASE WHEN u THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM (SELECT run, case_id, case_id % 19 = 0 AND case_id % 13 <> 0 AS z, case_id % 13 = 0 AS u FROM v GROUP BY run, case_id) GROUP BY run")
def null_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose last readable attempt is an all-zero vector; where no attempt can be read the answer is unknown.

    Attempts are wire texts: an unreadable one, then, for most cases, a readable one.
    """
    case = F.col("case_id")
    zero = F.when(case % 19 == 0, F.lit('{"probabilities": {"en": 0, "de": 0}}')).otherwise(F.lit('{"probabilities": {"en": 0.5, "de": 0.5}}'))
    attempts = F.array(F.lit("```json\n{broken"), F.when(case % 13 != 0, F.concat(F.lit("```json\n"), zero, F.lit("\n```"))))
    bare = lambda x: F.regexp_replace(x, r"(?s)\A\s*```[a-z]*\n?|\n?```\s*\z", "")
    parsed = F.filter(F.transform(attempts, lambda x: F.from_json(bare(x), "probabilities map<string,double>")["probabilities"]), lambda m: m.isNotNull())
    rows = tables.records(spark, sf_dir).select("run", F.try_element_at(parsed, F.lit(-1)).alias("last"))
    null = F.forall(F.map_values("last"), lambda p: p == 0)
    return rows.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("last").isNotNull() & null).alias("null_vectors"), F.count_if(F.col("last").isNull()).alias("unknown"))


@query(VIEWS + """, o AS (SELECT run, case_id, opt, label, (ord - case_id % 4 + 4) % 4 AS place FROM v_option JOIN v_choice USING (run, case_id))
SELECT run, case_id, string_agg(opt, ',' ORDER BY place) AS rotated, CAST(max(CASE WHEN opt = label THEN place END) AS BIGINT) AS shown_at FROM o GROUP BY run, case_id""")
def rotate_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's options turned by its own shift (modulo their number), and where its choice then stands."""
    n = len(OPTIONS)
    turned = tables.options(spark, sf_dir).select("run", "case_id", "opt", F.pmod(F.col("ord") - F.col("case_id") % n, F.lit(n)).alias("place"))
    chosen = choices(spark, sf_dir).select("run", "case_id", "label")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "opt"))), lambda x: x["opt"]), ",")
    at = F.max(F.when(F.col("opt") == F.col("label"), F.col("place")))
    return turned.join(chosen, ["run", "case_id"]).groupBy("run", "case_id").agg(listed.alias("rotated"), at.cast("long").alias("shown_at"))


@query(VIEWS + """, a AS (SELECT case_id, phase, label FROM v_choice WHERE run = 0 AND NOT err), b AS (SELECT case_id, label FROM v_choice WHERE run = 1 AND NOT err), j AS (SELECT phase, a.label AS la, b.label AS lb, list_position(['en','de','fr','es'], a.label) AS pa, list_position(['de','fr','es','en'], b.label) AS pb FROM a JOIN b USING (case_id))
SELECT phase, count(*) AS n, CAST(sum(CASE WHEN la <> lb THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(sum(CASE WHEN la <> lb AND pa = pb THEN 1 ELSE 0 END) AS BIGINT) AS keeps_position FROM j GROUP BY phase""")
def choice_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices that differ between an order of the options and a rotated one, and those that keep the position."""
    made = choices(spark, sf_dir).where("NOT err")
    a, b = made.where("run = 0").select("case_id", "phase", F.col("label").alias("la")), made.where("run = 1").select("case_id", F.col("label").alias("lb"))
    base, turned = (F.array(*[F.lit(x) for x in o]) for o in (OPTIONS, OPTIONS[1:] + OPTIONS[:1]))
    differ = F.col("la") != F.col("lb")
    stays = F.array_position(base, F.col("la")) == F.array_position(turned, F.col("lb"))
    return a.join(b, "case_id").groupBy("phase").agg(F.count("*").alias("n"), F.count_if(differ).alias("changed"), F.count_if(differ & stays).alias("keeps_position"))


@query(VIEWS + """, s AS (SELECT run, case_id, err, gt, opt, ord, CAST(w AS DOUBLE) * w * w * w AS w FROM v_option), p AS (SELECT *, w / sum(w) OVER (PARTITION BY run, case_id) AS p FROM s)
SELECT run, case_id, gt, round(p, 6) AS p FROM p WHERE NOT err AND opt = 'en' AND p >= CAST(0.7 AS DOUBLE) AND gt <> 'en'""")
def primacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First option chosen firmly (0.7 or more, of weights sharpened to their fourth power) and wrongly."""
    w = F.col("w").cast("double")
    sharp = tables.options(spark, sf_dir).where("NOT err").withColumn("s", w * F.col("w") * F.col("w") * F.col("w"))
    whole = sharp.groupBy("run", "case_id").agg(F.sum("s").alias("whole"), *[F.max(F.when(F.col("opt") == OPTIONS[0], F.col("s"))).alias("first"), F.first("gt").alias("gt")])
    p = F.col("first") / F.col("whole")
    return whole.where((p >= 0.7) & (F.col("gt") != OPTIONS[0])).select("run", "case_id", "gt", rounded(p).alias("p"))


@query(VIEWS + "SELECT run, round(sum(cost), 9) AS recorded, round(max(cost), 9) AS highest, CAST(sum(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown, CAST(sum(CASE WHEN cost > CAST(0.00004 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS over_cap, round(greatest(sum(cost), CAST(0.0085 AS DOUBLE)), 9) AS prior, round(CAST(0.02 AS DOUBLE) - sum(cost) - greatest(CAST(0.001 AS DOUBLE), sum(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) * CAST(0.00005 AS DOUBLE)), 9) AS remaining FROM v_records GROUP BY run")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known cost, unknown records, durable ledger (here 0.0085) and what the budget (0.02) leaves after a reserve."""
    unknown = F.count_if(F.col("cost").isNull())
    spent = F.sum("cost")
    left = F.lit(0.02) - spent - F.greatest(F.lit(0.001), unknown * F.lit(0.00005))
    nine = lambda x: F.round(x, 9)
    return tables.records(spark, sf_dir).groupBy("run").agg(nine(spent).alias("recorded"), nine(F.max("cost")).alias("highest"), unknown.alias("unknown"), F.count_if(F.col("cost") > 0.00004).alias("over_cap"), nine(F.greatest(spent, F.lit(0.0085))).alias("prior"), nine(left).alias("remaining"))


@query(VIEWS + f", r AS (SELECT run, case_id, sum(coalesce(cost, 0)) OVER (PARTITION BY run ORDER BY case_id) AS total FROM v_records) SELECT run, min(CASE WHEN round(total, 9) >= CAST({CAP} AS DOUBLE) THEN case_id END) AS stop_at, min(CASE WHEN round(total, 9) > CAST({CAP} AS DOUBLE) THEN case_id END) AS stop_above FROM r GROUP BY run")
def cost_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a running cost reaches the cap, and where it passes it: the two guards differ."""
    total = F.round("total", 9)
    rows = running_sums(tables.records(spark, sf_dir).select("run", "case_id", "cost"), "run", "case_id", "cost", "total").withColumn("total", total)
    return rows.groupBy("run").agg(F.min(F.when(F.col("total") >= CAP, F.col("case_id"))).alias("stop_at"), F.min(F.when(F.col("total") > CAP, F.col("case_id"))).alias("stop_above"))


@query(VIEWS + "SELECT c.case_id FROM v_cases c WHERE NOT EXISTS (SELECT 1 FROM v_records r WHERE r.run = 0 AND r.case_id = c.case_id AND NOT r.err AND r.case_id % 4 <> 1)")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without a good record: never run (here every fourth), or failed and to be tried again."""
    done = tables.records(spark, sf_dir).where("run = 0 AND NOT err AND case_id % 4 <> 1").select("case_id")
    return tables.cases(spark, sf_dir).select("case_id").join(done, "case_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id % 50 NOT IN (3, 17) EXCEPT SELECT doc_id FROM documents WHERE source = 'src4'")
def exposed_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    return docs.where(~(F.col("doc_id") % 50).isin(3, 17)).select("doc_id").join(docs.where("source = 'src4'").select("doc_id"), "doc_id", "left_anti").distinct()


_META = "WITH m AS (SELECT source AS run, CAST(doc_id % 7 AS VARCHAR) AS phase, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 101 = 5 THEN 'model-20240102' ELSE 'model-20240101' END AS version FROM documents) "


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that each record of a run says it was made with."""
    version = F.when(F.col("doc_id") % 13 == 0, F.lit(None)).when(F.col("doc_id") % 101 == 5, "model-20240102").otherwise("model-20240101")
    return tables.read(spark, sf_dir, "documents").select(F.col("source").alias("run"), (F.col("doc_id") % 7).cast("string").alias("phase"), version.alias("version"))


@query(_META + "SELECT run, CAST(sum(CASE WHEN version = 'model-20240101' THEN 1 ELSE 0 END) AS BIGINT) AS expected, CAST(sum(CASE WHEN version <> 'model-20240101' THEN 1 ELSE 0 END) AS BIGINT) AS other, CAST(sum(CASE WHEN version IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown, sum(CASE WHEN version = 'model-20240101' THEN 1 ELSE 0 END) >= 1 AND sum(CASE WHEN version <> 'model-20240101' THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN version IS NULL THEN 1 ELSE 0 END) = 0 AS passed FROM m GROUP BY run")
def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.col("version")
    counts = _versions(spark, sf_dir).groupBy("run").agg(F.count_if(version == "model-20240101").alias("expected"), F.count_if(version != "model-20240101").alias("other"), F.count_if(version.isNull()).alias("unknown"))
    return counts.withColumn("passed", (F.col("expected") >= 1) & (F.col("other") == 0) & (F.col("unknown") == 0))


@query(_META + "SELECT run, count(DISTINCT version) AS versions, count(DISTINCT version) > 1 AS drift, sum(CASE WHEN regexp_matches(version, '[0-9]{8}') THEN 1 ELSE 0 END) = count(*) AS accredited FROM m GROUP BY run")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct versions of a run; accredited if each record names a dated one."""
    rows = _versions(spark, sf_dir).groupBy("run")
    return rows.agg(F.countDistinct("version").alias("versions"), (F.countDistinct("version") > 1).alias("drift"), (F.count_if(F.col("version").rlike(r"\d{8}")) == F.count("*")).alias("accredited"))


@query("WITH a AS (SELECT source, min(n_chars) AS lo, max(n_chars) AS hi, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY source), b AS (SELECT source, min(n_chars) AS lo, max(n_chars) AS hi, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY source), l AS (SELECT source, 'lo' AS key, a.lo AS was, b.lo AS now FROM a FULL JOIN b USING (source) UNION ALL SELECT source, 'hi', a.hi, b.hi FROM a FULL JOIN b USING (source) UNION ALL SELECT source, 'n', a.n, b.n FROM a FULL JOIN b USING (source)) SELECT source, key, was, now FROM l WHERE key <> 'n' AND was IS DISTINCT FROM now")
def config_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static keys whose value differs between two runs' configurations; the dynamic key n is exempt."""
    docs = tables.read(spark, sf_dir, "documents")
    config = lambda odd: docs.where(F.col("doc_id") % 2 == odd).groupBy("source").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.count("*").alias("n"))
    long = lambda df, name: df.unpivot("source", ["lo", "hi", "n"], "key", name)
    both = long(config(0), "was").join(long(config(1), "now"), ["source", "key"], "full")
    return both.where((F.col("key") != "n") & ~F.col("was").eqNullSafe(F.col("now")))


@query("WITH f AS (SELECT source, sha256('{\"chars\":' || CAST(sum(n_chars) AS VARCHAR) || ',\"rows\":' || CAST(count(*) AS VARCHAR) || ',\"seed\":null}') AS fingerprint FROM documents GROUP BY source) SELECT * FROM f")
def config_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a configuration as JSON with sorted keys and no blanks, missing keys as null."""
    config = tables.read(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("rows"))
    text = F.to_json(F.struct("chars", "rows", F.lit(None).cast("string").alias("seed")), {"ignoreNullFields": "false"})
    return config.select("source", F.sha2(text, 256).alias("fingerprint"))


@query("WITH m AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 9 <> 0), c AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 8 <> 0) SELECT CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'added' WHEN m.sha <> c.sha THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM m FULL JOIN c USING (doc_id) GROUP BY 1")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of hashes against current files."""
    docs = tables.read(spark, sf_dir, "documents")
    was = docs.where("doc_id % 9 <> 0").select("doc_id", F.sha2("text", 256).alias("was"))
    now = docs.where("doc_id % 8 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return was.join(now, "doc_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(VIEWS + ", b AS (SELECT 'brier' AS metric, 0.33 AS conf, 0.5 AS inc UNION ALL SELECT 'majority', 0.1, 0.15), v AS (SELECT run, 'brier' AS metric, avg((value - gt) * (value - gt)) AS x FROM v_binary WHERE NOT err AND qid = 'quality' GROUP BY run UNION ALL SELECT 9, 'brier', NULL UNION ALL SELECT 9, 'majority', 0.2) SELECT run, metric, CASE WHEN x IS NULL THEN 'NO EVALUABLE' WHEN x <= conf THEN 'CONFIRMADA' WHEN x <= inc THEN 'INCONCLUSA' ELSE 'REFUTADA' END AS verdict FROM v JOIN b USING (metric)")
def verdict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric's verdict by two thresholds, which are data; an undefined metric can't be judged."""
    bands = spark.createDataFrame([("brier", 0.33, 0.5), ("majority", 0.1, 0.15)], "metric string, conf double, inc double")
    brier = tables.binary(spark, sf_dir).where("NOT err AND qid = 'quality'").groupBy("run").agg(F.avg((F.col("value") - F.col("gt")) ** 2).alias("x")).select("run", F.lit("brier").alias("metric"), "x")
    extra = spark.createDataFrame([(9, "brier", None), (9, "majority", 0.2)], "run int, metric string, x double")
    verdict = F.when(F.col("x").isNull(), "NO EVALUABLE").when(F.col("x") <= F.col("conf"), "CONFIRMADA").when(F.col("x") <= F.col("inc"), "INCONCLUSA").otherwise("REFUTADA")
    return brier.unionByName(extra).join(F.broadcast(bands), "metric").select("run", "metric", verdict.alias("verdict"))


@query("WITH v AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 3 END AS v2, doc_id % 2 AS v1 FROM documents) SELECT coalesce(v2, v1) AS gt, v2 IS NULL AS from_older, count(*) AS n FROM v GROUP BY ALL")
def gt_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as of a version, falling back to the one before where it has none."""
    docs = tables.read(spark, sf_dir, "documents")
    newer = docs.where("doc_id % 6 <> 0").select("doc_id", (F.col("doc_id") % 3).alias("v2"))
    older = docs.select("doc_id", (F.col("doc_id") % 2).alias("v1"))
    return older.join(newer, "doc_id", "left").groupBy(F.coalesce("v2", "v1").alias("gt"), F.col("v2").isNull().alias("from_older")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT doc_id, n_chars AS seen, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars + doc_id % 7 - 3 END AS told FROM documents) SELECT CASE WHEN told IS NULL THEN 'no_usage' WHEN abs(told - seen) <= 2 THEN 'ok' ELSE 'violation' END AS rule, count(*) AS n FROM t GROUP BY 1")
def token_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") + F.col("doc_id") % 7 - 3)
    rule = F.when(told.isNull(), "no_usage").when(F.abs(told - F.col("n_chars")) <= 2, "ok").otherwise("violation")
    return tables.read(spark, sf_dir, "documents").groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT DISTINCT source FROM documents), k AS (SELECT 'src' || CAST(unnest(range(0, 15)) AS VARCHAR) AS source) SELECT source FROM o WHERE source NOT IN (SELECT source FROM k)")
def new_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names observed and not known."""
    known = spark.range(15).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    return tables.read(spark, sf_dir, "documents").select("source").distinct().join(known, "source", "left_anti")
