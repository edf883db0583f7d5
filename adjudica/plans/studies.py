"""Studies that combine several operators: primacy and seed analyses, verdict rules, agreement between repetitions, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import rounded
from adjudica.functions.redaction import redacted
from adjudica.operators import pairing
from adjudica.operators.ranking import holm
from adjudica.operators.resampling import hashed_uniform, percentile_interval, replicate_sums, resampled
from adjudica.plans.comparison import _DEPTH, SAID, _depth, _folded, cuts
from adjudica.plans.curation import _GRAMS
from adjudica.plans.decisions import choices, decisions
from adjudica.plans.gates import first_reason
from adjudica.plans.resampling import CLUSTER_REPLICATES, REPLICATES, _draws, _gain_sql, _gains, _interval, _shown, joint_stats
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import VIEWS, read

NO_VERDICT = "NO EVALUABLE"


@query(_gain_sql(4) + ", long AS (SELECT rep, 'delta' AS stat, g1 - g0 AS v FROM gains) " + _interval("v", "stat", "long"))
def paired_strat_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two runs' adjusted scores when the same cases are drawn for both, within phases."""
    return joint_stats(_gains(spark, sf_dir, 4), {"delta": F.col("g1") - F.col("g0")})


#: The hits of the choice by case in each run, and whether a pattern finds the case's text; null where the run failed.
_HITS = VIEWS + """, h AS (SELECT c.case_id, c.cluster_id, max(CASE WHEN c.run = 0 THEN hit END) AS h0, max(CASE WHEN c.run = 1 THEN hit END) AS h1, max(CASE WHEN c.run = 2 THEN hit END) AS h2, bool_or(regexp_matches(d.text, '\\n')) AS subset, min(c.phase) = 'es' AS main
FROM (SELECT *, CAST(label = gt AS INT) AS hit FROM v_choice WHERE NOT err) c JOIN documents d ON d.doc_id = c.case_id GROUP BY c.case_id, c.cluster_id)"""


def choice_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, cluster_id, h0..h2, subset, main: the SQL above as a plan; cases are joined with texts once."""
    hit = (F.col("label") == F.col("gt")).cast("int")
    of = [F.max(F.when(F.col("run") == r, hit)).alias(f"h{r}") for r in tables.RUNS]
    made = choices(spark, sf_dir).where("NOT err").groupBy("case_id", "cluster_id").agg(*of, F.min("phase").alias("phase"))
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").rlike(r"\n").alias("subset"))
    return made.join(texts, "case_id").withColumn("main", F.col("phase") == "es").drop("phase")


_PAIRS = ((0, 1), (0, 2), (1, 2))
_TESTS = [*((f"{a}v{b} all", a, b, "TRUE") for a, b in _PAIRS), *((f"{a}v{b} subset", a, b, "subset") for a, b in _PAIRS), ("primacy", 0, 1, "subset AND main")]
_FAMILY = _HITS + ", k AS (" + " UNION ALL ".join(f"SELECT '{name}' AS test, sum(CASE WHEN h{a} > h{b} THEN 1 ELSE 0 END) AS b, sum(CASE WHEN h{b} > h{a} THEN 1 ELSE 0 END) AS c FROM h WHERE {where} AND h{a} IS NOT NULL AND h{b} IS NOT NULL" for name, a, b, where in _TESTS) + """),
t AS (SELECT test, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM k), p AS (SELECT *, CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, CAST(least(b, c) AS BIGINT) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS p FROM t),
s AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p) AS s FROM p), f AS (SELECT test, CAST(b AS BIGINT) AS only_ref, CAST(c AS BIGINT) AS only_run, p, max(s) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS p_holm FROM s)
"""


def family_tests(hits: DataFrame) -> DataFrame:
    """(test, only_ref, only_run, p, p_holm) of the seven planned tests, all counted in one pass; a test without a pair has p = 1."""
    counts = []
    for name, a, b, where in _TESTS:
        both = F.expr(where) & F.col(f"h{a}").isNotNull() & F.col(f"h{b}").isNotNull()
        counts.append(F.struct(F.lit(name).alias("test"), F.count_if(both & (F.col(f"h{a}") > F.col(f"h{b}"))).alias("only_ref"), F.count_if(both & (F.col(f"h{b}") > F.col(f"h{a}"))).alias("only_run")))
    rows = hits.agg(F.array(*counts).alias("t")).select(F.explode("t").alias("t")).select("t.*")
    return holm(rows.withColumns({"p": pairing.mcnemar_p("only_ref", "only_run"), "family": F.lit(1)}), ["family"], "p", ["test"])


@query(_FAMILY + "SELECT test, only_ref, only_run, round(p, 9) AS p, round(p_holm, 9) AS p_holm FROM f")
def primacy_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Holm family of a primacy study: each pair of orders over all cases and over the subset, and the primary test."""
    return family_tests(choice_hits(spark, sf_dir)).select("test", "only_ref", "only_run", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


_PRIMACY = _HITS + ", u AS (SELECT cluster_id, 'all' AS stratum, sum(h1 - h0) AS d, count(*) AS n FROM h WHERE subset AND h0 IS NOT NULL AND h1 IS NOT NULL GROUP BY cluster_id)" + _draws("u", "stratum", "cluster_id", 82, CLUSTER_REPLICATES) + ", reps AS (SELECT rep, CAST(100 AS DOUBLE) * sum(d) / sum(n) AS v FROM r_drawn GROUP BY rep) "


def primacy_delta(hits: DataFrame) -> DataFrame:
    """(mean, low, high) of the points by which errors of the first order exceed those of the second, clusters drawn."""
    units = hits.where("subset AND h0 IS NOT NULL AND h1 IS NOT NULL").groupBy("cluster_id").agg(F.sum(F.col("h1") - F.col("h0")).alias("d"), F.count("*").alias("n")).withColumn("stratum", F.lit("all"))
    reps = resampled(units, "stratum", "cluster_id", CLUSTER_REPLICATES, 82).groupBy("rep").agg((F.lit(100.0) * F.sum("d") / F.sum("n")).alias("v"))
    return percentile_interval(reps, [], "v", CLUSTER_REPLICATES)


@query(_PRIMACY + _interval("v", "", "reps", CLUSTER_REPLICATES))
def primacy_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(primacy_delta(choice_hits(spark, sf_dir)))


_GATE = ", g AS (SELECT bool_or(cost > CAST(0.0001 AS DOUBLE)) AS drift, sum(CASE WHEN h0 IS NOT NULL AND h1 IS NOT NULL THEN 1 ELSE 0 END) AS pairs FROM h LEFT JOIN (SELECT case_id, max(cost) AS cost FROM v_records WHERE run IN (0, 1) GROUP BY case_id) USING (case_id))"


def _gate(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """(drift, pairs) of runs 0 and 1: whether a record stands out of its snapshot (here by its cost), and the pairs they have."""
    drift = tables.records(spark, sf_dir).where("run IN (0, 1)").groupBy("case_id").agg(F.max("cost").alias("cost"))
    pairs = F.count_if(F.col("h0").isNotNull() & F.col("h1").isNotNull())
    return hits.join(drift, "case_id", "left").agg(F.bool_or(F.col("cost") > 0.0001).alias("drift"), pairs.alias("pairs"))


@query(_FAMILY + _PRIMACY[len(_HITS):] + _GATE + ", i AS (" + _interval("v", "", "reps", CLUSTER_REPLICATES) + f""") SELECT CASE WHEN pairs = 0 THEN '{NO_VERDICT}' WHEN drift THEN '{NO_VERDICT}' WHEN mean >= 5 AND low > 0 AND p_holm < CAST(0.05 AS DOUBLE) THEN 'CONFIRMADA' WHEN high < 5 THEN 'REFUTADA' ELSE 'INCONCLUSA' END AS verdict,
 CASE WHEN pairs = 0 THEN 'no pair' WHEN drift THEN 'snapshot drift' END AS reason FROM i, g, f WHERE test = 'primacy'""")
def primacy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the primacy study: gates first, then the interval and the family's adjusted p."""
    hits = choice_hits(spark, sf_dir)
    one = F.lit(1).alias("one")
    parts = [_shown(primacy_delta(hits)).select("*", one), _gate(spark, sf_dir, hits).select("*", one), family_tests(hits).where("test = 'primacy'").select("p_holm", one)]  # a row each
    joined = parts[0].join(parts[1], "one").join(parts[2], "one")
    reason = first_reason({"no pair": F.col("pairs") == 0, "snapshot drift": F.col("drift")}, "")
    sure = (F.col("mean") >= 5) & (F.col("low") > 0) & (F.col("p_holm") < 0.05)
    verdict = F.when(reason != "", NO_VERDICT).when(sure, "CONFIRMADA").when(F.col("high") < 5, "REFUTADA").otherwise("INCONCLUSA")
    return joined.select(verdict.alias("verdict"), F.nullif(reason, F.lit("")).alias("reason"))


@query(VIEWS + """, w AS (SELECT phase, case_id, max(CASE WHEN run = 0 THEN label END) AS a, max(CASE WHEN run = 1 THEN label END) AS b, max(CASE WHEN run = 2 THEN label END) AS r FROM v_choice WHERE NOT err AND case_id % 7 <> 3 GROUP BY ALL),
k AS (SELECT phase, sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END) AS pairs, sum(CASE WHEN a IS NOT NULL AND r IS NOT NULL THEN 1 ELSE 0 END) AS control, sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS changed, sum(CASE WHEN a <> r THEN 1 ELSE 0 END) AS control_changed FROM w GROUP BY phase)
SELECT phase, CAST(changed AS BIGINT) AS changed, CASE WHEN pairs = 0 THEN 'NO EVALUABLE' WHEN control = 0 THEN 'NO EVALUABLE' WHEN control_changed >= 1 THEN 'NO EVALUABLE' WHEN changed >= 1 THEN 'REFUTADA' ELSE 'COMPATIBLE/INCONCLUSA' END AS verdict,
 CASE WHEN pairs = 0 THEN 'no pair' WHEN control = 0 THEN 'no control' WHEN control_changed >= 1 THEN 'control changes' END AS reason FROM k""")
def zero_change_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a claim of no change between two orders stands: not judged without a control run, or where the control itself
    changes; exposed cases (here case_id % 7 = 3) take no part."""
    of = [F.max(F.when(F.col("run") == r, F.col("label"))).alias(n) for r, n in zip(tables.RUNS, "abr", strict=True)]
    wide = choices(spark, sf_dir).where("NOT err AND case_id % 7 <> 3").groupBy("phase", "case_id").agg(*of)
    have = lambda x: F.count_if(F.col("a").isNotNull() & F.col(x).isNotNull())
    k = wide.groupBy("phase").agg(have("b").alias("pairs"), have("r").alias("control"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a") != F.col("r")).alias("control_changed"))
    reason = first_reason({"no pair": F.col("pairs") == 0, "no control": F.col("control") == 0, "control changes": F.col("control_changed") >= 1}, "")
    verdict = F.when(reason != "", NO_VERDICT).when(F.col("changed") >= 1, "REFUTADA").otherwise("COMPATIBLE/INCONCLUSA")
    return k.select("phase", "changed", verdict.alias("verdict"), F.nullif(reason, F.lit("")).alias("reason"))


@query(VIEWS + """, arms AS (SELECT phase, case_id, run, max(CASE WHEN qid = 'quality' THEN point END) AS a, max(CASE WHEN qid = 'toxic' THEN point END) AS b FROM v_points WHERE qtype = 'noul' AND NOT err GROUP BY ALL),
d AS (SELECT 'all' AS stratum, case_id, avg(b - a) AS d, count(*) AS seeds FROM arms WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY case_id), ok AS (SELECT * FROM d WHERE seeds = 3)""" + _draws("ok", "stratum", "case_id", 712) + ", reps AS (SELECT rep, avg(d) * 100 AS v FROM r_drawn GROUP BY rep), i AS (" + _interval("v", "", "reps") + ") SELECT i.*, (SELECT count(*) FROM ok) AS n, (SELECT count(*) FROM d) = (SELECT count(*) FROM ok) AS complete FROM i")
def seed_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two arms, paired by case and averaged over the three seeds (here the runs), with an interval over cases;
    cases without all seeds are left out, and the flag tells whether there are such."""
    arm = lambda q: F.max(F.when(F.col("qid") == q, F.col("point")))
    arms = decisions(spark, sf_dir).where("qtype = 'noul' AND NOT err").groupBy("case_id", "run").agg(arm("quality").alias("a"), arm("toxic").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    each = arms.groupBy("case_id").agg(F.avg(F.col("b") - F.col("a")).alias("d"), F.count("*").alias("seeds")).withColumn("stratum", F.lit("all"))
    reps = replicate_sums(each.where(F.col("seeds") == len(tables.RUNS)), "stratum", "case_id", ["d"], REPLICATES, 712).select("rep", (F.try_divide("sum_d", "count_d") * 100).alias("v"))
    flags = each.agg(F.count_if(F.col("seeds") == 3).alias("n"), F.bool_and(F.col("seeds") == 3).alias("complete")).withColumn("one", F.lit(1))
    return _shown(percentile_interval(reps, [], "v", REPLICATES)).withColumn("one", F.lit(1)).join(flags, "one").drop("one")


@query(VIEWS + """, w AS (SELECT phase, case_id, qid, max(gt) AS gt, avg(value) AS v FROM v_binary WHERE run IN (0, 2) AND NOT err GROUP BY ALL) SELECT phase, qid, count(*) AS n, CAST(sum(CASE WHEN (v >= CAST(0.5 AS DOUBLE)) = (gt = 1) THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg((v - gt) * (v - gt)), 6) AS brier FROM w GROUP BY ALL""")
def control_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control of a cascade: two independent first passes averaged, scored like one run; one answer stands alone."""
    mean = tables.binary(spark, sf_dir).where("run IN (0, 2) AND NOT err").groupBy("phase", "case_id", "qid").agg(F.max("gt").alias("gt"), F.avg("value").alias("v"))
    off = F.col("v") - F.col("gt")
    return mean.groupBy("phase", "qid").agg(F.count("*").alias("n"), F.count_if((F.col("v") >= 0.5) == (F.col("gt") == 1)).alias("hits"), rounded(F.avg(off * off)).alias("brier"))


def short_digest(canonical: Column) -> Column:
    """First twelve hex digits of the sha256 of a canonical JSON text."""
    return F.substring(F.sha2(canonical, 256), 1, 12)


@query("""SELECT source AS phase, substr(sha256('{"order": [' || string_agg('"' || lang || '"', ', ' ORDER BY n DESC, lang) || '], "phase": "' || source || '"}'), 1, 12) AS perm_sha FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def order_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each phase's order of the options, here by how common they are, over JSON with sorted keys and spaces after ',' and ':'."""
    counts = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    ordered = counts.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "lang"))), lambda x: F.concat(F.lit('"'), x["lang"], F.lit('"'))).alias("o"))
    text = F.concat(F.lit('{"order": ['), F.array_join("o", ", "), F.lit('], "phase": "'), F.col("source"), F.lit('"}'))
    return ordered.select(F.col("source").alias("phase"), short_digest(text).alias("perm_sha"))


@query(VIEWS + """SELECT phase, substr(sha256('{' || string_agg('"' || qid || '": "' || qtype || '"', ', ' ORDER BY qid) || '}'), 1, 12) AS questions_sha FROM (SELECT DISTINCT phase, qid, qtype FROM v_decisions) GROUP BY phase""")
def question_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each phase's set of questions and their kinds."""
    asked = decisions(spark, sf_dir).select("phase", "qid", "qtype").distinct().groupBy("phase").agg(F.sort_array(F.collect_list(F.struct("qid", "qtype"))).alias("q"))
    pairs = F.transform("q", lambda x: F.concat(F.lit('"'), x["qid"], F.lit('": "'), x["qtype"], F.lit('"')))
    return asked.select("phase", short_digest(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))).alias("questions_sha"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{"max_tokens": ' || user_id || ', "kind": "' || event_type || '"}' WHEN event_id % 5 = 1 THEN '{broken "token": 1' ELSE
'{"api_key":"<redacted>","max_tokens":7,"list":[{"Token":"<redacted>"},' || user_id || ',{"Set-Cookie":"<redacted>"}],"nested":"{\\"deep\\":{\\"password\\":\\"<redacted>\\",\\"n\\":' || event_id || '}}","kind":"' || event_type || '"}' END AS safe FROM events""")
def redact_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of fields with telling names, at any depth and inside JSON that an option has as a text, are replaced; options
    with nothing to hide and texts that aren't JSON stay as they are."""
    n, user, kind = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    inner = F.concat(F.lit('{\\"deep\\":{\\"password\\":'), user, F.lit(',\\"n\\":'), n, F.lit("}}"))
    whole = F.concat(F.lit('{"api_key":"k","max_tokens":7,"list":[{"Token":1},'), user, F.lit(',{"Set-Cookie":{"a":1}}],"nested":"'), inner, F.lit('","kind":"'), kind, F.lit('"}'))
    plain = F.concat(F.lit('{"max_tokens": '), user, F.lit(', "kind": "'), kind, F.lit('"}'))
    raw = F.when(F.col("event_id") % 5 == 0, plain).when(F.col("event_id") % 5 == 1, '{broken "token": 1').otherwise(whole)
    return read(spark, sf_dir, "events").select("event_id", redacted(raw).alias("safe"))


_FOLD = "CAST(('0x' || substr(md5('cv:' || case_id), 1, 13)) AS BIGINT) % 2"


@query(VIEWS + _DEPTH + f""", e AS (SELECT *, {_FOLD} AS fold FROM d), c AS (SELECT run, fold, (rel + lead(rel) OVER (PARTITION BY run, fold ORDER BY rel)) / 2 AS t FROM e UNION ALL SELECT DISTINCT run, fold, 0 FROM e UNION ALL SELECT DISTINCT run, fold, 2 FROM e),
k AS (SELECT c.run, c.fold, c.t, sum(CASE WHEN (CASE WHEN rel < c.t THEN 'skip' ELSE deep END) = truth THEN 1 ELSE 0 END) AS ok FROM (SELECT DISTINCT run, fold, t FROM c WHERE t IS NOT NULL) c JOIN e USING (run, fold) GROUP BY ALL),
b AS (SELECT run, fold, t FROM (SELECT *, row_number() OVER (PARTITION BY run, fold ORDER BY ok DESC, t) AS rn FROM k) WHERE rn = 1)
SELECT e.run, e.fold, round(b.t, 6) AS t, count(*) AS n, CAST(sum(CASE WHEN (CASE WHEN rel < b.t THEN 'skip' ELSE deep END) = truth THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM e JOIN b ON b.run = e.run AND b.fold = 1 - e.fold GROUP BY e.run, e.fold, b.t""")
def two_fold_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each half of the cases, dealt by a hash, decided by the threshold that is best for the other half."""
    fold = F.conv(F.substring(F.md5(F.concat(F.lit("cv:"), F.col("case_id").cast("string"))), 1, 13), 16, 10).cast("long") % 2
    rows = _folded(_depth(spark, sf_dir).withColumn("fold", fold), ["run", "fold"])
    best = cuts(rows, ["run", "fold"]).groupBy("run", "fold").agg((-F.max(F.struct("ok", (-F.col("t")).alias("t")))["t"]).alias("t")).select("run", (1 - F.col("fold")).alias("fold"), "t")
    right = F.when(F.col("rel") < F.col("t"), F.col("skip_ok")).otherwise(F.col("deep_ok"))
    return rows.join(best, ["run", "fold"]).groupBy("run", "fold", rounded(F.col("t")).alias("t")).agg(F.sum("c").alias("n"), F.sum(right).alias("ok"))


@query(VIEWS + "SELECT id, case_id, phase FROM (SELECT case_id // 3 AS id, case_id, phase, row_number() OVER (PARTITION BY case_id // 3 ORDER BY list_position(['es', 'en', 'fr', 'de'], phase), case_id) AS rn FROM v_cases) WHERE rn = 1")
def es_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case of each translated id: the first in the order of phases; a grouped minimum, so nothing is sorted."""
    place = F.array_position(F.array(*[F.lit(x) for x in ("es", "en", "fr", "de")]), F.col("phase"))
    first = F.min(F.struct(place.alias("place"), "case_id", "phase")).alias("f")
    return tables.cases(spark, sf_dir).groupBy(F.floor(F.col("case_id") / 3).alias("id")).agg(first).select("id", "f.case_id", "f.phase")


@query(VIEWS + """, s AS (SELECT qid, CASE WHEN case_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, gt, least(greatest(value, CAST(0.000001 AS DOUBLE)), CAST(0.999999 AS DOUBLE)) AS v FROM v_binary WHERE run = 0 AND NOT err),
m AS (SELECT qid, least(greatest(avg(gt), CAST(0.000001 AS DOUBLE)), CAST(0.999999 AS DOUBLE)) AS share FROM s WHERE split = 'train' GROUP BY qid)
SELECT qid, split, count(*) AS n, CAST(sum(CASE WHEN (v >= CAST(0.5 AS DOUBLE)) = (gt = 1) THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(-ln(CASE WHEN gt = 1 THEN v ELSE 1 - v END)), 6) AS logloss, round(avg(-ln(CASE WHEN gt = 1 THEN share ELSE 1 - share END)), 6) AS share_logloss,
 avg(-ln(CASE WHEN gt = 1 THEN v ELSE 1 - v END)) > avg(-ln(CASE WHEN gt = 1 THEN share ELSE 1 - share END)) AS stop FROM s JOIN m USING (qid) GROUP BY qid, split""")
def split_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and log loss of each question and split against those of the training split's share; ``stop`` where it is no better."""
    bounded = lambda x: F.least(F.greatest(x, F.lit(0.000001)), F.lit(0.999999))
    split = F.when(F.col("case_id") % 5 == 0, "val").otherwise("train")
    rows = tables.binary(spark, sf_dir).where("run = 0 AND NOT err").select("qid", split.alias("split"), "gt", bounded(F.col("value")).alias("v"))
    shares = rows.where("split = 'train'").groupBy("qid").agg(bounded(F.avg("gt")).alias("share"))
    loss = lambda p: F.avg(-F.log(F.when(F.col("gt") == 1, F.col(p)).otherwise(1 - F.col(p))))
    found = rows.join(shares, "qid").groupBy("qid", "split").agg(F.count("*").alias("n"), F.count_if((F.col("v") >= 0.5) == (F.col("gt") == 1)).alias("hits"), loss("v").alias("a"), loss("share").alias("b"))
    return found.select("qid", "split", "n", "hits", rounded(F.col("a")).alias("logloss"), rounded(F.col("b")).alias("share_logloss"), (F.col("a") > F.col("b")).alias("stop"))


@query(VIEWS + ", a AS (SELECT * FROM v_choice WHERE run = 0 AND NOT err), b AS (SELECT * FROM v_choice WHERE run = 1 AND NOT err) SELECT a.phase, a.case_id, a.label AS label_a, b.label AS label_b, CASE WHEN a.label = a.gt THEN 'a' WHEN b.label = b.gt THEN 'b' ELSE 'none' END AS right_side FROM a JOIN b ON a.case_id = b.case_id WHERE a.label <> b.label AND a.case_id % 7 <> 3")
def order_discords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose choice differs between two orders, and which order is right; exposed ones (case_id % 7 = 3) left out."""
    made = choices(spark, sf_dir).where("NOT err AND case_id % 7 <> 3")
    a = made.where("run = 0").select("phase", "case_id", "gt", F.col("label").alias("label_a"))
    both = a.join(made.where("run = 1").select("case_id", F.col("label").alias("label_b")), "case_id").where("label_a <> label_b")
    side = F.when(F.col("label_a") == F.col("gt"), "a").when(F.col("label_b") == F.col("gt"), "b").otherwise("none")
    return both.select("phase", "case_id", "label_a", "label_b", side.alias("right_side"))


_REPS = " UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, qid, a{a} AS x, a{b} AS y, h{a} AS hx, h{b} AS hy FROM w" for a, b in _PAIRS)


@query(SAID + ", w AS (SELECT phase, case_id, qid, " + ", ".join(f"max(CASE WHEN run = {r} THEN said END) AS a{r}, bool_or(hit) FILTER (run = {r}) AS h{r}" for r in tables.RUNS) + " FROM v_said GROUP BY ALL), p AS (" + _REPS + """) SELECT pair, qid, CAST(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS BIGINT) AS n, CAST(count(*) FILTER (x = y) AS BIGINT) AS agree, CAST(count(*) FILTER (hx AND hy) AS BIGINT) AS both_right, CAST(count(*) FILTER ((x IS NULL) <> (y IS NULL)) AS BIGINT) AS one_sided FROM p GROUP BY ALL""")
def rep_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of every pair of repetitions: equal answers, both right, answers of one side only.  Cases are widened once."""
    made = decisions(spark, sf_dir).where("NOT err AND NOT refused")
    label = pairing.decision_label(F.col("qtype"), F.col("label"), F.col("value"))
    of = lambda r: [F.max(F.when(F.col("run") == r, label)).alias(f"a{r}"), F.bool_or(F.when(F.col("run") == r, F.col("point") == 1.0)).alias(f"h{r}")]
    wide = made.groupBy("phase", "case_id", "qid").agg(*[x for r in tables.RUNS for x in of(r)])
    listed = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"a{a}").alias("x"), F.col(f"a{b}").alias("y"), F.col(f"h{a}").alias("hx"), F.col(f"h{b}").alias("hy")) for a, b in _PAIRS])
    pairs = wide.select("qid", F.explode(listed).alias("p")).select("qid", "p.*")
    x, y = F.col("x"), F.col("y")
    return pairs.groupBy("pair", "qid").agg(F.count_if(x.isNotNull() & y.isNotNull()).alias("n"), F.count_if(x == y).alias("agree"), F.count_if(F.col("hx") & F.col("hy")).alias("both_right"), F.count_if(x.isNull() != y.isNull()).alias("one_sided"))


@query(SAID + """, c AS (SELECT p.qid, d.source IN ('src1', 'src2', 'src3') AS reviewed, count(*) AS n, sum(CASE WHEN said_a = said_b THEN 1 ELSE 0 END) AS agree FROM v_pairs p JOIN documents d ON d.doc_id = p.case_id GROUP BY ALL) SELECT qid, reviewed, n, CAST(agree AS BIGINT) AS agree, round(100.0 * agree / n, 6) AS pct FROM c""")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two annotations by question and by where the case comes from."""
    origin = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("source").isin("src1", "src2", "src3").alias("reviewed"))
    pairs = pairing.paired(decisions(spark, sf_dir), 0, 1).join(origin, "case_id")
    return pairs.groupBy("qid", "reviewed").agg(F.count("*").alias("n"), F.count_if(F.col("said_a") == F.col("said_b")).alias("agree")).select("*", rounded(100.0 * F.col("agree") / F.col("n")).alias("pct"))


@query(VIEWS + """, o AS (SELECT phase, case_id, max(CASE WHEN run = 0 THEN 1 END) AS had, max(CASE WHEN run = 0 THEN cost END) AS before, max(CASE WHEN run = 1 THEN cost END) AS now FROM v_records GROUP BY ALL)
SELECT phase, CAST(sum(CASE WHEN before IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS captured, CAST(sum(CASE WHEN before IS NULL AND now IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS accredited, CAST(sum(CASE WHEN before IS NULL AND now IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS still_unknown FROM o GROUP BY phase""")
def unknown_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose cost was unknown when they were replaced (run 0 by run 1): captured before, and accredited if the new one is known."""
    cost = lambda r: F.max(F.when(F.col("run") == r, F.col("cost")))
    rows = tables.records(spark, sf_dir).groupBy("phase", "case_id").agg(cost(0).alias("before"), cost(1).alias("now")).where("before IS NULL")
    known = F.col("now").isNotNull()
    counts = rows.groupBy("phase").agg(F.count("*").alias("captured"), F.count_if(known).alias("accredited"), F.count_if(~known).alias("still_unknown"))
    phases = tables.cases(spark, sf_dir).select("phase").distinct()
    return phases.join(counts, "phase", "left").na.fill(0)


@query(VIEWS + """, s AS (SELECT run, phase, max(cost) AS highest, sum(cost) AS spent FROM v_records GROUP BY ALL), k AS (SELECT *, CASE WHEN highest > CAST(0.000048 AS DOUBLE) THEN 'case_cap' WHEN spent > CAST(0.002 AS DOUBLE) THEN 'total_cap' END AS stop FROM s)
SELECT run, phase, stop, stop IS NOT NULL AND NOT (run = 1 AND phase = 'en') AS open, bool_or(stop IS NOT NULL AND NOT (run = 1 AND phase = 'en')) OVER (PARTITION BY run) AS blocked FROM k""")
def open_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops by a case's cost or a phase's total; a stop stays open until an amendment names it (here run 1, 'en'), and an open
    stop blocks its whole run."""
    sums = tables.records(spark, sf_dir).groupBy("run", "phase").agg(F.max("cost").alias("highest"), F.sum("cost").alias("spent"))
    stops = sums.withColumn("stop", F.when(F.col("highest") > 0.000048, "case_cap").when(F.col("spent") > 0.002, "total_cap"))
    amended = spark.createDataFrame([(1, "en", True)], "run int, phase string, amended boolean")
    opened = stops.join(F.broadcast(amended), ["run", "phase"], "left").withColumn("open", F.col("stop").isNotNull() & ~F.coalesce("amended", F.lit(False)))
    blocked = opened.groupBy("run").agg(F.bool_or("open").alias("blocked"))
    return opened.join(F.broadcast(blocked), "run").select("run", "phase", "stop", "open", "blocked")


_DRAW = "CAST(('0x' || substr(md5('9:' || doc_id || ':{k}'), 1, 13)) AS BIGINT) / 4503599627370496.0"


@query(f"""WITH u AS (SELECT doc_id, {_DRAW.format(k="urgency")} AS u, {_DRAW.format(k="department")} AS d, {_DRAW.format(k="hostile")} AS h FROM documents),
s AS (SELECT doc_id, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.85 THEN 1 ELSE 2 END AS urgency, CASE WHEN d < 0.4 THEN 'admin' WHEN d < 0.7 THEN 'billing' ELSE 'clinic' END AS department, h < 0.15 AS hostile FROM u)
SELECT doc_id, urgency, department, hostile, department = 'clinic' OR urgency = 2 AS clinical, urgency = 2 AND department = 'clinic' AS same_day FROM s""")
def label_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels drawn with given weights, kept coherent: dependent labels follow from the drawn ones."""
    draw = lambda k: hashed_uniform(F.lit(9), F.col("doc_id"), F.lit(k))
    drawn = read(spark, sf_dir, "documents").select("doc_id", draw("urgency").alias("u"), draw("department").alias("d"), draw("hostile").alias("h"))
    labels = drawn.select("doc_id", F.when(F.col("u") < 0.5, 0).when(F.col("u") < 0.85, 1).otherwise(2).alias("urgency"), F.when(F.col("d") < 0.4, "admin").when(F.col("d") < 0.7, "billing").otherwise("clinic").alias("department"), (F.col("h") < 0.15).alias("hostile"))
    clinic, urgent = F.col("department") == "clinic", F.col("urgency") == 2
    return labels.select("*", (clinic | urgent).alias("clinical"), (clinic & urgent).alias("same_day"))


@query(_GRAMS + "SELECT b.item_id % 4 AS part, count(DISTINCT b.item_id) AS items, count(DISTINCT bt.gram) AS grams, count(DISTINCT b.item_id) FILTER (bt.gram IS NULL) = 0 AS covered FROM b LEFT JOIN (SELECT DISTINCT item_id, gram FROM bt WHERE gram IS NOT NULL) bt USING (item_id) GROUP BY 1")
def bank_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and grams of each part of an exclusion bank, and whether each of its texts has any: a gap must stop the run."""
    from adjudica.functions.text import grams
    from adjudica.operators.curation import token_table

    words = token_table(read(spark, sf_dir, "benchmark"), "item_id", "text")
    each = words.select("item_id", F.explode_outer(F.array_distinct(grams(F.col("words")))).alias("gram"))
    return each.groupBy((F.col("item_id") % 4).alias("part")).agg(F.countDistinct("item_id").alias("items"), F.countDistinct("gram").alias("grams"), (F.count_if(F.col("gram").isNull()) == 0).alias("covered"))


def require_sources(found: DataFrame, expected: list[str], name: str = "source") -> DataFrame:
    """``found`` if it has rows of every expected source; else an error that names those that are missing."""
    there = {r[0] for r in found.where(F.col(name).isin(expected)).select(name).distinct().collect()}  # at most the expected
    if missing := sorted(set(expected) - there):
        raise ValueError(f"no rows of {', '.join(missing)}")
    return found


@query("""WITH p AS (SELECT source, lang, doc_id, sha256(text) AS sha FROM documents), b AS (SELECT source, lang = 'en' AS restricted, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha, 1, 12)) AS BIGINT)) AS VARCHAR) AS mark FROM p GROUP BY ALL)
SELECT source || '/' || CASE WHEN restricted THEN 'nc' ELSE 'open' END AS bucket, n, mark FROM b""")
def final_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each output bucket and a mark of their contents that no order changes; every expected source must be there."""
    docs = require_sources(read(spark, sf_dir, "documents").select("source", "lang", F.sha2("text", 256).alias("sha")), ["src0", "src1", "src2"])
    part = F.conv(F.substring("sha", 1, 12), 16, 10).cast("decimal(38,0)")
    counts = docs.groupBy("source", (F.col("lang") == "en").alias("restricted")).agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("mark"))
    return counts.select(F.concat("source", F.lit("/"), F.when(F.col("restricted"), "nc").otherwise("open")).alias("bucket"), "n", "mark")


@query("SELECT lang, count(*) AS n, CAST(sum(CASE WHEN lang = 'en' AND length(trim(text)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS usable FROM documents GROUP BY lang")
def usable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the one wanted language that aren't empty."""
    usable = (F.col("lang") == "en") & (F.length(F.trim("text")) > 0)
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(usable).alias("usable"))


#: The phases, the question set that each asks, and whether its labels carry hidden fields that are stripped.
CATALOGUE = {"triage": ("triage", False), "papers": ("papers", False), "ood": ("ood", False), **{f"adv{k}": ("triage", True) for k in ("", 2, 3, 4, 5)}, "triage_en": ("triage", False), "papers_full": ("papers", False), "ood_en": ("ood", False)}
_CATALOGUE = ", ".join(f"({k}, '{name}', '{questions}', {str(hidden).upper()})" for k, (name, (questions, hidden)) in enumerate(CATALOGUE.items()))


@query(f"""WITH c(k, phase, questions, hidden) AS (VALUES {_CATALOGUE}) SELECT d.doc_id AS case_id, c.phase, c.questions, CASE WHEN hidden THEN '{{"quality":' || l.quality || '}}' ELSE '{{"quality":' || l.quality || ',"family":"' || d.source || '","rule_target":' || l.toxic || '}}' END AS gt FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN c ON c.k = l.doc_id % 11""")
def phase_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of eleven phases with the question set each phase asks; hidden fields are stripped from adversarial labels.  An
    unknown phase has no catalogue entry and gives no row."""
    entries = spark.createDataFrame([(k, name, questions, hidden) for k, (name, (questions, hidden)) in enumerate(CATALOGUE.items())], "k int, phase string, questions string, hidden boolean")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    rows = read(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("k", (F.col("doc_id") % 11).cast("int")).join(F.broadcast(entries), "k")
    labels = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("family"), F.concat(F.lit('"'), "source", F.lit('"')), F.lit("rule_target"), F.col("toxic").cast("string"))
    shown = F.when(F.col("hidden"), F.map_filter(labels, lambda k, v: ~k.isin("state", "family", "rule_target"))).otherwise(labels)
    fields = F.transform(F.map_entries(shown), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return rows.select(F.col("doc_id").alias("case_id"), "phase", "questions", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("gt"))


@query("SELECT n_nationkey AS qid, split_part(raw, ':', 1) AS label, trim(substr(raw, strpos(raw, ':') + 1)) AS description, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS level FROM (SELECT n_nationkey, n_regionkey, n_name || ': in ' || r_name || ': a region' AS raw FROM nation JOIN region ON r_regionkey = n_regionkey)")
def wire_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options as they go over the wire, 'label: description' split at the first colon, each with its level in its question."""
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    raw = F.concat("n_name", F.lit(": in "), "r_name", F.lit(": a region"))
    asked = read(spark, sf_dir, "nation").join(F.broadcast(regions), "n_regionkey").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", raw.alias("raw")))).alias("o"))
    each = asked.select(F.posexplode("o").alias("level", "o")).withColumn("part", F.split("o.raw", ":", 2))
    return each.select(F.col("o.n_nationkey").alias("qid"), F.col("part")[0].alias("label"), F.trim(F.col("part")[1]).alias("description"), "level")
