"""Comparisons of the derived runs with each other and with the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adjudica.functions.answers import decision_label, rounded
from adjudica.functions.intervals import clopper_pearson, newcombe, wilson
from adjudica.operators import pairing as op
from adjudica.operators.convolution import at_least, sums_of_trials
from adjudica.operators.ranking import holm, order_statistics, spearman
from adjudica.plans.decisions import choices, decisions
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import VIEWS

SAID = VIEWS + """, v_said AS (SELECT run, phase, case_id, qid, gt, point = 1 AS hit, CASE qtype WHEN 'choice' THEN label WHEN 'noul' THEN CASE WHEN value >= CAST(0.5 AS DOUBLE) THEN '1' ELSE '0' END
  ELSE CAST(CAST(least(2, greatest(0, round_even(value, 0))) AS INT) AS VARCHAR) END AS said FROM v_points WHERE NOT err AND NOT refused),
v_pairs AS (SELECT phase, case_id, qid, a.gt, a.said AS said_a, b.said AS said_b, a.hit AS hit_a, b.hit AS hit_b FROM (SELECT * FROM v_said WHERE run = 0) a JOIN (SELECT * FROM v_said WHERE run = 1) b USING (phase, case_id, qid)),
v_cells AS (SELECT phase, qid, count(*) AS n, CAST(sum(CASE WHEN hit_a AND NOT hit_b THEN 1 ELSE 0 END) AS BIGINT) AS only_ref, CAST(sum(CASE WHEN hit_b AND NOT hit_a THEN 1 ELSE 0 END) AS BIGINT) AS only_run FROM v_pairs GROUP BY phase, qid),
v_mcnemar AS (SELECT *, CASE WHEN only_ref + only_run = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(only_ref, only_run) + 1), lambda i: exp(lgamma(only_ref + only_run + 1) - lgamma(i + 1) - lgamma(only_ref + only_run - i + 1) - (only_ref + only_run) * ln(2))))) END AS p FROM v_cells)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.paired(decisions(spark, sf_dir), 0, 1)


@query(SAID + """, k AS (SELECT qid, count(*) AS n, sum(CASE WHEN said_a = said_b THEN 1 ELSE 0 END) AS k FROM v_pairs GROUP BY qid)
SELECT qid, n, CAST(k AS BIGINT) AS agree, round(100.0 * k / n, 6) AS pct, round(((k/n) + 3.841458881296/(2*n) - 1.959964 * sqrt((k/n)*(1-k/n)/n + 3.841458881296/(4.0*n*n))) / (1 + 3.841458881296/n), 6) AS low,
 round(((k/n) + 3.841458881296/(2*n) + 1.959964 * sqrt((k/n)*(1-k/n)/n + 3.841458881296/(4.0*n*n))) / (1 + 3.841458881296/n), 6) AS high FROM k""")
def paired_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.count_if(F.col("said_a") == F.col("said_b"))
    counts = _pairs(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"), same.alias("agree"))
    low, high = wilson(F.col("agree"), F.col("n"))
    return counts.select("qid", "n", "agree", rounded(100.0 * F.col("agree") / F.col("n")).alias("pct"), rounded(low).alias("low"), rounded(high).alias("high"))


@query(SAID + "SELECT phase, qid, n, only_ref, only_run, round(p, 9) AS p FROM v_mcnemar")
def mcnemar_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.discordance(_pairs(spark, sf_dir), ["phase", "qid"]).withColumn("p", F.round("p", 9))


@query(SAID + """, fam AS (SELECT DISTINCT phase, qid FROM v_decisions UNION ALL SELECT 'none', 'quality'), f AS (SELECT phase, qid, coalesce(p, 1) AS p0, p FROM fam LEFT JOIN v_mcnemar USING (phase, qid)),
s AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p0, phase, qid) + 1) * p0) AS s FROM f)
SELECT phase, qid, round(p, 9) AS p, round(max(s) OVER (ORDER BY p0, phase, qid ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s""")
def mcnemar_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family is the planned cells: one that has no pair (here phase 'none') keeps its place with p = 1."""
    planned = decisions(spark, sf_dir).select("phase", "qid").distinct().unionByName(spark.createDataFrame([("none", "quality")], "phase string, qid string"))
    cells = planned.join(op.discordance(_pairs(spark, sf_dir), ["phase", "qid"]).select("phase", "qid", "p"), ["phase", "qid"], "left").withColumn("family", F.lit(1))
    return holm(cells, ["family"], "p", ["phase", "qid"]).select("phase", "qid", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query(VIEWS + """, a AS (SELECT * FROM v_probs WHERE run = 0 AND NOT err), b AS (SELECT * FROM v_probs WHERE run = 1 AND NOT err)
SELECT phase, count(*) AS n, round(avg(abs(a.p - b.p)), 6) AS mean_abs, round(max(abs(a.p - b.p)), 6) AS max_abs, CAST(sum(CASE WHEN abs(a.p - b.p) > CAST(0.001 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_moved FROM a JOIN b USING (phase, case_id, opt) GROUP BY phase""")
def delta_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.option_shift(tables.options(spark, sf_dir), 0, 1, ["phase"]).withColumns({"mean_abs": rounded(F.col("mean_abs")), "max_abs": rounded(F.col("max_abs"))})


_KAPPA = """, t AS (SELECT run, gt AS x, said AS y, count(*) AS c FROM v_said WHERE qid = '{qid}' GROUP BY ALL), n AS (SELECT run, sum(c) AS n FROM t GROUP BY run), r AS (SELECT run, x, sum(c) AS cx FROM t GROUP BY ALL), s AS (SELECT run, y, sum(c) AS cy FROM t GROUP BY ALL),
o AS (SELECT run, sum({w} * c) AS o FROM t GROUP BY run), e AS (SELECT run, sum({w} * cx * cy) AS e FROM r JOIN s USING (run) GROUP BY run)
SELECT run, CAST(n AS BIGINT) AS n, round(CASE WHEN e = 0 THEN 1 ELSE 1 - CAST(o AS DOUBLE) * n / e END, 6) AS kappa FROM n JOIN o USING (run) JOIN e USING (run)"""


def _said(spark: SparkSession, sf_dir: str, qid: str) -> DataFrame:
    made = decisions(spark, sf_dir).where((F.col("qid") == qid) & ~F.col("err") & ~F.col("refused"))
    return made.select("run", "gt", decision_label(F.col("qtype"), F.col("label"), F.col("value")).alias("said"))


@query(SAID + _KAPPA.format(qid="language", w="(CASE WHEN x <> y THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"))
def kappa_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.kappa(_said(spark, sf_dir, "language"), ["run"], "gt", "said").withColumn("kappa", rounded(F.col("kappa")))


@query(SAID + _KAPPA.format(qid="length", w="(CAST(abs(CAST(x AS INT) - CAST(y AS INT)) AS DOUBLE) / 2)"))
def kappa_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.kappa(_said(spark, sf_dir, "length"), ["run"], "gt", "said", ordinal=True).withColumn("kappa", rounded(F.col("kappa")))


_VOTES = """, c AS (SELECT phase, case_id, qid, gt, said, count(*) AS c, min(run) AS first FROM v_said GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY phase, case_id, qid ORDER BY c DESC, first) AS rn, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY phase, case_id, qid) AS share FROM c)
"""


@query(SAID + _VOTES + "SELECT case_id, qid, gt, said AS modal, round(share, 6) AS share FROM v WHERE rn = 1 AND (said <> gt OR share < CAST(0.6 AS DOUBLE))")
def disputed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    disputed = op.votes(decisions(spark, sf_dir)).where((F.col("modal") != F.col("gt")) | (F.col("share") < 0.6))
    return disputed.select("case_id", "qid", "gt", "modal", rounded(F.col("share")).alias("share"))


@query(VIEWS + """, r AS (SELECT run, rank() OVER (PARTITION BY run ORDER BY value) + (count(*) OVER (PARTITION BY run, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY run ORDER BY gt) + (count(*) OVER (PARTITION BY run, gt) - 1) / 2.0 AS ry FROM v_score WHERE NOT err)
SELECT run, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY run""")
def spearman_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman(tables.ordinal(spark, sf_dir).where("NOT err").select("run", "value", "gt"), ["run"], "value", "gt").withColumn("rho", rounded(F.col("rho")))


#: A case's reading depth: what it should be, and what the three answers say once it isn't skipped.
_DEPTH = """, d AS (SELECT s.run, s.case_id, s.value AS rel, CASE s.gt WHEN 0 THEN 'skip' WHEN 1 THEN 'abstract' ELSE 'full' END AS truth,
  CASE WHEN c.label = 'en' AND b.value >= CAST(0.5 AS DOUBLE) THEN 'full' ELSE 'abstract' END AS deep FROM v_score s JOIN v_choice c USING (run, case_id) JOIN v_binary b USING (run, case_id) WHERE b.qid = 'quality' AND NOT s.err)"""


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = tables.ordinal(spark, sf_dir).where("NOT err").select("run", "case_id", F.col("value").alias("rel"), F.when(F.col("gt") == 0, "skip").when(F.col("gt") == 1, "abstract").otherwise("full").alias("truth"))
    practice = tables.binary(spark, sf_dir).where("qid = 'quality'").select("run", "case_id", F.col("value").alias("practice"))
    rows = score.join(choices(spark, sf_dir).select("run", "case_id", "label"), ["run", "case_id"]).join(practice, ["run", "case_id"])
    return rows.select("run", "case_id", "rel", "truth", F.when((F.col("label") == "en") & (F.col("practice") >= 0.5), "full").otherwise("abstract").alias("deep"))


@query(VIEWS + _DEPTH + ", o AS (SELECT run, truth, CASE WHEN rel < CAST(0.7 AS DOUBLE) THEN 'skip' ELSE deep END AS depth FROM d) SELECT run, truth, depth, count(*) AS n FROM o GROUP BY ALL")
def depth_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.when(F.col("rel") < 0.7, "skip").otherwise(F.col("deep"))
    return _depth(spark, sf_dir).groupBy("run", "truth", depth.alias("depth")).agg(F.count("*").alias("n"))


def cuts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, t, ok): right decisions at each candidate threshold: 0, midpoints of neighbouring values, 2.

    ``rows`` has rel, skip_ok and deep_ok (right if skipped, right if not) and c, the cases of that value.  Running sums over
    the different values take the place of a cross join of cases and thresholds.
    """
    order = Window.partitionBy(*by).orderBy("rel")
    whole = Window.partitionBy(*by)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(*by, "rel", "c", F.sum("skip_ok").over(upto).alias("skipped"), (F.sum("deep_ok").over(whole) - F.sum("deep_ok").over(upto)).alias("kept"), F.lead("rel").over(order).alias("next"), F.sum("deep_ok").over(whole).alias("all_deep"), F.row_number().over(order).alias("rn"), "skip_ok", "deep_ok")
    before = F.col("skipped") - F.col("skip_ok") + F.col("kept") + F.col("deep_ok")
    after = F.col("skipped") + F.col("kept")
    found = F.array(
        F.struct(F.when(F.col("rn") == 1, F.lit(0.0)).alias("t"), F.col("all_deep").alias("ok")),
        F.struct(F.when(F.col("c") > 1, F.col("rel")).alias("t"), before.alias("ok")),
        F.struct(((F.col("rel") + F.col("next")) / 2).alias("t"), after.alias("ok")),
        F.struct(F.when(F.col("next").isNull(), F.lit(2.0)).alias("t"), F.when(F.col("rel") < 2, after).otherwise(before).alias("ok")),
    )
    return summed.select(*by, F.explode(found).alias("x")).select(*by, "x.t", "x.ok").where("t IS NOT NULL")


def _folded(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "rel").agg(F.count("*").alias("c"), F.count_if(F.col("truth") == "skip").alias("skip_ok"), F.count_if(F.col("truth") == F.col("deep")).alias("deep_ok"))


@query(VIEWS + _DEPTH + """, c AS (SELECT run, (rel + lead(rel) OVER (PARTITION BY run ORDER BY rel)) / 2 AS t FROM d UNION ALL SELECT DISTINCT run, 0 FROM d UNION ALL SELECT DISTINCT run, 2 FROM d),
o AS (SELECT c.run, c.t, sum(CASE WHEN (CASE WHEN rel < c.t THEN 'skip' ELSE deep END) = truth THEN 1 ELSE 0 END) AS ok FROM (SELECT DISTINCT run, t FROM c WHERE t IS NOT NULL) c JOIN d USING (run) GROUP BY ALL)
SELECT run, round(t, 6) AS t, CAST(ok AS BIGINT) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ok DESC, t) AS rn FROM o) WHERE rn = 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cuts(_folded(_depth(spark, sf_dir), ["run"]), ["run"])
    return found.groupBy("run").agg(F.max(F.struct("ok", (-F.col("t")).alias("t"))).alias("best")).select("run", rounded(-F.col("best.t")).alias("t"), F.col("best.ok").alias("ok"))


def leave_one_out(rows: DataFrame) -> DataFrame:
    """(run, n, loo, n_skip, skip_recall): each case decided by the best threshold of the others.

    Without a case, thresholds up to its value lose its decision if it isn't skipped, those above it its decision if it is.
    So the best of each side, known for every value from maxima of the values before and after it, less the case's own,
    gives its best threshold; the candidates next to the value are looked at apart, as they may leave with the case.  The
    work is that of the different values, and cases of equal value, truth and answer are counted together.
    """
    order = Window.partitionBy("run").orderBy("rel")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("run")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    all_deep, skipped = F.sum("deep_ok").over(whole), F.sum("skip_ok").over(upto)
    v = _folded(rows, ["run"]).select("*", F.lag("rel").over(order).alias("prev"), F.lead("rel").over(order).alias("next"), (skipped - F.col("skip_ok") + all_deep - F.sum("deep_ok").over(upto) + F.col("deep_ok")).alias("low"), (skipped + all_deep - F.sum("deep_ok").over(upto)).alias("high"), all_deep.alias("all_deep"), F.sum("c").over(whole).alias("n"))
    at = lambda ok, t: F.struct(ok.cast("long").alias("ok"), (-t).alias("t"))
    own = F.when(F.col("c") > 1, at(F.col("low"), F.col("rel")))
    mid_before, mid_after = F.when(F.col("prev").isNotNull(), at(F.col("low"), (F.col("prev") + F.col("rel")) / 2)), F.when(F.col("next").isNotNull(), at(F.col("high"), (F.col("rel") + F.col("next")) / 2))
    top = F.max_by(F.when(F.col("rel") < 2, F.col("high")).otherwise(F.col("low")), "rel").over(whole)
    zero, two = at(F.col("all_deep"), F.lit(0.0)), at(top, F.lit(2.0))
    sides = v.select("*", F.greatest(own, mid_before).alias("a"), F.greatest(own, mid_after).alias("b"), own.alias("own"), mid_before.alias("mid_before"), mid_after.alias("mid_after"), zero.alias("zero"), two.alias("two"))
    sides = sides.select("*", F.greatest(F.max("a").over(before), "zero").alias("left"), F.max("b").over(after).alias("right"))
    cases = rows.groupBy("run", "rel", (F.col("truth") == "skip").cast("int").alias("s"), (F.col("truth") == F.col("deep")).cast("int").alias("d")).agg(F.count("*").alias("cases"))
    met = cases.join(sides, ["run", "rel"]).where("n > 1")
    less = lambda x, by: F.when(x.isNotNull(), F.struct((x["ok"] - F.col(by)).alias("ok"), x["t"].alias("t")))
    fused = F.when((F.col("c") == 1) & F.col("prev").isNotNull() & F.col("next").isNotNull(), at(F.col("low") - F.col("deep_ok"), (F.col("prev") + F.col("next")) / 2))
    lower = F.greatest(F.col("left"), F.when(F.col("c") > 1, F.col("mid_before")), F.when(F.col("c") > 2, F.col("own")), F.when(F.col("rel") >= 2, F.col("two")))
    upper = F.greatest(F.col("right"), F.when(F.col("c") > 1, F.col("mid_after")), F.when(F.col("rel") < 2, F.col("two")))
    best = met.withColumn("t", -F.greatest(less(lower, "d"), less(upper, "s"), fused)["t"])
    right = F.when(F.col("rel") < F.col("t"), F.col("s")).otherwise(F.col("d"))
    return best.groupBy("run").agg(F.sum("cases").alias("n"), F.sum(F.col("cases") * right).alias("loo"), F.sum(F.col("cases") * F.col("s")).alias("n_skip"), F.sum(F.col("cases") * F.col("s") * right).alias("skip_recall"))


@query(VIEWS + _DEPTH + """, o AS (SELECT a.run, a.case_id AS out_id, b.rel, b.truth, b.deep FROM d a JOIN d b ON a.run = b.run AND a.case_id <> b.case_id),
c AS (SELECT run, out_id, (rel + lead(rel) OVER (PARTITION BY run, out_id ORDER BY rel)) / 2 AS t FROM o UNION ALL SELECT DISTINCT run, out_id, 0 FROM o UNION ALL SELECT DISTINCT run, out_id, 2 FROM o),
f AS (SELECT run, out_id, rel, sum(CASE WHEN truth = 'skip' THEN 1 ELSE 0 END) AS s, sum(CASE WHEN truth = deep THEN 1 ELSE 0 END) AS p FROM o GROUP BY ALL),
k AS (SELECT c.run, c.out_id, c.t, sum(CASE WHEN f.rel < c.t THEN f.s ELSE f.p END) AS ok FROM (SELECT DISTINCT run, out_id, t FROM c WHERE t IS NOT NULL) c JOIN f USING (run, out_id) GROUP BY ALL),
b AS (SELECT run, out_id AS case_id, t FROM (SELECT *, row_number() OVER (PARTITION BY run, out_id ORDER BY ok DESC, t) AS rn FROM k) WHERE rn = 1),
m AS (SELECT d.run, d.truth, CASE WHEN d.rel < b.t THEN 'skip' ELSE d.deep END = d.truth AS hit FROM d JOIN b USING (run, case_id))
SELECT run, count(*) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS loo, CAST(sum(CASE WHEN truth = 'skip' THEN 1 ELSE 0 END) AS BIGINT) AS n_skip, CAST(sum(CASE WHEN truth = 'skip' AND hit THEN 1 ELSE 0 END) AS BIGINT) AS skip_recall FROM m GROUP BY run""")
def loo_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leave_one_out(_depth(spark, sf_dir))


@query(VIEWS + "SELECT run, CAST(sum(CASE WHEN gt = 0 THEN 1 ELSE 0 END) AS BIGINT) AS found FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value, case_id) AS rn FROM v_binary WHERE qid = 'quality' AND NOT err) WHERE rn <= 10 GROUP BY run")
def bottom_k_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten lowest scores are of label 0."""
    lowest = op.lowest(tables.binary(spark, sf_dir).where("qid = 'quality' AND NOT err"), "run", ["value", "case_id"], 10)
    return lowest.groupBy("run").agg(F.count_if(F.col("gt") == 0).alias("found"))


@query(VIEWS + ", a AS (SELECT case_id FROM v_records WHERE run = 0 AND err), b AS (SELECT case_id FROM v_records WHERE run = 1 AND err) SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.case_id IS NOT NULL AND b.case_id IS NOT NULL THEN 'both' WHEN a.case_id IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS side FROM a FULL JOIN b ON a.case_id = b.case_id")
def rejections_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = tables.records(spark, sf_dir).where("err")
    a, b = failed.where("run = 0").select(F.col("case_id").alias("a")), failed.where("run = 1").select(F.col("case_id").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("case_id"), op.presence(F.col("a"), F.col("b")).alias("side"))


@query(SAID + """, k AS (SELECT qid, CAST(sum(CASE WHEN hit_a AND hit_b THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN hit_a AND NOT hit_b THEN 1 ELSE 0 END) AS DOUBLE) AS b, CAST(sum(CASE WHEN hit_b AND NOT hit_a THEN 1 ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE WHEN NOT hit_b AND NOT hit_a THEN 1 ELSE 0 END) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS n FROM v_pairs GROUP BY qid),
w AS (SELECT *, (a+b)/n AS p1, (a+c)/n AS p2, 3.841458881296 AS z2, 1.959964 AS z FROM k),
i AS (SELECT *, (p1 + z2/(2*n) - z*sqrt(p1*(1-p1)/n + z2/(4*n*n)))/(1+z2/n) AS l1, (p1 + z2/(2*n) + z*sqrt(p1*(1-p1)/n + z2/(4*n*n)))/(1+z2/n) AS u1, (p2 + z2/(2*n) - z*sqrt(p2*(1-p2)/n + z2/(4*n*n)))/(1+z2/n) AS l2, (p2 + z2/(2*n) + z*sqrt(p2*(1-p2)/n + z2/(4*n*n)))/(1+z2/n) AS u2,
 CASE WHEN (a+b)*(c+d)*(a+c)*(b+d) > 0 THEN greatest(0, (a*d - b*c - n/2)/sqrt((a+b)*(c+d)*(a+c)*(b+d))) ELSE 0 END AS psi FROM w)
SELECT qid, round(p1-p2, 6) AS delta, round(p1 - p2 - sqrt(greatest(0, (p1-l1)*(p1-l1) + (u2-p2)*(u2-p2) - 2*psi*(p1-l1)*(u2-p2))), 6) AS low, round(p1 - p2 + sqrt(greatest(0, (u1-p1)*(u1-p1) + (p2-l2)*(p2-l2) - 2*psi*(u1-p1)*(p2-l2))), 6) AS high FROM i""")
def newcombe_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("hit_a"), F.col("hit_b")
    counts = _pairs(spark, sf_dir).groupBy("qid").agg(F.count_if(a & b).alias("a"), F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count_if(~a & ~b).alias("d"))
    delta, low, high = newcombe(*(F.col(x) for x in "abcd"))
    return counts.select("qid", rounded(delta).alias("delta"), rounded(low).alias("low"), rounded(high).alias("high"))


#: Limits by halving an interval: the p at which k or more of n has the chance 0.025, k hits or misses.
LIMITS = """, l(id, k, n, low, high, step) AS (SELECT id, k, n, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), 0 FROM asked WHERE k > 0 UNION ALL
SELECT id, k, n, CASE WHEN tail < CAST(0.025 AS DOUBLE) THEN (low + high) / 2 ELSE low END, CASE WHEN tail < CAST(0.025 AS DOUBLE) THEN high ELSE (low + high) / 2 END, step + 1 FROM (
SELECT *, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((low + high) / 2) + (n - i) * ln(1 - (low + high) / 2)))) AS tail FROM l WHERE step < 45)),
limits AS (SELECT asked.id, coalesce((l.low + l.high) / 2, 0) AS p FROM asked LEFT JOIN l ON l.id = asked.id AND l.step = 45)
"""


@query(SAID.replace("WITH", "WITH RECURSIVE", 1) + """, k AS (SELECT phase, qid, count(*) AS n, CAST(sum(CASE WHEN said_a = said_b THEN 1 ELSE 0 END) AS BIGINT) AS agree FROM v_pairs GROUP BY ALL),
asked AS (SELECT phase || qid || 'low' AS id, agree AS k, n FROM k UNION ALL SELECT phase || qid || 'high', n - agree, n FROM k)""" + LIMITS + """SELECT phase, qid, n, agree, round(a.p, 6) AS low, round(1 - b.p, 6) AS high FROM k JOIN limits a ON a.id = phase || qid || 'low' JOIN limits b ON b.id = phase || qid || 'high'""")
def clopper_pearson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.count_if(F.col("said_a") == F.col("said_b"))
    counts = _pairs(spark, sf_dir).groupBy("phase", "qid").agg(F.count("*").alias("n"), same.alias("agree"))
    return counts.withColumn("ci", clopper_pearson("agree", "n")).select("phase", "qid", "n", "agree", rounded(F.col("ci.low")).alias("low"), rounded(F.col("ci.high")).alias("high"))


@query(VIEWS.replace("WITH", "WITH RECURSIVE", 1) + """, a AS (SELECT run, phase, value, gt, row_number() OVER (PARTITION BY run, phase ORDER BY case_id) AS i FROM v_binary WHERE qid = 'toxic' AND NOT err),
m(run, phase, i, mass) AS (SELECT DISTINCT run, phase, CAST(0 AS BIGINT), [CAST(1 AS DOUBLE)] FROM a UNION ALL
SELECT m.run, m.phase, a.i, list_transform(range(1, len(mass) + 2), lambda j: coalesce(mass[j], 0) * (1 - value) + CASE WHEN j > 1 THEN mass[j - 1] * value ELSE 0 END) FROM m JOIN a ON a.run = m.run AND a.phase = m.phase AND a.i = m.i + 1),
k AS (SELECT run, phase, CAST(sum(gt) AS BIGINT) AS k, max(i) AS i FROM a GROUP BY ALL) SELECT run, phase, k, round(least(1, list_sum(mass[k + 1:])), 6) AS p FROM m JOIN k USING (run, phase, i)""")
def poisson_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of as many toxic labels or more as there are, if each answer's probability were right."""
    answers = tables.binary(spark, sf_dir).where("qid = 'toxic' AND NOT err")
    seen = answers.groupBy("run", "phase").agg(F.sum("gt").alias("k"))
    sums = sums_of_trials(answers, ["run", "phase"], "value").join(seen, ["run", "phase"])
    return sums.select("run", "phase", "k", rounded(at_least(F.col("low"), F.col("mass"), F.col("k"))).alias("p"))


@query(VIEWS + """, o AS (SELECT run, ms, row_number() OVER (PARTITION BY run ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY run) AS n FROM v_records WHERE NOT err)
SELECT run, CAST(max(n) AS BIGINT) AS n, max(CASE WHEN k = n // 2 THEN ms END) AS median_upper, max(CASE WHEN k = CAST(ceil(CAST(0.95 AS DOUBLE) * n) AS BIGINT) - 1 THEN ms END) AS p95_ceil, max(CASE WHEN k = CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT) - 1 THEN ms END) AS p95_floor, round(median(ms), 6) AS median_true, round(avg(ms), 6) AS mean FROM o GROUP BY run""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = tables.records(spark, sf_dir).where("NOT err")
    n = F.col("n")
    at = {"median_upper": F.floor(n / 2), "p95_ceil": F.ceil(F.lit(0.95) * n) - 1, "p95_floor": F.floor(F.lit(0.95) * n) - 1}
    rest = ok.groupBy("run").agg(rounded(F.percentile("ms", 0.5)).alias("median_true"), rounded(F.avg("ms")).alias("mean"))
    return order_statistics(ok, ["run"], "ms", at).join(rest, "run")
