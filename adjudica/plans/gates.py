"""Gates and families: what a run may be judged on, and the planned tests of several comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import rounded
from adjudica.functions.intervals import clopper_pearson, newcombe
from adjudica.operators import pairing
from adjudica.operators.ranking import holm
from adjudica.plans.comparison import LIMITS, SAID
from adjudica.plans.decisions import choices, decisions
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import OPTIONS, VIEWS, read


def first_reason(reasons: dict[str, Column], otherwise: str) -> Column:
    """The name of the first reason that holds, in the order given."""
    found = None
    for name, holds in reasons.items():
        found = F.when(holds, name) if found is None else found.when(holds, name)
    return found.otherwise(otherwise)


@query(VIEWS + """, c AS (SELECT run, phase, sum(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) AS unknown, sum(CASE WHEN err THEN 1 ELSE 0 END) AS errors, count(*) AS n, max(ms) AS slowest FROM v_records GROUP BY run, phase)
SELECT run, phase, CASE WHEN slowest > 995 THEN 'slow' WHEN unknown * 6 > n THEN 'unknown_cost' WHEN errors * 30 > n THEN 'errors' ELSE 'evaluable' END AS note FROM c""")
def evaluability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's verdict is masked by the first gate that it fails."""
    cells = tables.records(spark, sf_dir).groupBy("run", "phase").agg(F.count_if(F.col("cost").isNull()).alias("unknown"), F.count_if("err").alias("errors"), F.count("*").alias("n"), F.max("ms").alias("slowest"))
    note = first_reason({"slow": F.col("slowest") > 995, "unknown_cost": F.col("unknown") * 6 > F.col("n"), "errors": F.col("errors") * 30 > F.col("n")}, "evaluable")
    return cells.select("run", "phase", note.alias("note"))


@query("""WITH m AS (SELECT source, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN source IN ('src5', 'src6') AND doc_id % 3 = 0 THEN 'b' ELSE 'a' END AS version, doc_id % 997 = 1 AS stopped FROM documents)
SELECT source AS run, bool_or(stopped) AS cost_stop, count(DISTINCT version) > 1 AS version_drift, bool_or(version IS NULL) AND source NOT IN ('src1', 'src2') AS no_provenance FROM m GROUP BY source""")
def acquisition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops, drift and missing versions; listed historical runs (src1, src2) need no provenance."""
    version = F.when(F.col("doc_id") % 13 == 0, F.lit(None)).when(F.col("source").isin("src5", "src6") & (F.col("doc_id") % 3 == 0), "b").otherwise("a")
    runs = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("run")).agg(F.bool_or(F.col("doc_id") % 997 == 1).alias("cost_stop"), (F.countDistinct(version) > 1).alias("version_drift"), F.bool_or(version.isNull()).alias("missing"))
    return runs.select("run", "cost_stop", "version_drift", (F.col("missing") & ~F.col("run").isin("src1", "src2")).alias("no_provenance"))


@query(VIEWS + ", w AS (SELECT case_id, max(CASE WHEN qid = 'quality' THEN CAST(value >= CAST(0.5 AS DOUBLE) AS INT) = gt END) AS a, max(CASE WHEN qid = 'toxic' THEN CAST(value >= CAST(0.5 AS DOUBLE) AS INT) = gt END) AS b FROM v_binary WHERE run = 0 GROUP BY case_id) SELECT w.case_id FROM w JOIN v_choice c USING (case_id) WHERE c.run = 0 AND a AND b AND c.label = c.gt")
def accepted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with every label right."""
    right = decisions(spark, sf_dir).where("run = 0 AND qid <> 'length'")
    said = F.when(F.col("qtype") == "noul", (F.col("value") >= 0.5).cast("int").cast("string")).otherwise(F.col("label"))
    return right.groupBy("case_id").agg(F.bool_and(said == F.col("gt")).alias("all_right")).where("all_right").select("case_id")


@query(SAID + """, pr AS (SELECT qid, '0-1' AS pair, a.hit AS ha, b.hit AS hb FROM (SELECT * FROM v_said WHERE run = 0) a JOIN (SELECT * FROM v_said WHERE run = 1) b USING (phase, case_id, qid)
 UNION ALL SELECT qid, '0-2', a.hit, b.hit FROM (SELECT * FROM v_said WHERE run = 0) a JOIN (SELECT * FROM v_said WHERE run = 2) b USING (phase, case_id, qid)),
k AS (SELECT pair, qid, sum(CASE WHEN ha AND NOT hb THEN 1 ELSE 0 END) AS b, sum(CASE WHEN hb AND NOT ha THEN 1 ELSE 0 END) AS c FROM pr GROUP BY ALL),
t AS (SELECT pair, qid, CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, CAST(least(b, c) AS BIGINT) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS p FROM k),
s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY pair) - row_number() OVER (PARTITION BY pair ORDER BY p, qid) + 1) * p) AS s FROM t) SELECT pair, qid, round(max(s) OVER (PARTITION BY pair ORDER BY p, qid ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s""")
def planned_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One family of tests for each pair of runs."""
    made = decisions(spark, sf_dir)
    pairs = pairing.paired(made, 0, 1).withColumn("pair", F.lit("0-1")).unionByName(pairing.paired(made, 0, 2).withColumn("pair", F.lit("0-2")))
    tests = pairing.discordance(pairs, ["pair", "qid"])
    return holm(tests, ["pair"], "p", ["qid"]).select("pair", "qid", F.round("p_holm", 9).alias("p_holm"))


@query(VIEWS + """, e AS (SELECT c.run, c.case_id, d.text, CASE WHEN c.label <> c.gt THEN 1 ELSE 0 END AS wrong FROM v_choice c JOIN documents d ON d.doc_id = c.case_id WHERE NOT c.err AND c.run IN (0, 1)),
w AS (SELECT case_id, max(CASE WHEN run = 0 THEN wrong END) AS w0, max(CASE WHEN run = 1 THEN wrong END) AS w1, regexp_matches(max(text), '\\n') AS subset FROM e GROUP BY case_id)
SELECT subset, count(*) AS n, round(100.0 * avg(w1 - w0), 6) AS delta_pp FROM w WHERE w0 IS NOT NULL AND w1 IS NOT NULL GROUP BY subset""")
def primacy_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the choice's error rate, in and out of a subset of texts found by a pattern."""
    wrong = (F.col("label") != F.col("gt")).cast("int")
    of = lambda run: F.max(F.when(F.col("run") == run, wrong))
    both = choices(spark, sf_dir).where("NOT err AND run IN (0, 1)").groupBy("case_id").agg(of(0).alias("w0"), of(1).alias("w1")).where("w0 IS NOT NULL AND w1 IS NOT NULL")
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").rlike(r"\n").alias("subset"))
    return both.join(texts, "case_id").groupBy("subset").agg(F.count("*").alias("n"), rounded(100.0 * F.avg(F.col("w1") - F.col("w0"))).alias("delta_pp"))


@query(VIEWS.replace("WITH", "WITH RECURSIVE", 1) + """, k0 AS (SELECT a.phase, count(*) AS n, CAST(sum(CASE WHEN a.label <> b.label THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(sum(CASE WHEN a.label = a.gt AND b.label = b.gt THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN a.label = a.gt AND b.label <> b.gt THEN 1 ELSE 0 END) AS DOUBLE) AS b,
 CAST(sum(CASE WHEN a.label <> a.gt AND b.label = b.gt THEN 1 ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE WHEN a.label <> a.gt AND b.label <> b.gt THEN 1 ELSE 0 END) AS DOUBLE) AS d FROM (SELECT * FROM v_choice WHERE run = 0 AND NOT err) a JOIN (SELECT * FROM v_choice WHERE run = 1 AND NOT err) b ON a.case_id = b.case_id GROUP BY a.phase),
asked AS (SELECT phase || 'low' AS id, changed AS k, n FROM k0 UNION ALL SELECT phase || 'high', n - changed, n FROM k0)""" + LIMITS + """, w AS (SELECT *, (a+b)/n AS p1, (a+c)/n AS p2, 3.841458881296 AS z2, 1.959964 AS z FROM k0),
i AS (SELECT *, (p1 + z2/(2*n) - z*sqrt(p1*(1-p1)/n + z2/(4.0*n*n)))/(1+z2/n) AS l1, (p1 + z2/(2*n) + z*sqrt(p1*(1-p1)/n + z2/(4.0*n*n)))/(1+z2/n) AS u1, (p2 + z2/(2*n) - z*sqrt(p2*(1-p2)/n + z2/(4.0*n*n)))/(1+z2/n) AS l2, (p2 + z2/(2*n) + z*sqrt(p2*(1-p2)/n + z2/(4.0*n*n)))/(1+z2/n) AS u2,
 CASE WHEN (a+b)*(c+d)*(a+c)*(b+d) > 0 THEN greatest(0, (a*d - b*c - n/2)/sqrt((a+b)*(c+d)*(a+c)*(b+d))) ELSE 0 END AS psi FROM w)
SELECT phase, i.n, changed, round(lo.p, 6) AS low, round(1 - hi.p, 6) AS high, round(p1 - p2, 6) AS delta, round(p1 - p2 - sqrt(greatest(0, (p1-l1)*(p1-l1) + (u2-p2)*(u2-p2) - 2*psi*(p1-l1)*(u2-p2))), 6) AS delta_low, round(p1 - p2 + sqrt(greatest(0, (u1-p1)*(u1-p1) + (p2-l2)*(p2-l2) - 2*psi*(u1-p1)*(p2-l2))), 6) AS delta_high
FROM i JOIN limits lo ON lo.id = phase || 'low' JOIN limits hi ON hi.id = phase || 'high'""")
def rotation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices that changed between two orders of the options: share with exact interval, and the difference of hits."""
    made = choices(spark, sf_dir).where("NOT err").select("run", "phase", "case_id", "label", (F.col("label") == F.col("gt")).alias("hit"))
    a, b = made.where("run = 0").drop("run"), made.where("run = 1").select("case_id", F.col("label").alias("label_b"), F.col("hit").alias("hit_b"))
    h, k = F.col("hit"), F.col("hit_b")
    counts = a.join(b, "case_id").groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("label_b")).alias("changed"), F.count_if(h & k).alias("a"), F.count_if(h & ~k).alias("b"), F.count_if(~h & k).alias("c"), F.count_if(~h & ~k).alias("d"))
    delta, low, high = newcombe(*(F.col(x) for x in "abcd"))
    return counts.withColumn("ci", clopper_pearson("changed", "n")).select("phase", "n", "changed", rounded(F.col("ci.low")).alias("low"), rounded(F.col("ci.high")).alias("high"), rounded(delta).alias("delta"), rounded(low).alias("delta_low"), rounded(high).alias("delta_high"))


@query("WITH a AS (SELECT conv_id, sum(length(text)) AS completion, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS prompt, count(*) AS attempts FROM conversations GROUP BY conv_id) SELECT count(*) AS cases, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion - prompt) AS BIGINT) AS completion, CAST(max(attempts) AS BIGINT) AS most_attempts FROM a")
def usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens over a case's attempts; a missing count is nought."""
    used, asks = F.coalesce(F.char_length("text"), F.lit(0)), F.col("role") == "user"
    part = lambda which: F.sum(F.when(which, used).otherwise(0))
    each = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(part(asks).alias("prompt"), part(~asks).alias("completion"), F.count("*").alias("attempts"))
    return each.agg(F.count("*").alias("cases"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.max("attempts").alias("most_attempts"))


@query("SELECT doc_id, CASE WHEN a AND b THEN 've' WHEN NOT a AND NOT b THEN 'no ve' ELSE 'parcial' END AS verdict FROM (SELECT doc_id, regexp_matches(text, 'the') AS a, regexp_matches(text, 'and') AS b FROM documents)")
def canary_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both, one or none of two planted words seen."""
    seen = F.col("text").contains("the").cast("int") + F.col("text").contains("and").cast("int")
    return read(spark, sf_dir, "documents").select("doc_id", F.when(seen == 2, "ve").when(seen == 0, "no ve").otherwise("parcial").alias("verdict"))


@query("SELECT l.doc_id, coalesce(CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE 'noul' END, q.qtype) AS type FROM labels l, (SELECT 'noul' AS qtype) q")
def typed_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a type get that of their question."""
    kinds = F.create_map(F.lit("quality"), F.lit("noul"), F.lit("length"), F.lit("score"))
    given = F.when(F.col("doc_id") % 3 != 0, "noul")
    return read(spark, sf_dir, "labels").select("doc_id", F.coalesce(given, kinds[F.lit("quality")]).alias("type"))


@query("SELECT ['fr','en','es','de'][CAST(1 + doc_id % 4 AS INT)] AS option, count(*) AS n FROM documents GROUP BY 1")
def explicit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named order of the options, which must be a permutation of them."""
    order = ("fr", "en", "es", "de")
    if sorted(order) != sorted(OPTIONS):
        raise ValueError("an order is a permutation of the options")
    listed = F.array(*[F.lit(o) for o in order])
    return read(spark, sf_dir, "documents").groupBy(F.element_at(listed, (1 + F.col("doc_id") % 4).cast("int")).alias("option")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT doc_id, doc_id // 2 AS fact, quality AS label, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'x' END AS evidence FROM labels)
SELECT 'duplicate' AS violation, count(*) AS n FROM (SELECT fact FROM f GROUP BY fact HAVING count(*) > 1) UNION ALL SELECT 'no_evidence', count(*) FROM f WHERE evidence = '' UNION ALL SELECT 'label_domain', count(*) FROM f WHERE label NOT IN (0, 1)""")
def fact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a fact bank's rules, by kind, in one pass."""
    facts = read(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 2).alias("fact"), F.col("quality").alias("label"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("x").alias("evidence"))
    folded = facts.groupBy("fact").agg(F.count("*").alias("n"), F.count_if(F.col("evidence") == "").alias("lost"), F.count_if(~F.col("label").isin(0, 1)).alias("odd"))
    counts = folded.agg(F.count_if(F.col("n") > 1).alias("duplicate"), F.coalesce(F.sum("lost"), F.lit(0)).alias("no_evidence"), F.coalesce(F.sum("odd"), F.lit(0)).alias("label_domain"))
    return counts.unpivot([], ["duplicate", "no_evidence", "label_domain"], "violation", "n")


@query("WITH g AS (SELECT unnest([100, 500, 1000, 2000, 4000]) AS t), s AS (SELECT t, rule, sum(CASE WHEN (CASE WHEN rule = 'short' THEN n_chars < t ELSE n_chars >= t END) = (lang = 'en') THEN 1 ELSE 0 END) AS ok FROM documents, g, (SELECT unnest(['short', 'long']) AS rule) GROUP BY ALL) SELECT rule, t, CAST(ok AS BIGINT) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ok DESC, t) AS rn FROM s) WHERE rn = 1")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best threshold of a grid for each rule: all grid points are sums of one pass."""
    docs, grid, english = read(spark, sf_dir, "documents"), (100, 500, 1000, 2000, 4000), F.col("lang") == "en"
    right = {(rule, t): F.count_if(((F.col("n_chars") < t) if rule == "short" else (F.col("n_chars") >= t)) == english) for rule in ("short", "long") for t in grid}
    sums = docs.agg(*[x.alias(f"{rule}_{t}") for (rule, t), x in right.items()])
    listed = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(t).alias("t"), F.col(f"{rule}_{t}").alias("ok")) for rule, t in right])
    points = sums.select(F.explode(listed).alias("x")).select("x.*")
    return points.groupBy("rule").agg(F.max_by(F.struct("t", "ok"), F.struct("ok", -F.col("t"))).alias("b")).select("rule", "b.t", "b.ok")
