"""Fused runs: what they decide and what that is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import credit, first_best, rounded
from adjudica.functions.text import fired
from adjudica.operators import fusion as op
from adjudica.operators import pairing
from adjudica.plans.comparison import SAID
from adjudica.plans.decisions import decisions
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.tables import VIEWS, read

_OK = "CAST((case_id * 29) % 101 AS DOUBLE) / 100"
_CREDIT = """CASE WHEN qtype = 'choice' THEN CASE WHEN label = gt THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END WHEN qtype = 'noul' THEN CASE WHEN (value >= CAST(0.5 AS DOUBLE)) = (gt = '1') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
 ELSE CASE abs(least(2, greatest(0, round_even(value, 0))) - CAST(gt AS INT)) WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END"""
_BOTH = """, ab AS (SELECT phase, case_id, qid, a.qtype, a.gt, a.err AS a_err, b.err AS b_err, a.label AS a_label, b.label AS b_label, a.value AS a_value, b.value AS b_value, a.point AS a_point, b.point AS b_point FROM (SELECT * FROM v_points WHERE run = 0) a JOIN (SELECT * FROM v_points WHERE run = 1) b USING (phase, case_id, qid)),
tox AS (SELECT case_id, value AS manipulated FROM v_binary WHERE run = 1 AND qid = 'toxic')"""


def _fused_sql(take: str) -> str:
    return VIEWS + _BOTH + f""", f AS (SELECT phase, case_id, qid, qtype, gt, CASE WHEN {take} THEN b_label ELSE a_label END AS label, CASE WHEN {take} THEN b_value ELSE a_value END AS value FROM ab JOIN tox USING (case_id) WHERE NOT a_err AND NOT b_err)
SELECT phase, qid, count(*) AS n, round(sum({_CREDIT}), 6) AS points FROM f GROUP BY phase, qid"""


_AUDIT = f"({_OK} < CAST(0.5 AS DOUBLE) OR (qtype = 'choice' AND manipulated >= CAST(0.5 AS DOUBLE)))"


def _points(rows: DataFrame) -> DataFrame:
    no = F.lit(False)
    earned = credit(F.col("qtype"), F.col("label"), F.col("value"), F.col("gt"), no, no)
    return rows.groupBy("phase", "qid").agg(F.count("*").alias("n"), rounded(F.sum(earned)).alias("points"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the first pass (run 0) and the reviewer (run 1), with the reviewer's doubt and suspicion."""
    suspicion = tables.binary(spark, sf_dir).where("run = 1 AND qid = 'toxic'").select("case_id", F.col("value").alias("manipulated"))
    ok = ((F.col("case_id") * 29) % 101).cast("double") / 100
    return op.side_by_side(decisions(spark, sf_dir), 0, 1).join(suspicion, "case_id").withColumn("ok", ok)


def _cascade(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    both = _both(spark, sf_dir).where("NOT a.err AND NOT b.err")
    taken = F.when(op.reviewed(rule, F.col("ok"), F.col("manipulated"), F.col("qtype")), F.col("b")).otherwise(F.col("a"))
    return _points(both.withColumn("t", taken).select("phase", "qid", "qtype", "gt", "t.label", "t.value"))


@query(_fused_sql("TRUE"))
def cascade_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, "review")


@query(_fused_sql(_AUDIT))
def cascade_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, "audit")


@query(VIEWS + _BOTH + f""", p AS (SELECT case_id, opt, ord, sum(w) AS w FROM (SELECT case_id, opt, ord, p / 2 AS w FROM v_probs WHERE run IN (0, 1)) GROUP BY ALL), best AS (SELECT case_id, opt AS label FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(w, 12) DESC, ord) AS rn FROM p) WHERE rn = 1),
f AS (SELECT phase, case_id, qid, qtype, gt, CASE WHEN qtype = 'choice' THEN best.label END AS label, (a_value + b_value) / 2 AS value FROM ab JOIN best USING (case_id) WHERE NOT a_err AND NOT b_err)
SELECT phase, qid, count(*) AS n, round(sum({_CREDIT}), 6) AS points FROM f GROUP BY phase, qid""")
def cascade_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of two runs' probabilities; the averaged choice is the first of the most likely options in their order."""
    mean = tables.options(spark, sf_dir).where("run IN (0, 1)").groupBy("case_id", "opt", "ord").agg(F.round(F.sum(F.col("p") / 2), 12).alias("w"))
    best = mean.groupBy("case_id").agg(first_best(F.col("w"), F.col("ord"), F.col("opt")).alias("label"))
    both = op.side_by_side(decisions(spark, sf_dir), 0, 1).where("NOT a.err AND NOT b.err").join(best, "case_id")
    value = (F.col("a.value") + F.col("b.value")) / 2
    return _points(both.select("phase", "qid", "qtype", "gt", F.when(F.col("qtype") == "choice", F.col("label")).alias("label"), value.alias("value")))


@query(VIEWS + ", a AS (SELECT * FROM v_records WHERE run = 0), b AS (SELECT * FROM v_records WHERE run = 1) SELECT case_id, CASE WHEN a.err AND NOT b.err THEN b.ms ELSE a.ms END AS ms, CASE WHEN a.err AND NOT b.err THEN b.err ELSE a.err END AS err, CASE WHEN a.err AND NOT b.err THEN 1 END AS fallback_from FROM a JOIN b USING (case_id)")
def fallback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.records(spark, sf_dir)
    a, b = (rows.where(F.col("run") == r).select("case_id", F.struct("ms", "err").alias(n)) for r, n in ((0, "a"), (1, "b")))
    taken = op.fallback(F.col("a.err"), F.col("b.err"), F.col("a"), F.col("b"))
    source = F.when(F.col("a.err") & ~F.col("b.err"), 1)
    return a.join(b, "case_id").select("case_id", taken["ms"].alias("ms"), taken["err"].alias("err"), source.alias("fallback_from"))


@query(VIEWS + """, a AS (SELECT * FROM v_records WHERE run = 0), b AS (SELECT * FROM v_records WHERE run = 1), m AS (SELECT a.phase, a.cost AS ca, b.cost AS cb, a.err AND NOT b.err AS used FROM a JOIN b USING (case_id))
SELECT phase, round(sum(ca) + coalesce(sum(CASE WHEN used THEN cb END), 0), 9) AS cost, CAST(sum(CASE WHEN used THEN 1 ELSE 0 END) AS BIGINT) AS substituted, CAST(sum(CASE WHEN ca IS NULL OR (used AND cb IS NULL) THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM m GROUP BY phase""")
def fallback_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary's cost in full, the fallback's only where it was used; cases of unknown cost are counted."""
    rows = tables.records(spark, sf_dir)
    a = rows.where("run = 0").select("case_id", "phase", F.col("cost").alias("ca"), F.col("err").alias("ea"))
    b = rows.where("run = 1").select("case_id", F.col("cost").alias("cb"), F.col("err").alias("eb"))
    used = F.col("ea") & ~F.col("eb")
    cost = F.sum("ca") + F.coalesce(F.sum(F.when(used, F.col("cb"))), F.lit(0.0))
    return a.join(b, "case_id").groupBy("phase").agg(F.round(cost, 9).alias("cost"), F.count_if(used).alias("substituted"), F.count_if(F.col("ca").isNull() | (used & F.col("cb").isNull())).alias("unknown"))


@query(SAID + """, c AS (SELECT case_id, qid, gt, said, count(*) AS c, min(run) AS first FROM v_said GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY case_id, qid ORDER BY c DESC, first) AS rn, count(*) OVER (PARTITION BY case_id, qid) AS k FROM c)
SELECT qid, count(*) AS n, CAST(sum(CASE WHEN said = gt THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS flips FROM v WHERE rn = 1 GROUP BY qid""")
def vote3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs' vote, and the decisions on which they aren't of one mind."""
    voted = pairing.votes(decisions(spark, sf_dir))
    return voted.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("modal") == F.col("gt")).alias("hits"), F.count_if(F.col("share") < 1).alias("flips"))


@query(SAID + "SELECT qid, CAST(sum(CASE WHEN NOT hit_a THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN NOT hit_a AND said_a <> said_b THEN 1 ELSE 0 END) AS BIGINT) AS catchable, CAST(sum(CASE WHEN hit_a AND said_a <> said_b THEN 1 ELSE 0 END) AS BIGINT) AS false_alarms FROM v_pairs GROUP BY qid")
def disagreement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairing.paired(decisions(spark, sf_dir), 0, 1)
    differ = F.col("said_a") != F.col("said_b")
    return pairs.groupBy("qid").agg(F.count_if(~F.col("hit_a")).alias("errors"), F.count_if(~F.col("hit_a") & differ).alias("catchable"), F.count_if(F.col("hit_a") & differ).alias("false_alarms"))


@query(VIEWS + _BOTH + f""", f AS (SELECT qid, a_point, CASE WHEN {_AUDIT} THEN b_point ELSE a_point END AS point FROM ab JOIN tox USING (case_id) WHERE NOT a_err AND NOT b_err)
SELECT qid, effect, count(*) AS n FROM (SELECT qid, CASE WHEN a_point < 1 AND point = 1 THEN 'fixed' WHEN a_point = 1 AND point < 1 THEN 'broken' WHEN point = 1 THEN 'still_right' ELSE 'still_wrong' END AS effect FROM f) GROUP BY ALL""")
def reviewer_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _both(spark, sf_dir).where("NOT a.err AND NOT b.err")
    take = op.reviewed("audit", F.col("ok"), F.col("manipulated"), F.col("qtype"))
    after = F.when(take, F.col("b.point")).otherwise(F.col("a.point"))
    before = F.col("a.point")
    effect = F.when((before < 1) & (after == 1), "fixed").when((before == 1) & (after < 1), "broken").when(after == 1, "still_right").otherwise("still_wrong")
    return both.groupBy("qid", effect.alias("effect")).agg(F.count("*").alias("n"))


#: Rules of the override: every pattern of a rule must be found.
RULES = {"shouting": ["[A-Z]{6,}!!"], "marked": [r"\*\*\*", "%%%"], "insult": [r"(?i)\b(?:idiot|moron|scum|worthless)\b"]}
_FIRED = "list_filter([CASE WHEN regexp_matches(text, '[A-Z]{6,}!!') THEN 'shouting' END, CASE WHEN regexp_matches(text, '\\*\\*\\*') AND regexp_matches(text, '%%%') THEN 'marked' END, CASE WHEN regexp_matches(text, '(?i)\\b(?:idiot|moron|scum|worthless)\\b') THEN 'insult' END], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_FIRED}, ',') AS rules FROM documents")
def rule_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(fired(F.col("text"), RULES), ",").alias("rules"))


@query(VIEWS + f", r AS (SELECT doc_id AS case_id, len({_FIRED}) > 0 AS fired FROM documents) SELECT run, count(*) AS n, CAST(sum(CASE WHEN (CASE WHEN fired THEN 1 WHEN value >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) = gt THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN fired AND value < CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS overridden FROM v_binary JOIN r USING (case_id) WHERE qid = 'toxic' AND NOT err GROUP BY run")
def rule_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on which a rule fires are toxic whatever the run says."""
    hit = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), (F.size(fired(F.col("text"), RULES)) > 0).alias("fired"))
    rows = tables.binary(spark, sf_dir).where("qid = 'toxic' AND NOT err").join(hit, "case_id")
    said = (F.col("fired") | (F.col("value") >= 0.5)).cast("int")
    return rows.groupBy("run").agg(F.count("*").alias("n"), F.count_if(said == F.col("gt")).alias("hits"), F.count_if(F.col("fired") & (F.col("value") < 0.5)).alias("overridden"))
