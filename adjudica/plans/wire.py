"""Wire formats: nested result documents, fenced JSON, option vectors, fine-tune samples, labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import first_best, rounded
from adjudica.plans.decisions import decisions
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.documents import ANSWERS, flatten_answers
from adjudica.sources.tables import OPTIONS, VIEWS, read


@query(VIEWS + "SELECT run, phase, case_id, qid, round(value, 6) AS value, label FROM v_decisions WHERE NOT err AND NOT refused")
def json_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions written as tagged JSON answers and read back."""
    made = decisions(spark, sf_dir).where("NOT err")
    kind = F.when(F.col("refused"), "refusal").otherwise(F.col("qtype"))
    answer = F.struct(kind.alias("type"), F.col("label").alias("choice"), F.when(F.col("qtype") == "score", F.col("value")).alias("score"), F.when((F.col("qtype") == "noul") & ~F.col("refused"), F.col("value")).alias("noul"))
    docs = made.groupBy("run", "phase", "case_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("qid", answer.alias("a"))))).alias("answers"))
    read_back = docs.select("run", "phase", "case_id", F.from_json("answers", ANSWERS).alias("answers"))
    return flatten_answers(read_back, ["run", "phase", "case_id"]).where("NOT refused").select("run", "phase", "case_id", "qid", rounded(F.col("value")).alias("value"), "label")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON inside a code fence, taken out and read with a schema."""
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    bare = F.regexp_replace(fenced, r"(?s)\A\s*```[a-z]*\n?|\n?```\s*\z", "")
    return read(spark, sf_dir, "events").select("event_type", F.from_json(bare, "k bigint")["k"].alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT doc_id, label, level FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE lang END AS label, CASE WHEN doc_id % 4 = 1 OR doc_id % 5 > 2 THEN NULL ELSE CAST(doc_id % 5 AS INT) END AS level FROM documents) WHERE label IS NOT NULL AND level IS NOT NULL")
def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first {...} in a text, read with strict types and ranges; anything else gives no labels."""
    said = F.when(F.col("doc_id") % 4 == 1, F.lit("Sorry, no.")).otherwise(F.concat(F.lit("Here:\n"), F.to_json(F.struct(F.col("lang").alias("label"), (F.col("doc_id") % 5).alias("level"))), F.lit("\nDone.")))
    found = F.from_json(F.regexp_extract(said, r"(?s)\{.*\}", 0), "label string, level int")
    rows = read(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.label", "x.level")
    return rows.where(F.col("label").isin(*OPTIONS) & F.col("level").between(0, 2))


@query("""WITH l AS (SELECT doc_id, len(text) AS a, n_chars % 97 AS b, doc_id % 11 AS c FROM documents), x AS (SELECT doc_id, [CAST(a % 13 AS DOUBLE), CAST(b AS DOUBLE) / 10, CASE WHEN c = 0 THEN CAST(-20 AS DOUBLE) ELSE CAST(c AS DOUBLE) END] AS v FROM l),
e AS (SELECT doc_id, list_transform(v, lambda y: exp(y - list_max(v))) AS e FROM x) SELECT doc_id, round(e[1] / list_sum(e), 6) AS pa, round(e[2] / list_sum(e), 6) AS pb, round(e[3] / list_sum(e), 6) AS pc, round((e[2] + 2 * e[3]) / list_sum(e), 6) AS expected FROM e""")
def masked_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of allowed labels from log-probabilities, a missing one at a floor; and the expected level."""
    c = F.col("doc_id") % 11
    logs = F.array((F.length("text") % 13).cast("double"), (F.col("n_chars") % 97).cast("double") / 10, F.when(c == 0, F.lit(-20.0)).otherwise(c.cast("double")))
    rows = read(spark, sf_dir, "documents").select("doc_id", logs.alias("v")).select("doc_id", F.transform("v", lambda y: F.exp(y - F.array_max("v"))).alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    e = [F.col("e")[k] for k in range(3)]
    return rows.select("doc_id", *[rounded(x / whole).alias(n) for x, n in zip(e, ("pa", "pb", "pc"), strict=True)], rounded((e[1] + 2 * e[2]) / whole).alias("expected"))


@query("SELECT doc_id, round(CASE WHEN doc_id % 5 + n_chars % 4 > 0 THEN CAST(doc_id % 5 AS DOUBLE) / (doc_id % 5 + n_chars % 4) ELSE CAST(0.5 AS DOUBLE) END, 6) AS present FROM documents")
def present_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("doc_id") % 5, F.col("n_chars") % 4
    return read(spark, sf_dir, "documents").select("doc_id", rounded(F.coalesce(F.try_divide(a.cast("double"), (a + b).cast("double")), F.lit(0.5))).alias("present"))


@query(VIEWS + ", v AS (SELECT run, case_id, ord, opt, CASE WHEN case_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE p * 3 END AS q FROM v_probs), s AS (SELECT *, sum(q) OVER (PARTITION BY run, case_id) AS s FROM v) SELECT run, case_id, opt, round(CASE WHEN s = 0 THEN CAST(0.25 AS DOUBLE) ELSE q / s END, 6) AS p FROM s WHERE run = 0")
def renormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to a sum of 1; an all-zero one becomes uniform.  The vector is a map within the row."""
    q = F.when(F.col("case_id") % 17 == 0, F.lit(0.0)).otherwise(F.col("p") * 3)
    vectors = tables.options(spark, sf_dir).where("run = 0").groupBy("run", "case_id").agg(F.map_from_entries(F.collect_list(F.struct("opt", q.alias("q")))).alias("m"))
    whole = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x)
    scaled = vectors.withColumn("s", whole).select("run", "case_id", F.transform_values("m", lambda k, v: F.when(F.col("s") == 0, 1.0 / F.size("m")).otherwise(v / F.col("s"))).alias("m"))
    return scaled.select("run", "case_id", F.explode("m").alias("opt", "p")).withColumn("p", rounded(F.col("p")))


@query(VIEWS + ", o AS (SELECT run, case_id, gt, opt, ord, p, CASE WHEN opt = gt THEN 1 ELSE 0 END AS y FROM v_probs), b AS (SELECT run, case_id, gt, opt AS label FROM (SELECT *, row_number() OVER (PARTITION BY run, case_id ORDER BY round(p / (p + (1 - p)), 12) DESC, ord) AS rn FROM o) WHERE rn = 1) SELECT run, count(*) AS n, CAST(sum(CASE WHEN label = gt THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM b GROUP BY run")
def one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice asked as one yes/no question for each option, and put together again."""
    present = F.round(F.col("p") / (F.col("p") + (1 - F.col("p"))), 12)
    taken = tables.options(spark, sf_dir).groupBy("run", "case_id", "gt").agg(first_best(present, F.col("ord"), F.col("opt")).alias("label"))
    return taken.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("gt")).alias("hits"))


@query("""WITH s AS (SELECT l.doc_id, d.lang, o.opt, row_number() OVER (PARTITION BY l.doc_id ORDER BY sha256(CAST(l.doc_id AS VARCHAR) || ':' || o.opt)) AS pos FROM labels l JOIN documents d USING (doc_id), (VALUES ('en'), ('de'), ('fr'), ('es')) o(opt))
SELECT doc_id, string_agg(chr(CAST(64 + pos AS INT)) || '. ' || opt, ' ' ORDER BY pos) AS options, max(CASE WHEN opt = lang THEN chr(CAST(64 + pos AS INT)) END) AS gold FROM s GROUP BY doc_id""")
def sft_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample a labelled question: options in an order hashed from the id, lettered, with the right letter."""
    docs = tables.cases(spark, sf_dir).select(F.col("case_id").alias("doc_id"), F.col("gt_lang").alias("lang"))
    keyed = F.array(*[F.struct(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f":{o}")), 256).alias("k"), F.lit(o).alias("o")) for o in OPTIONS])
    shuffled = docs.select("doc_id", "lang", F.transform(F.array_sort(keyed), lambda x: x["o"]).alias("os"))
    letter = lambda i: F.substring(F.lit("ABCD"), i, F.lit(1))
    lettered = F.transform("os", lambda o, i: F.concat(letter(i + 1), F.lit(". "), o))
    return shuffled.select("doc_id", F.array_join(lettered, " ").alias("options"), letter(F.array_position("os", F.col("lang")).cast("int")).alias("gold"))
