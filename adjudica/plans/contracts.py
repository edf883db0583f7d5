"""Wire questions and strict answers: what goes to an API, and what of its responses is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import rounded
from adjudica.registry import query
from adjudica.sources import tables
from adjudica.sources.answers_wire import api_questions, strict_answers
from adjudica.sources.tables import OPTIONS, VIEWS, read

#: The defect that each response has, by case_id modulo 40; others have none (15: one question is refused).
_DEFECTS = ("body", "answers", "name", "repeated name", "missing", "type", "choice", "probabilities", "value", "repeated value", "probability", "labels", "score", "noul", "confidence", None, "probability", "missing", "name")


@query(VIEWS + ", d AS (SELECT run, case_id, CASE case_id % 40 " + " ".join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(_DEFECTS) if d) + """ END AS reason FROM v_records WHERE NOT err),
p AS (SELECT run, case_id, round(max(CASE WHEN opt = 'fr' THEN p END), 6) AS p_fr FROM v_probs GROUP BY run, case_id)
SELECT d.run, d.case_id, NULL AS qid, NULL AS type, NULL AS value, NULL AS label, NULL AS p_fr, reason FROM d WHERE reason IS NOT NULL
UNION ALL SELECT v.run, v.case_id, v.qid, CASE WHEN v.qid = 'quality' AND v.case_id % 40 = 15 THEN 'refusal' ELSE v.qtype END, CASE WHEN v.qid = 'quality' AND v.case_id % 40 = 15 THEN NULL ELSE round(v.value, 6) END, v.label, CASE WHEN v.qid = 'language' THEN p_fr END, NULL
FROM v_decisions v JOIN d USING (run, case_id) JOIN p USING (run, case_id) WHERE reason IS NULL AND v.qid IN ('quality', 'length', 'language')""")
def strict_wire_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of three questions with every kind of breach, read strictly: answers of good ones, a reason for each other."""
    by, k = ["run", "case_id"], F.col("case_id") % 40
    options = tables.options(spark, sf_dir).where("NOT err")
    number = lambda c: c.cast("string")
    entry = F.when((k == 8) & (F.col("ord") == 1), F.concat(F.lit('{"probability":'), number(F.col("p")), F.lit("}"))).otherwise(
        F.concat(F.lit('{"value":"'), F.when((k == 9) & (F.col("ord") == 1), "en").otherwise(F.col("opt")), F.lit('","probability":'), F.when((k == 10) & (F.col("ord") == 2), "1.5").when((k == 16) & (F.col("ord") == 2), '"0.5"').otherwise(number(F.col("p"))), F.lit("}"))
    )
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~((k == 11) & (F.col("ord") == 3)), F.struct("ord", entry.alias("e"))))), lambda x: x["e"]), ",")
    best = F.max_by("opt", F.struct("w", -F.col("ord")))
    rows = options.groupBy(*by).agg(listed.alias("probs"), best.alias("label"))
    scores = tables.ordinal(spark, sf_dir).select(*by, F.col("value").alias("score"))
    yes = tables.binary(spark, sf_dir).where("qid = 'quality'").select(*by, F.col("value").alias("quality"))
    rows = rows.join(scores, by).join(yes, by)
    probs = F.when(k == 7, '{"en":1}').otherwise(F.concat(F.lit("["), F.col("probs"), F.lit("]")))
    language = F.concat(F.lit('{"type":"'), F.when(k == 5, "score").otherwise("choice"), F.lit('","name":"language","choice":"'), F.when(k == 6, "xx").otherwise(F.col("label")), F.lit('","probabilities":'), probs, F.when(k == 14, ',"confidence":2').otherwise(',"confidence":0.5'), F.lit("}"))
    length = F.concat(F.lit('{"type":"score","name":"length","score":'), F.when(k == 12, "2.5").otherwise(number(F.col("score"))), F.lit(',"probabilities":[{"value":0,"probability":0.25},{"value":1,"probability":0.5},{"value":2,"probability":0.25}]}'))
    quality = F.when(k == 15, '{"type":"refusal","name":"quality"}').otherwise(F.concat(F.lit('{"type":"predicate","name":"quality","probability":'), F.when(k == 13, "true").otherwise(number(F.col("quality"))), F.lit("}")))
    extra = F.when(k.isin(2, 18), ',{"type":"choice","name":7}').when(k == 3, ',{"type":"refusal","name":"quality"}').otherwise("")
    answers = F.when(k == 1, '{"quality":1}').otherwise(F.concat(F.lit("["), language, F.when(~k.isin(4, 17), F.concat(F.lit(","), length)).otherwise(""), F.lit(","), quality, extra, F.lit("]")))
    body = F.concat(F.lit('{"answers":'), answers, F.when(k == 0, "").otherwise("}"))
    questions = spark.createDataFrame([("quality", 0, "noul", None), ("length", 1, "score", ["0", "1", "2"]), ("language", 2, "choice", list(OPTIONS))], "qid string, place int, type string, labels array<string>")
    found = strict_answers(rows.select(*by, body.alias("body")), questions, by)
    return found.select(*by, "qid", "type", rounded(F.col("value")).alias("value"), "label", rounded(F.when(F.col("qid") == "language", F.col("probabilities")["fr"])).alias("p_fr"), "reason")


@query("""WITH q AS (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'choice' ELSE 'score' END AS type, r_name AS qid, list(n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ': in ' || r_name || ': a region' END ORDER BY n_nationkey) AS t, list(n_name ORDER BY n_nationkey) AS l FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)
SELECT qid, '{"type":"' || type || '","name":"' || qid || '","instructions":"Which?",' || CASE type WHEN 'choice' THEN '"choices":[' || array_to_string(list_transform(range(1, len(l) + 1), lambda i: '{"value":"' || l[i] || '","description":"' || t[i] || '"}'), ',')
ELSE '"levels":[' || array_to_string(list_transform(t, lambda x: '{"label":"' || CASE WHEN contains(x, ':') THEN trim(split_part(x, ':', 1)) ELSE x END || '","description":"' || CASE WHEN contains(x, ':') THEN trim(substr(x, strpos(x, ':') + 1)) ELSE x END || '"}'), ',') END || ']}' AS api FROM q""")
def wire_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as the API takes them: the nations of a region as choices with descriptions, or as labelled levels."""
    text = F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit(": in "), "r_name", F.lit(": a region"))))
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.groupBy("r_regionkey", F.col("r_name").alias("qid")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("label"), text.alias("text")))).alias("options"))
    kind = F.when(F.col("r_regionkey") % 2 == 0, "choice").otherwise("score")
    return api_questions(rows.select("qid", kind.alias("type"), F.lit("Which?").alias("instructions"), "options"))
