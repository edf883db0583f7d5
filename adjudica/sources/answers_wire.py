"""Questions as an API takes them, and its answers held to the contract of each question, with a reason for what is refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"
#: The API's kinds of question by ours.
KINDS = {"noul": "predicate", "choice": "choice", "score": "score"}


def api_questions(questions: DataFrame) -> DataFrame:
    """(qid, api) of rows (qid, type, instructions, options): the JSON of each question.

    ``options`` is an array of (label, text).  A choice's description is its text, or its label where that is empty; a level's
    text is split at the first colon into label and description, which is the label where there is no colon.
    """
    choice = F.transform("options", lambda o: F.struct(o["label"].alias("value"), F.coalesce(F.nullif(o["text"], F.lit("")), o["label"]).alias("description")))

    def level(o: Column) -> Column:
        at = F.instr(o["text"], ":")
        label = F.trim(F.when(at > 0, F.substr(o["text"], F.lit(1), at - 1)).otherwise(o["text"]))
        return F.struct(label.alias("label"), F.when(at > 0, F.trim(F.substr(o["text"], at + 1))).otherwise(label).alias("description"))

    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("type")]
    said = F.struct(kind.alias("type"), F.col("qid").alias("name"), "instructions", F.when(F.col("type") == "choice", choice).alias("choices"), F.when(F.col("type") == "score", F.transform("options", level)).alias("levels"))
    return questions.select("qid", F.to_json(said).alias("api"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _within(value: Column, low: Column | float, high: Column | float) -> Column:
    """Whether a variant is a number (a boolean or a text is none) from ``low`` to ``high``; a missing one isn't."""
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(_kind(value).rlike(_NUMBER) & (number >= low) & (number <= high), F.lit(False))


def strict_answers(bodies: DataFrame, questions: DataFrame, key: list[str]) -> DataFrame:
    """(key, qid, type, value, label, probabilities, reason) of response texts: rows (key, body) and (qid, place, type, labels).

    ``questions`` is small (one row a question; broadcast): ``place`` orders them, ``labels`` is the array of a choice's labels or a
    score's level numbers as text (null for yes/no).  A response that breaks the contract gives one row with only its
    ``reason``, the first that holds: body, answers (no list), name, repeated name, missing; then by question in their order type,
    choice, score, noul, probabilities (no list), value, repeated value, probability, labels, confidence.  Nothing of
    such a response is kept.  Else each question gives a row; an answer of type refusal has type ``refusal`` and no value.
    """
    keyed = Window.partitionBy(*key)
    parsed = bodies.select(*key, F.try_parse_json("body").alias("v")).select(*key, "v", _at(F.col("v"), "$.answers").alias("list"))
    list_kind = F.coalesce(_kind(F.col("list")), F.lit(""))
    broken = F.when(F.col("v").isNull(), "body").when(~list_kind.startswith("ARRAY"), "answers")
    parsed = parsed.select(*key, "list", broken.alias("broken"))
    refused = [parsed.where("broken IS NOT NULL").select(*key, F.col("broken").alias("reason"))]

    entries = parsed.where("broken IS NULL").select(*key, F.posexplode_outer(F.try_variant_get("list", "$", "array<variant>")).alias("pos", "a"))
    named = F.coalesce(_kind(_at(F.col("a"), "$.name")) == "STRING", F.lit(False))
    entries = entries.withColumn("name", F.when(named, _at(F.col("a"), "$.name", "string")))
    again = F.row_number().over(Window.partitionBy(*key, "name").orderBy("pos")) > 1
    odd = F.when(F.col("pos").isNull(), None).when(F.col("name").isNull(), "name").when(again, "repeated name")
    entries = entries.withColumn("odd", odd)
    # a response has as many entries as the API sends: a window over one is small
    entries = entries.withColumn("first_odd", F.min(F.when(F.col("odd").isNotNull(), F.struct("pos", "odd"))).over(keyed)["odd"])
    refused.append(entries.where("first_odd IS NOT NULL").select(*key, F.col("first_odd").alias("reason")).distinct())

    good = entries.where("first_odd IS NULL").drop("odd", "first_odd")
    asked = good.select(*key).distinct().join(F.broadcast(questions))  # every question of each response
    answers = asked.join(good.withColumnRenamed("name", "qid").select(*key, "qid", "a"), [*key, "qid"], "left")

    a, kind, labels = F.col("a"), F.col("type"), F.col("labels")
    given, said = _at(a, "$.type", "string"), _at(a, "$.probabilities")
    refusal = F.coalesce(given == "refusal", F.lit(False))
    wanted = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[kind]
    parts = F.transform(F.try_variant_get(said, "$", "array<variant>"), lambda p: F.struct(_at(p, "$.value", "string").alias("value"), _within(_at(p, "$.probability"), 0.0, 1.0).alias("fits"), _at(p, "$.probability", "double").alias("p")))
    answers = answers.withColumns({"given": given, "refusal": refusal, "parts": parts})
    values = F.transform("parts", lambda p: p["value"])
    vector = kind.isin("choice", "score")
    confidence = _at(a, "$.confidence")
    rules = [
        ("missing", a.isNull()),
        (None, F.col("refusal")),
        ("type", ~F.coalesce(F.col("given") == wanted, F.lit(False))),
        ("noul", (kind == "noul") & ~_within(_at(a, "$.probability"), 0.0, 1.0)),
        ("choice", (kind == "choice") & ~F.coalesce(F.array_contains(labels, _at(a, "$.choice", "string")), F.lit(False))),
        ("score", (kind == "score") & ~_within(_at(a, "$.score"), 0.0, F.size(labels) - 1.0)),
        ("probabilities", vector & ~F.coalesce(_kind(said).startswith("ARRAY"), F.lit(False))),
        ("value", vector & F.exists("parts", lambda p: p["value"].isNull())),
        ("repeated value", vector & (F.size(F.array_distinct(values)) < F.size(values))),
        ("probability", vector & F.exists("parts", lambda p: ~p["fits"])),
        ("labels", vector & (F.sort_array(values) != F.sort_array(labels))),
        ("confidence", confidence.isNotNull() & ~_within(confidence, 0.0, 1.0)),
    ]
    reason = reduce(lambda c, r: c.when(r[1], F.lit(r[0])), rules, F.when(F.lit(False), F.lit(None).cast("string")))
    answers = answers.withColumn("reason", reason)
    missing = F.max(F.when(F.col("reason") == "missing", F.lit("missing"))).over(keyed)
    worst = F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason"))).over(keyed)["reason"]
    answers = answers.withColumn("worst", F.coalesce(missing, worst))
    refused.append(answers.where("worst IS NOT NULL").select(*key, F.col("worst").alias("reason")).distinct())

    value = F.when(kind == "noul", _at(a, "$.probability", "double")).when(kind == "score", _at(a, "$.score", "double"))
    probabilities = F.when(vector, F.map_from_entries(F.transform("parts", lambda p: F.struct(p["value"], p["p"]))))
    put = lambda c: F.when(~F.col("refusal"), c)
    kept = answers.where("worst IS NULL").select(
        *key, "qid", F.when(F.col("refusal"), "refusal").otherwise(kind).alias("type"), put(value).alias("value"),
        put(F.when(kind == "choice", _at(a, "$.choice", "string"))).alias("label"), put(probabilities).alias("probabilities"), F.lit(None).cast("string").alias("reason"),
    )
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [kept, *refused])
