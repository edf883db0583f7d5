"""Counts of different n-grams: each text normalised once, repeats compared exactly."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from adjudica import registry
from adjudica.functions.text import distinct_grams


def test_each_text_is_normalised_once(spark, small):
    """Before, the filter on the count was moved below it, so that every text was normalised and counted twice."""
    plan = registry.queries()["gram_sets"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(lower(") == 1


def test_different_grams(spark):
    rng = random.Random(3)
    texts = [[rng.choice("abc") for _ in range(n)] for n in (0, 7, 8, 9, 400, 3000)] + [["x"] * 50, [str(k) for k in range(60)], [str(k) for k in range(30)] * 3]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, words array<string>")
    found = {r["k"]: r["n"] for r in rows.select("k", distinct_grams(F.col("words")).alias("n")).collect()}
    assert found == {k: len({tuple(t[i : i + 8]) for i in range(len(t) - 7)}) for k, t in enumerate(texts)}
