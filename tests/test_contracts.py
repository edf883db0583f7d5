"""Strict answers and deciders on odd input."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.operators import deciders
from adjudica.sources.answers_wire import api_questions, strict_answers

GOOD = [
    {"type": "predicate", "name": "q", "probability": 0},
    {"type": "score", "name": "s", "score": 1, "probabilities": [{"value": 1, "probability": 0.75}, {"value": "0", "probability": 0.25}]},
    {"type": "choice", "name": "c", "choice": "a", "probabilities": [{"value": "b", "probability": 0}, {"value": "a", "probability": 1}], "confidence": 0.5},
]


def changed(k, **fields):
    return [{**a, **fields} if i == k else a for i, a in enumerate(GOOD)]


REFUSED = {
    "body": [None, "", "{", "not json"],
    "answers": [json.dumps(x) for x in ({}, {"answers": None}, {"answers": {"q": 1}}, [1])],
    "name": [json.dumps({"answers": x}) for x in ([*GOOD, {}], [*GOOD, {"name": 3}], [7, *GOOD])],
    "repeated name": [json.dumps({"answers": [*GOOD, GOOD[0]]})],
    "missing": [json.dumps({"answers": x}) for x in ([], GOOD[:2], [GOOD[0], {**GOOD[1], "name": "x"}, GOOD[2]])],
    "type": [json.dumps({"answers": x}) for x in (changed(0, type="noul"), changed(2, type=None))],
    "noul": [json.dumps({"answers": changed(0, probability=x)}) for x in (True, "0.5", -0.1, 1.1, None)],
    "score": [json.dumps({"answers": changed(1, score=x)}) for x in (1.01, -1, False, "1")],
    "choice": [json.dumps({"answers": changed(2, choice=x)}) for x in ("z", None, 1)],
    "probabilities": [json.dumps({"answers": changed(2, probabilities=x)}) for x in (None, {"a": 1})],
    "value": [json.dumps({"answers": changed(2, probabilities=x)}) for x in ([{"probability": 1}], [3])],
    "repeated value": [json.dumps({"answers": changed(2, probabilities=[{"value": "a", "probability": 0.5}] * 2)})],
    "probability": [json.dumps({"answers": changed(2, probabilities=[{"value": "a", "probability": x}, {"value": "b", "probability": 0}])}) for x in (2, True, "1", None)],
    "labels": [json.dumps({"answers": changed(2, probabilities=x)}) for x in ([{"value": "a", "probability": 1}], [{"value": v, "probability": 0.1} for v in "abc"])],
    "confidence": [json.dumps({"answers": changed(2, confidence=x)}) for x in (2, "1")],
}


def test_strict_answers(spark):
    questions = spark.createDataFrame([("q", 0, "noul", None), ("s", 1, "score", ["0", "1"]), ("c", 2, "choice", ["a", "b"])], "qid string, place int, type string, labels array<string>")
    bodies = [json.dumps({"answers": GOOD}), json.dumps({"answers": changed(1, type="refusal", probabilities=5)})]
    wanted = {k: reason for k, (reason, _) in enumerate((r, b) for r, own in REFUSED.items() for b in own)}
    rows = [(k, b) for k, b in enumerate(b for own in REFUSED.values() for b in own)] + [(100 + k, b) for k, b in enumerate(bodies)]
    found = strict_answers(spark.createDataFrame(rows, "k int, body string").repartition(2), questions, ["k"]).collect()
    assert {r["k"]: r["reason"] for r in found if r["reason"]} == wanted
    assert sum(1 for r in found if r["k"] < 100) == len(wanted)
    kept = {(r["k"], r["qid"]): (r["type"], r["value"], r["label"], r["probabilities"]) for r in found if r["k"] >= 100}
    assert kept[100, "q"] == ("noul", 0.0, None, None) and kept[100, "s"] == ("score", 1.0, None, {"0": 0.25, "1": 0.75}) and kept[100, "c"] == ("choice", None, "a", {"a": 1.0, "b": 0.0})
    assert kept[101, "s"] == ("refusal", None, None, None) and len(kept) == 6


def test_strict_answers_stay_in_the_engine(spark):
    questions = spark.createDataFrame([("q", 0, "noul", None)], "qid string, place int, type string, labels array<string>")
    plan = strict_answers(spark.createDataFrame([(1, "{}")], "k int, body string"), questions, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_api_questions(spark):
    rows = [("c", "choice", "Pick", [("a", "x: y"), ("b", ""), ("d", None)]), ("s", "score", "Rate", [("0", "low: bad: worse"), ("1", " high ")]), ("n", "noul", "Is it?", None)]
    made = api_questions(spark.createDataFrame(rows, "qid string, type string, instructions string, options array<struct<label:string,text:string>>"))
    assert {r["qid"]: json.loads(r["api"]) for r in made.collect()} == {
        "c": {"type": "choice", "name": "c", "instructions": "Pick", "choices": [{"value": "a", "description": "x: y"}, {"value": "b", "description": "b"}, {"value": "d", "description": "d"}]},
        "s": {"type": "score", "name": "s", "instructions": "Rate", "levels": [{"label": "low", "description": "bad: worse"}, {"label": "high", "description": "high"}]},
        "n": {"type": "predicate", "name": "n", "instructions": "Is it?"},
    }


def test_deciders(spark):
    @deciders.decider("odd-test")
    def make(shift: float = 0.0):
        def decided(case, question):
            if question.type == "choice":
                return np.array([[0.0, 0.0], [1.0, 1.0], [-1.0, 2.0], [3.0, 1.0]])[case["k"].astype(int)]
            if (case["k"] == 2).any():
                raise KeyError("two")
            return case["x"] + shift

        return decided

    cases = spark.createDataFrame([(k, x) for k, x in enumerate([0.25, None, 0.5, 7.0])], "k long, x double").coalesce(1)
    questions = [deciders.Question("c", "choice", ("a", "b")), deciders.Question("y", "noul")]
    found = {(r["qid"], r["k"]): r for r in deciders.decide(cases, "odd-test", questions, ["k"], shift=0.5).collect()}
    assert [found["c", k]["label"] for k in range(4)] == [None, "a", None, "a"]
    assert found["c", 3]["probabilities"] == {"a": 0.75, "b": 0.25}
    assert [found["y", k]["value"] for k in range(4)] == [0.75, None, None, None]
    assert [found["y", k]["error"] for k in range(4)] == [None, "ValueError: answer out of its range", "KeyError: 'two'", "ValueError: answer out of its range"]
    turned = {r["k"]: r["label"] for r in deciders.decide(cases, "odd-test", questions[:1], ["k"], order=("b", "a")).collect()}
    assert turned == {0: None, 1: "a", 2: None, 3: "b"}  # a tie goes to the question's own first option
    with pytest.raises(ValueError, match="permutation"):
        deciders.decide(cases, "odd-test", questions, ["k"], order=("a", "a"))
    with pytest.raises(ValueError, match="no decider"):
        deciders.decide(cases, "none", questions, ["k"])
    assert deciders.decide(cases.where(F.lit(False)), "odd-test", questions, ["k"]).count() == 0
