"""Deciders: named models that answer questions about cases, run over Arrow batches where the cases are.

A decider gets a whole batch and all questions, and gives one answer a case and question; the scorer sees nothing of it but
answers.  A case that a decider fails on gets an error and the others go on.  Questions are few and travel with the
closure; the options of a question can be put in another order, which a decider sees and answers don't depend on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ANSWER = "qid string, type string, value double, label string, probabilities map<string,double>, error string"


@dataclass(frozen=True)
class Question:
    """``type``: noul (yes/no), score (levels 0 to n - 1) or choice; ``options``: a choice's labels or a score's levels, in order."""

    qid: str
    type: str
    options: tuple[str, ...] = ()


#: Answers to a question: values of yes/no or scores, or weights of each option (cases x options, in the options' order).
Answers = np.ndarray
Decider = Callable[[dict[str, np.ndarray], Question], Answers]
_REGISTRY: dict[str, Callable[..., Decider]] = {}


def decider(name: str) -> Callable[[Callable[..., Decider]], Callable[..., Decider]]:
    """Registers a function of options that returns a decider."""

    def add(make: Callable[..., Decider]) -> Callable[..., Decider]:
        if name in _REGISTRY:
            raise ValueError(f"{name} is registered already")
        _REGISTRY[name] = make
        return make

    return add


def reordered(question: Question, order: Sequence[str] | None) -> Question:
    """The question with its options in another order, which must hold each exactly once."""
    if order is None or question.type != "choice":
        return question
    if sorted(order) != sorted(question.options):
        raise ValueError(f"{question.qid}: an order is a permutation of the options")
    return replace(question, options=tuple(order))


def decide(cases: DataFrame, name: str, questions: Sequence[Question], key: Sequence[str], *, order: Sequence[str] | None = None, **options: object) -> DataFrame:
    """(key, qid, type, value, label, probabilities, error): the answers of the decider ``name`` to ``questions`` about ``cases``.

    The label is the option of the greatest weight, ties to the first in the order that the question itself has (whatever the
    order shown); probabilities are the weights over their sum.  A value that is not finite, weights that are negative
    or add up to nothing, or an exception give ``error`` and no answer: an exception on a batch is narrowed down to its cases by
    deciding them one by one.  Nulls in a case's columns arrive as NaN or None.
    """
    if name not in _REGISTRY:
        raise ValueError(f"no decider {name}; there are {sorted(_REGISTRY)}")
    make, asked = _REGISTRY[name], [(q, reordered(q, order)) for q in questions]
    fields = [cases.schema[k] for k in key]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], ANSWER])

    def answers(columns: dict[str, np.ndarray], n: int, shown: Question, decided: Decider) -> tuple[np.ndarray | None, np.ndarray]:
        """(answers, errors)."""
        try:
            return np.asarray(decided(columns, shown), float), np.full(n, None, object)
        except Exception as failure:
            if n == 1:
                return None, np.array([f"{type(failure).__name__}: {failure}"[:300]], object)
        width = max(1, len(shown.options)) if shown.type == "choice" else 1
        made, errors = np.full((n, width), np.nan), np.full(n, None, object)
        for k in range(n):
            one, errors[k : k + 1] = answers({c: v[k : k + 1] for c, v in columns.items()}, 1, shown, decided)
            if one is not None:
                made[k] = one.reshape(-1)
        return (made if shown.type == "choice" else made[:, 0]), errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided = make(**options)
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            for question, shown in asked:
                found, errors = answers(columns, batch.num_rows, shown, decided)
                yield _written(batch, question, shown, found, errors)

    def _written(batch: pa.RecordBatch, question: Question, shown: Question, found: np.ndarray | None, errors: np.ndarray) -> pa.RecordBatch:
        n = batch.num_rows
        values, labels, maps = np.full(n, np.nan), np.full(n, None, object), [None] * n
        if found is None:
            bad = np.ones(n, bool)
        elif question.type == "choice":
            found = found[:, [shown.options.index(o) for o in question.options]]
            whole = found.sum(axis=1)
            bad = ~(np.isfinite(found).all(axis=1) & (found >= 0).all(axis=1) & (whole > 0))
            best = np.where(bad[:, None], 0, found).argmax(axis=1)
            labels = np.where(bad, None, np.array(question.options, object)[best])
            maps = [None if b else list(zip(question.options, w / s, strict=True)) for b, w, s in zip(bad, found, whole, strict=True)]
        else:
            top = 1.0 if question.type == "noul" else len(question.options) - 1.0
            bad = ~(np.isfinite(found) & (found >= 0) & (found <= top))
            values = found
        errors = np.where(bad & np.equal(errors, None), "ValueError: answer out of its range", errors)
        made = [pa.array([question.qid] * n), pa.array([question.type] * n), pa.array(values, pa.float64(), mask=bad | (question.type == "choice")), pa.array(labels.tolist(), pa.string())]
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], *made, pa.array(maps, pa.map_(pa.string(), pa.float64())), pa.array(errors.tolist(), pa.string())], names=[*key, "qid", "type", "value", "label", "probabilities", "error"])

    return cases.mapInArrow(run, schema)


@decider("arithmetic")
def arithmetic(fail_every: int = 0) -> Decider:
    """A deterministic decider for tests and dry runs: whole-number arithmetic on a case's id, run and labels."""

    def decided(case: dict[str, np.ndarray], question: Question) -> Answers:
        k, run = case["case_id"], case["run"]
        if fail_every and (k % fail_every == 0).any():
            raise RuntimeError("no answer")
        if question.qid == "quality":
            return (k * 37 + run * 11) % 101 / 100
        if question.qid == "toxic":
            return (k * 53 + run * 23 + case["toxic"] * 40) % 101 / 100
        if question.type == "score":
            return (k * 13 + run * 7) % 201 / 100
        place = {"en": 0, "de": 1, "fr": 2, "es": 3}
        return np.stack([1 + (k * (7 + 2 * place[o]) + run * 5) % 13 + np.where((case["gt_lang"] == o) & ((k + run) % 4 != 0), 9, 0) for o in question.options], axis=1)

    return decided
