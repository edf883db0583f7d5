"""Column expressions over typed answers: levels, credit, labels, confidence, first-wins argmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level(value: Column, n_levels: Column | int) -> Column:
    """The level nearest to a continuous score, halves to even, kept within 0..n-1."""
    top = (n_levels if isinstance(n_levels, Column) else F.lit(n_levels)) - 1
    return F.least(top.cast("double"), F.greatest(F.lit(0.0), F.bround(value, 0)))


def credit(qtype: Column, label: Column, value: Column, gt: Column, err: Column, refused: Column, n_levels: int = 3) -> Column:
    """Points of a decision: 1 for a match, 0.5 for a level off by one, else 0; 0 if refused, null if the case failed."""
    off = F.abs(level(value, n_levels) - gt.try_cast("int"))
    return (
        F.when(err, F.lit(None).cast("double"))
        .when(refused, F.lit(0.0))
        .when(qtype == "choice", F.when(label == gt, F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(qtype == "noul", F.when((value >= 0.5) == (gt == "1"), F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.when(off == 0, F.lit(1.0)).when(off == 1, F.lit(0.5)).otherwise(F.lit(0.0)))
    )


def first_best(weight: Column, order: Column, result: Column) -> Column:
    """Aggregate: ``result`` of the greatest ``weight``; of equal weights, that of the smallest ``order``."""
    return F.max_by(result, F.struct(weight, -order))


def decision_label(qtype: Column, label: Column, value: Column, n_levels: int = 3) -> Column:
    """What a decision says, as text, the way the scorer reads it."""
    said = F.when(qtype == "choice", label).when(qtype == "noul", F.when(value >= 0.5, "1").otherwise("0"))
    return said.otherwise(level(value, n_levels).cast("int").cast("string"))


def yes_confidence(value: Column) -> Column:
    """Probability of the side that a yes/no answer takes, after clamping to [0, 1]."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
    return F.greatest(p, 1 - p)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole.cast("double"))


def rounded(x: Column) -> Column:
    return F.round(x, 6)
