"""Fusion of runs: reviewer cascade, averaging, fallback, voting, overrides.  All are column expressions over joined runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["phase", "case_id", "cluster_id", "qid", "qtype", "gt"]


def side_by_side(decisions: DataFrame, first: int, second: int) -> DataFrame:
    """KEYS with a and b: the answers of two runs as structs (err, refused, label, value, point)."""
    answer = F.struct("err", "refused", "label", "value", "point")
    a = decisions.where(F.col("run") == first).select(*KEYS, answer.alias("a"))
    b = decisions.where(F.col("run") == second).select(*[k for k in KEYS if k in ("phase", "case_id", "qid")], answer.alias("b"))
    return a.join(b, ["phase", "case_id", "qid"])


def reviewed(rule: str, ok: Column, manipulated: Column, qtype: Column) -> Column:
    """Whether the reviewer's answer is taken: always ('review'), or where it doubts the first ('audit'): probability that
    the first is right below one half, or, for a choice, manipulation suspected."""
    if rule == "review":
        return F.lit(True)
    return (ok < 0.5) | ((qtype == "choice") & (manipulated >= 0.5))


def fallback(a_err: Column, b_err: Column, a: Column, b: Column) -> Column:
    """The primary's value, or the fallback's where only the primary failed."""
    return F.when(a_err & ~b_err, b).otherwise(a)
