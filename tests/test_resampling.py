"""Bootstraps folded by replicate: draws in bulk against one MD5 each, both ways of meeting the units, odd strata."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from adjudica.functions.draws import draws
from adjudica.operators import resampling


def spot(prefix, rep, pos, n):
    return int(int(hashlib.md5(f"{prefix}:{rep}:{pos}".encode()).hexdigest()[:13], 16) / 4503599627370496.0 * n)


@pytest.mark.parametrize("prefix, n, low, high, reps", [("0:1", 37, 0, 37, range(0, 1200, 7)), ("1:en", 20000, 9990, 20000, [3, 12, 1999]), ("5:é" + "x" * 60, 50, 0, 50, [1, 22]), ("7:" + "a" * 43, 1, 0, 1, [0, 10])])
def test_bulk_draws_are_those_of_single_digests(prefix, n, low, high, reps):
    found = {}
    for some, rows in draws(prefix, list(reps), n, low, high):
        for rep, row in zip(some.tolist(), rows, strict=True):
            found.setdefault(rep, []).extend(row.tolist())
    assert found == {rep: [spot(prefix, rep, pos, n) for pos in range(low, high)] for rep in reps}


@pytest.mark.parametrize("held", [True, False])
def test_sums_of_replicates(spark, monkeypatch, held):
    """Draws never become rows: the plan has no join, however many units there are (before, beyond 500,000 units every draw was shuffled)."""
    if not held:
        for name, value in (("BROADCAST_BYTES", 0), ("POSITIONS", 50), ("BLOCK_UNITS", 16), ("REPLICATES_AT_ONCE", 3)):
            monkeypatch.setattr(resampling, name, value)
    strata = {"en": 120, "de": 1, "z" * 70: 9, None: 4}
    rows = [(s, 7 * i + 1, None if i % 5 == 2 else i / 8, float(i)) for s, m in strata.items() for i in range(m)]
    units = spark.createDataFrame(rows, "phase string, case_id long, a double, b double").repartition(3)
    result = resampling.replicate_sums(units, "phase", "case_id", ["a", "b"], 11, 4)
    assert "Join" not in result._jdf.queryExecution().executedPlan().toString()
    found = {(r["phase"], r["rep"]): (r["sum_a"], r["count_a"], r["sum_b"], r["count_b"]) for r in result.collect()}
    wanted = {}
    for s, m in strata.items():
        for rep in range(11 if s else 0):
            drawn = np.array([spot(f"4:{s}", rep, pos, m) for pos in range(m)])
            some = drawn[drawn % 5 != 2]
            wanted[s, rep] = (some.sum() / 8, len(some), float(drawn.sum()), m)
    assert found == wanted


def test_no_units(spark):
    units = spark.createDataFrame([], "run int, case_id long, a double")
    assert resampling.replicate_sums(units, "run", "case_id", ["a"], 5, 0).count() == 0


@pytest.mark.parametrize("name", ["bootstrap_mean", "adjusted_boot", "interaction_boot", "range_boot", "seed_delta"])
def test_queries_fold_their_draws(name, spark, small, monkeypatch):
    """Bootstraps of cases make no row for a draw (before, 2000 rows for each case)."""
    from adjudica import registry
    from adjudica.plans import resampling as plans, studies

    def refuse(*args):
        raise AssertionError("draws as rows")

    monkeypatch.setattr(plans, "resampled", refuse)
    monkeypatch.setattr(studies, "resampled", refuse)
    assert registry.queries()[name](spark, small).count()
