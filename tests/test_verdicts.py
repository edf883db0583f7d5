"""Bands, hierarchies and universes on odd input."""

import pytest

from adjudica.operators.verdicts import UnknownIds, banded, choose_down, within_universe


def test_bands(spark):
    bands = spark.createDataFrame([("m", "CONFIRMADA", 1.0, 2.0, True, False), ("m", "INCONCLUSA", 0.0, 3.0, False, True), ("m", "INCONCLUSA", 9.0, None, True, True)], "metric string, verdict string, low double, high double, low_in boolean, high_in boolean")
    wanted = {1.0: "CONFIRMADA", 1.5: "CONFIRMADA", 2.0: "INCONCLUSA", 0.0: "REFUTADA", 3.0: "INCONCLUSA", 3.1: "REFUTADA", 9.0: "INCONCLUSA", 1e9: "INCONCLUSA", -5.0: "REFUTADA", None: "NO EVALUABLE", float("nan"): "NO EVALUABLE"}
    cells = [(k, "m", v) for k, v in enumerate(wanted)]
    expected = spark.createDataFrame([(k, "m") for k in range(len(cells) + 1)] + [(0, "no bands")], "cell int, metric string")
    found = {(r["cell"], r["metric"]): r["verdict"] for r in banded(expected, spark.createDataFrame(cells, "cell int, metric string, value double"), bands).collect()}
    assert [found[k, "m"] for k in range(len(cells))] == list(wanted.values())
    assert found[len(cells), "m"] == "NO EVALUABLE" and found[0, "no bands"] == "NO EVALUABLE" and len(found) == len(cells) + 2


def test_choices_down_a_hierarchy(spark):
    from pyspark.sql import functions as F

    tree = spark.createDataFrame([(1, "", "a", 1), (1, "", "b", 0), (2, "a", "a1", 0), (2, "a", "a2", 1)], "level int, parent string, label string, place int")
    weight = F.when(F.col("label") == "a", F.col("k")).when(F.col("label") == "b", 2).otherwise(1)
    found = {(r["k"], r["level"]): (r["label"], r["p"]) for r in choose_down(spark.createDataFrame([(k,) for k in (1, 2, 6)], "k int"), ["k"], tree, weight, 2).collect()}
    assert found == {(1, 1): ("b", 2 / 3), (2, 1): ("b", 0.5), (6, 1): ("a", 0.75), (6, 2): ("a1", 0.5)}  # b has no children; ties go by place


def test_universe(spark):
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id int")
    assert sorted(r[0] for r in within_universe(ids(1, 1, 2, 3), ids(1, 2, 4), ids(2, 3), "id").collect()) == [1, 1]
    with pytest.raises(UnknownIds, match="id not known: 7, 9"):
        within_universe(ids(1, 9, 7, 9), ids(1), ids(2), "id")
