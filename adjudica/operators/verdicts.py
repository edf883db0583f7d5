"""Verdicts by bands that are data, choices down a hierarchy, and ids held to a universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The verdicts, in the order in which their bands are tried, and that of an undefined metric.
VERDICTS, UNDEFINED, REFUTED = ("CONFIRMADA", "INCONCLUSA"), "NO EVALUABLE", "REFUTADA"


def banded(expected: DataFrame, metrics: DataFrame, bands: DataFrame) -> DataFrame:
    """(cell, metric, value, verdict) for each of ``expected`` (cell, metric).

    ``metrics`` has (cell, metric, value); ``bands`` (metric, verdict, low, high, low_in, high_in): a value is within a band if it is over
    ``low`` and under ``high`` (null: no limit), or equal to one that is ``in``.  The first of :data:`VERDICTS` with a band that holds the
    value is the verdict, else it is refuted; a verdict may have several bands.  A metric that is missing, null or NaN can't
    be judged, and a cell that is expected keeps its row.  ``bands`` is a small table of the study and is broadcast.
    """
    value = F.col("value")
    above = F.col("low").isNull() | (value > F.col("low")) | (F.col("low_in") & (value == F.col("low")))
    below = F.col("high").isNull() | (value < F.col("high")) | (F.col("high_in") & (value == F.col("high")))
    rank = F.when(above & below, F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict")))
    known = expected.join(metrics, ["cell", "metric"], "left").withColumn("value", F.when(~F.isnan("value"), value))
    tried = known.join(F.broadcast(bands), "metric", "left").withColumn("rank", F.when(rank > 0, rank))
    best = tried.groupBy("cell", "metric", "value").agg(F.min("rank").alias("rank"))
    names = F.array(*[F.lit(v) for v in VERDICTS])
    verdict = F.when(value.isNull(), UNDEFINED).when(F.col("rank").isNull(), REFUTED).otherwise(F.try_element_at(names, F.col("rank").cast("int")))
    return best.select("cell", "metric", "value", verdict.alias("verdict"))


def choose_down(cases: DataFrame, key: list[str], tree: DataFrame, weight: Column, levels: int) -> DataFrame:
    """(key, level, label, p): the choice of each case on each level of a hierarchy, where options are the children of what was
    chosen above.

    ``tree`` has (level, parent, label, place): the options of level 1 have the parent ''.  ``weight`` is an expression over the
    cases' columns, ``level`` and ``label``; the greatest wins, ties to the smaller ``place``; ``p`` is its share.  A choice without children ends
    its case's descent: deeper levels have no row.  ``levels`` is fixed by the hierarchy, and each is one join, by broadcast
    where the level's options are few, and one grouped aggregate that combines before it shuffles.
    """
    from adjudica.operators.folding import staged

    chosen, found = cases.withColumn("_above", F.lit("")), []
    for level in range(1, levels + 1):
        options = tree.where(F.col("level") == level).select("level", F.col("parent").alias("_above"), "label", "place")
        few = options.limit(100_001).count() <= 100_000
        offered = chosen.join(F.broadcast(options) if few else options, "_above").withColumn("_w", weight.cast("double"))
        made = offered.groupBy(*key).agg(F.max_by("label", F.struct("_w", -F.col("place"))).alias("label"), (F.max("_w") / F.sum("_w")).alias("p"))
        made = staged(made, f"level-{level}")
        found.append(made.select(*key, F.lit(level).alias("level"), "label", "p"))
        chosen = cases.join(made.select(*key, F.col("label").alias("_above")), key)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


class UnknownIds(ValueError):
    """Ids that are neither in the universe nor retired."""


def within_universe(rows: DataFrame, universe: DataFrame, retired: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``universe`` and not ``retired``.  A key that is in neither is an error in the input, not something to
    leave out; the error names the five smallest.  A retired key leaves, also where the universe has it."""
    left = rows.join(retired.select(key).distinct(), key, "left_anti")
    strange = left.join(universe.select(key), key, "left_anti").select(key).distinct().orderBy(key).limit(5).collect()
    if strange:
        raise UnknownIds(f"{key} not known: {', '.join(str(r[0]) for r in strange)}")
    return left
