"""Ranks, order statistics by index, step-down correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(rows: DataFrame, by: list[str], value: str, at: dict[str, Column]) -> DataFrame:
    """(by, n, names of ``at``): the values at zero-based places of the sorted non-null values of each group.

    ``at`` gives places as expressions over ``n``, the group's count; a place outside the group gives null.  Equal values
    are counted before anything is sorted, so a group of many rows costs as much as it has different values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    upto = counts.select("*", F.sum("c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(group).alias("n"))
    inside = lambda place: (place >= F.col("upto") - F.col("c")) & (place < F.col("upto"))
    return upto.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(inside(p), F.col(value))).alias(name) for name, p in at.items()])


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the rank of ``value`` within each group, equal values sharing their mean rank."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    below = F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn(name, below - F.col("_c") + (F.col("_c") + 1) / 2).drop("_c")
    return rows.join(ranked, [*by, value])


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): correlation of the average ranks; null where either side has no variance."""
    ranked = average_ranks(average_ranks(rows, by, x, "rank_x"), by, y, "rank_y")
    spread = (F.stddev_pop("rank_x") > 0) & (F.stddev_pop("rank_y") > 0)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(spread, F.corr("rank_x", "rank_y")).alias("rho"))


def holm(tests: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """``tests`` with ``p_holm``: the step-down adjusted p of each test of a family; a missing p keeps its place as 1.

    A family is a list of planned tests, not of rows, so its window is small.
    """
    filled = tests.withColumn("_p", F.coalesce(p, F.lit(1.0)))
    ordered = Window.partitionBy(*family).orderBy("_p", *order)
    left = F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(ordered) + 1
    stepped = filled.withColumn("_s", F.least(F.lit(1.0), left * F.col("_p")))
    return stepped.withColumn("p_holm", F.max("_s").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_s")
