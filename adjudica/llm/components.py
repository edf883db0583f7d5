"""Connected components by alternating large-star and small-star steps, all joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.llm.shared import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour to the least.  The node of a giant component is a hot key of the join, which adaptive
    execution splits: rows of the join have two numbers each, and its other side one row a node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def component_roots(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the bigint edge list ``edges`` (u, v) that isn't the least of its component.

    ``root`` is the least node of the component.  Loops and repeated edges do no harm; no edges give no rows.  Each round
    writes its edges to the shared folder, so a lost executor costs one round; only counts and checksums reach the driver.
    The number of rounds is logarithmic in the length of the longest chain, and edges never grow in number.
    """
    edges = materialise(edges.where("u <> v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = materialise(_small_star(_large_star(edges)), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select("u", F.col("v").alias("root"))
