"""Matching of requests to log records by content within a window of lines or times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of one content in one bin beyond which the cell is dealt over several tasks.
CROWD = 100_000


def in_windows(windows: DataFrame, records: DataFrame, content: str, width: int, *, crowd: int = CROWD) -> DataFrame:
    """Pairs of ``windows`` (``content``, since, until, ...) and ``records`` (``content``, at, ...) with since <= at < until.

    Positions are dealt into bins of ``width``: a record lies in one, a window asks those that it touches (two at most, where it
    is no wider than a bin), so this is an equi-join on content and bin with a check of the bounds.  A cell of more than
    ``crowd`` records is dealt over several parts, each of which the windows that touch it ask too; there are fewer such
    cells than records / ``crowd``, and a part has no more than about ``crowd`` records, whatever the content's share.
    Other columns must differ in name; a null content or position matches nothing.
    """
    bin_of = lambda c: F.floor(c / F.lit(width)).alias("_bin")
    placed = records.where(F.col("at").isNotNull()).select("*", bin_of(F.col("at")))
    cells = placed.groupBy(content, "_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd)
    cells = cells.select(content, "_bin", F.ceil(F.col("_n") / crowd).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    n = records.count()
    dealt = F.broadcast(cells) if n < crowd * 1_000_000 else cells
    spread = F.pmod(F.monotonically_increasing_id(), parts).cast("int").alias("_part")
    placed = placed.join(dealt, [content, "_bin"], "left").select(*placed.columns, spread)
    touched = F.explode(F.sequence(F.floor(F.col("since") / width), F.floor((F.col("until") - 1) / width))).alias("_bin")
    asking = windows.where("since < until").select("*", touched)
    asking = asking.join(dealt, [content, "_bin"], "left").select(*asking.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return asking.join(placed, [content, "_bin", "_part"]).where("at >= since AND at < until").drop("_bin", "_part")
