"""Sharding by jump consistent hashing: stable keys to shards without a ring table.

The jump walk is a fold over integers: each step draws the next state of the 64-bit linear congruential generator and
jumps to the next shard count at which the key would move.  Spark's ANSI arithmetic refuses to wrap, so the state is
kept in limbs of 22, 22 and 20 bits whose products fit a bigint.  The slot in a shard is a rank computed without a task
per shard: a range sort spreads every shard over tasks, and a shard's offset in a task is the number of its rows before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.llm.shared import materialise, small

#: The multiplier of the published generator, and the limb masks.
MULTIPLIER = 2862933555777941757
LIMB, TOP = (1 << 22) - 1, (1 << 20) - 1


def jump_shards(key: Column, shards: int) -> tuple[Column, Column]:
    """(shard among ``shards``, shard among ``shards + 1``) of a bigint key.

    Both come from one walk: the walk for one more shard only goes on from where the other ends.  Each step moves ahead
    by one shard at least, so ``shards + 1`` steps always suffice.
    """
    m0, m1, m2 = MULTIPLIER & LIMB, (MULTIPLIER >> 22) & LIMB, MULTIPLIER >> 44

    k0, k1, k2 = key.bitwiseAND(LIMB), F.shiftright(key, 22).bitwiseAND(LIMB), F.shiftright(key, 44).bitwiseAND(TOP)
    start = F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def walk(s: Column, _: Column) -> Column:
        c0 = s["k0"] * F.lit(m0).cast("long") + 1
        c1 = s["k0"] * F.lit(m1).cast("long") + s["k1"] * F.lit(m0).cast("long") + F.shiftright(c0, 22)
        c2 = s["k0"] * F.lit(m2).cast("long") + s["k1"] * F.lit(m1).cast("long") + s["k2"] * F.lit(m0).cast("long") + F.shiftright(c1, 22)
        low, top = c1.bitwiseAND(LIMB), c2.bitwiseAND(TOP)
        draw = F.shiftleft(top, 11) + F.shiftright(low, 11)  # the generator's upper 31 bits
        nxt = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (draw + 1).cast("double")))
        moved = F.struct(
            c0.bitwiseAND(LIMB).alias("k0"), low.alias("k1"), top.alias("k2"), nxt.cast("long").alias("j"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["a"]).alias("a"), s["j"].alias("b"),
        )
        return F.when(s["j"] <= shards, moved).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, walk)
    return end["a"].cast("int"), end["b"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, by the law ``key``.

    size is the UTF-8 bytes of the text (null: none) plus 1.  The id and the number of shards alone decide the shard; a
    null id counts as the key 0; one more shard takes rows only into itself (``grown_shard``).  Slots count from 0 in the
    order (doc_id, size, text_crc32), null ids first; equal rows take neighbouring slots.  An id with a third of all rows
    is spread over tasks like any other range, as a row number given at the scan breaks ties.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    shard, grown = jump_shards(F.coalesce(F.col(id_col), F.lit(0)).cast("long"), shards)
    read = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row_no"))
    walked = read.select("*", F.struct(shard.alias("shard"), grown.alias("grown_shard")).alias("w")).select("*", "w.*").drop("w")
    rows = materialise(walked, "shard-rows")
    order = ["shard", "doc_id", "size", "text_crc32", "row_no"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    spread = materialise(spread.drop("row_no"), "shard-order").withColumn("task", F.shiftright("place", 33))
    spans = spread.groupBy("task", "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("task", "shard", (before - F.col("first")).alias("shift"))
    return spread.join(small(spans), ["task", "shard"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard")
