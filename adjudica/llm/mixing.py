"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the mix over its present share.  A document is repeated
k times, k drawn from a Poisson distribution of that mean by inverting it at a uniform number hashed from the seed and
the row's key: no state, the same for any partitioning, and re-run tasks draw the same.  The key is the id; where ids are
null or repeat, it is the id, the text's md5 and the row's number among those alike in both, so that no two rows draw
alike.  Copies are exploded and dealt out by a hash of (key, copy), which is the global shuffle.  Everything is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.llm.shared import join_folded, materialise, small

#: Sources whose rates are broadcast; beyond that only the hot ones are.
BROADCAST_SOURCES = 100_000
#: A mean above this is drawn as the sum of several equal parts, so that exp(-mean) stays far from underflow.
PART = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts joined by ':'."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(mean: Column, parts: Column, seed: int, key: Column) -> Column:
    """The Poisson count of ``mean``: ``parts`` draws of mean / parts each, each the number of terms of the distribution
    function that do not exceed its uniform number.

    Terms are summed until 1 - 1e-12 of a part of at most PART is passed, which 96 terms always do; a uniform number has
    52 bits, so the tail that remains has a chance below 1e-12 a draw.
    """
    each = mean / parts
    state = F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("cdf"), F.lit(0).cast("long").alias("k"))

    def draw(i: Column) -> Column:
        u = uniform(F.lit(seed), key, i)

        def term(s: Column, n: Column) -> Column:
            p = s["p"] * each / n
            more = F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), n.cast("long").alias("k"))
            return F.when(s["cdf"] <= u, more).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.lit(96)), state, term)["k"]

    return F.aggregate(F.sequence(F.lit(1).cast("long"), parts.cast("long")), F.lit(0).cast("long"), lambda n, i: n + draw(i))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, source_col: str, size: float) -> DataFrame:
    """(source, n, rate): the source's rows, and its target share over its present share, times ``size``.

    Without ``weights`` the target is the present share to the power ``alpha``, normalised.  With ``weights``, sources
    that are not named have the target 0 and leave the mix; the weights of sources that are present are normalised.
    """
    counts = materialise(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")), "mix-sources")
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        counts = counts.withColumn("w", F.coalesce(given[F.col("source")], F.lit(0.0)))
    all_n, all_w = counts.agg(F.sum("n"), F.sum("w")).first()
    if not all_w:  # no rows, or no weight for any source that is there
        return counts.select("source", "n", F.lit(0.0).alias("rate"))
    return counts.select("source", "n", (F.col("w") / F.lit(all_w) * F.lit(all_n) / F.col("n") * F.lit(float(size))).alias("rate"))


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as struct ``row`` with ``key``, a string that no two rows share: the id as text, or, for ids that are null
    or repeat, ``id:md5:number``.

    Rows that share id and text are numbered from 0 by their number in their partition and the counts of the partitions
    before it, so a group of any size is split by partition; rows of unique ids do not move.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    repeated = materialise(docs.groupBy(F.col(id_col).alias("of")).agg(F.count("*").alias("n")).where("n > 1 OR of IS NULL"), "mix-repeated")
    n_repeated, n_rows = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_repeated:
        return rows.select("row", F.col("id").cast("string").alias("key"))
    content = F.md5(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))) if text_col in docs.columns else F.lit("")
    alone = rows.join(small(repeated, n_repeated), F.col("of").eqNullSafe(F.col("id")), "left_anti").select("row", F.col("id").cast("string").alias("key"))
    if n_repeated <= BROADCAST_SOURCES:
        others = rows.join(F.broadcast(repeated), F.col("of").eqNullSafe(F.col("id"))).select("row", "id")
    else:
        others = join_folded(rows, repeated.withColumnRenamed("of", "id"), ["id"], n_rows).select("row", "id")
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    others = materialise(others.select("row", text_id.alias("id"), content.alias("md5"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "mix-alike")
    group = ["id", "md5", "part"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id", "md5").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = others.groupBy(*group).agg(F.count("*").alias("n")).select(*group, before.alias("before"))
    placed = others.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy("place")) - 1).join(offsets, group)
    return alone.unionByName(placed.select("row", F.concat_ws(":", "id", "md5", F.col("number") + F.col("before")).alias("key")))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    alpha: float = 0.5,
    size: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """``docs`` replicated to the target mix: all columns as they came in struct ``row``, plus ``rate``, ``copies``,
    ``copy_no`` (from 0) and ``mix_key``, the copy's place in the shuffled order.

    A null source is a source like any other.  Rows draw independently, those with null or repeated ids too (see
    :func:`row_keys`; without the column ``text_col`` they are told apart by number alone).  An empty table gives none.  The rates join through a broadcast behind a count of sources, and beyond
    ``broadcast_sources`` by a shuffle of all but the hot sources.  A hot source needs no salt: its rows never move for
    the join, and are dealt out by the hash of each copy.
    """
    rates = source_rates(docs, weights, alpha, source_col, size)
    rows = row_keys(docs, id_col, text_col).select("row", "key", F.col(f"row.`{source_col}`").alias("source"))
    sources, n_rows = rates.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if sources <= broadcast_sources:
        known = F.broadcast(rates.withColumnRenamed("source", "of"))
        rated = rows.join(known, F.col("of").eqNullSafe(F.col("source")))
    else:
        rated = join_folded(rows, rates, ["source"], n_rows)
    rated = rated.select("row", "key", "rate")
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rate") / PART))
    drawn = rated.withColumn("copies", poisson(F.col("rate"), parts, seed, F.col("key"))).where("copies > 0")
    copies = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy_no"))
    keyed = copies.withColumn("mix_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("key"), F.col("copy_no").cast("string"))), 14, 13), 16, 10).cast("long"))
    return keyed.repartition("mix_key", "copy_no").sortWithinPartitions("mix_key", "key", "copy_no").select("row", "rate", "copies", "copy_no", "mix_key")
