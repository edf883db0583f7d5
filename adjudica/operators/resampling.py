"""Bootstrap as data: a table of draws joined with units, then grouped by replicate.

A unit is the thing that is drawn (a case, or a cluster of cases) already folded to what the statistic needs, so a
replicate costs as many rows as there are units, not as there are decisions.  The draw of replicate r at position i is
floor(u * n), u hashed from (seed, stratum, r, i): the same on every engine and for any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.functions.draws import draws as drawn
from adjudica.operators.folding import staged
from adjudica.sources.files import running_ids

#: Units, some numbers each, that are broadcast to the draws.
BROADCAST_UNITS = 500_000
#: Bytes of units' numbers that are broadcast to the tasks of :func:`replicate_sums`.
BROADCAST_BYTES = 64 << 20
#: Beyond that: positions that a task draws at a time, units of a block (two bytes tell one), replicates that meet a block at a time.
POSITIONS, BLOCK_UNITS, REPLICATES_AT_ONCE = 1 << 22, 1 << 16, 64


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def resampled(units: DataFrame, stratum: str, unit: str, replicates: int, seed: int) -> DataFrame:
    """``units`` drawn with replacement within each stratum: their columns, once for each draw, and ``rep``.

    Replicates are dealt over the tasks, and a task draws whole replicates, so a grouped aggregate by stratum and replicate
    combines before it shuffles.  Up to ``BROADCAST_UNITS`` units, draws find theirs without moving.  Units are
    numbered by ranges, whatever their key.
    """
    units = staged(units, "units")
    placed = running_ids(units, stratum, unit, "_at")
    placed = staged(placed.withColumn("_at", F.col("_at").cast("int")), "placed")
    sizes = placed.groupBy(stratum).agg(F.count("*").alias("_m"))
    span = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    replicate = sizes.select(stratum, "_m", F.explode(span(F.lit(replicates))).alias("rep"))
    replicate = replicate.repartition(2 * units.sparkSession.sparkContext.defaultParallelism, stratum, "rep")
    draws = replicate.select("*", F.explode(span(F.col("_m"))).alias("_pos"))
    index = F.floor(hashed_uniform(F.lit(seed), F.col(stratum), F.col("rep"), F.col("_pos")) * F.col("_m")).cast("int")
    held = F.broadcast(placed) if placed.count() <= BROADCAST_UNITS else placed
    return draws.select(stratum, "rep", index.alias("_at")).join(held, [stratum, "_at"]).drop("_at")


def _placed(units: DataFrame, stratum: str, unit: str) -> DataFrame:
    """``units`` of a known stratum with ``_at``, their number within it by ranges of ``unit``, and ``_text``, the stratum as it is hashed."""
    placed = running_ids(staged(units.where(F.col(stratum).isNotNull()), "units"), stratum, unit, "_at")
    return staged(placed.withColumn("_text", F.col(stratum).cast("string")), "placed")


def replicate_sums(units: DataFrame, stratum: str, unit: str, values: list[str], replicates: int, seed: int) -> DataFrame:
    """(stratum, rep, sum_<value>, count_<value> of each of ``values``): the draws of :func:`resampled`, folded by replicate.

    Nulls and NaN add nothing and are not counted.  A draw is no row: a task draws whole replicates in arrays and adds them up there,
    with the units' numbers broadcast up to ``BROADCAST_BYTES``.  Beyond, a task sends each block of units the places that a
    replicate draws from it, two bytes a draw, and the sums are made where the block is; no task holds more than
    ``POSITIONS`` draws of a replicate, or a block and the draws of ``REPLICATES_AT_ONCE`` replicates.
    """
    placed = _placed(units, stratum, unit)
    sizes = staged(placed.groupBy("_text").agg(F.count("*").alias("_m")), "strata")
    n_units, longest = sizes.agg(F.coalesce(F.sum("_m"), F.lit(0)), F.coalesce(F.max("_m"), F.lit(0))).first()
    fits = n_units * 8 * len(values) <= BROADCAST_BYTES
    step = max(longest, 1) if fits else POSITIONS
    stripes = F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / step)))
    dealt = sizes.select("_text", "_m", stripes.alias("_stripe")).select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    dealt = dealt.repartition(4 * units.sparkSession.sparkContext.defaultParallelism, "_text", "_stripe", "rep")
    columns = [f"{what}_{v}" for v in values for what in ("sum", "count")]
    schema = ", ".join(["_text string", "rep int", *[f"{c} {'double' if c.startswith('sum_') else 'long'}" for c in columns]])
    folded = _held_sums(dealt, placed, values, seed, schema) if fits else _sent_sums(dealt, placed, values, seed, step, schema)
    typed = F.col("_text").cast(units.schema[stratum].dataType).alias(stratum)
    return folded.groupBy(typed, "rep").agg(*[F.sum(c).alias(c) for c in columns])


def _held_sums(dealt: DataFrame, placed: DataFrame, values: list[str], seed: int, schema: str) -> DataFrame:
    """Sums of whole replicates, the units' numbers broadcast."""
    table = placed.select("_text", "_at", *values).toArrow()
    held = {}
    texts = table["_text"].combine_chunks().dictionary_encode()
    codes, at = texts.indices.to_numpy(zero_copy_only=False), table["_at"].to_numpy()
    for code, text in enumerate(texts.dictionary.to_pylist()):
        of, held[text] = codes == code, []
        for v in values:
            numbers = np.empty(int(of.sum()))
            numbers[at[of]] = table[v].cast(pa.float64()).to_numpy()[of]
            there = ~np.isnan(numbers)
            held[text].append((np.nan_to_num(numbers), None if there.all() else there))
    shared = placed.sparkSession.sparkContext.broadcast(held)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for text, of in rows.groupby("_text"):
                n, columns = int(of["_m"].iloc[0]), shared.value[text]
                found = {int(rep): np.zeros(2 * len(columns)) for rep in of["rep"]}
                for reps, indices in drawn(f"{seed}:{text}", list(found), n, 0, n):
                    sums = []
                    for numbers, there in columns:
                        sums += [numbers[indices].sum(axis=1), np.full(len(reps), indices.shape[1]) if there is None else there[indices].sum(axis=1)]
                    for rep, row in zip(reps.tolist(), np.stack(sums, axis=1), strict=True):
                        found[rep] += row
                made = np.stack(list(found.values()))
                arrays = [pa.array(made[:, k] if k % 2 == 0 else made[:, k].astype(np.int64)) for k in range(made.shape[1])]
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([text] * len(found)), pa.array(list(found), pa.int32()), *arrays], names)

    return dealt.select("_text", "_m", "rep").mapInArrow(fold, schema)


def _sent_sums(dealt: DataFrame, placed: DataFrame, values: list[str], seed: int, step: int, schema: str) -> DataFrame:
    """Sums of replicates by blocks of units, each of which gets the places that are drawn from it."""
    sent = "_text string, _block long, _part int, rep int, _spots binary"

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, low = row["_m"], row["_stripe"] * step
                found = np.concatenate([i[0] for _, i in drawn(f"{seed}:{row['_text']}", [row["rep"]], n, low, min(low + step, n))])
                found.sort()
                blocks = np.arange(-(-n // BLOCK_UNITS))
                cuts = np.searchsorted(found, np.append(blocks, len(blocks)) * BLOCK_UNITS)
                places = (found % BLOCK_UNITS).astype(np.uint16)
                parts = [places[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                size = len(blocks)
                arrays = [pa.array([row["_text"]] * size), pa.array(blocks), pa.array([row["rep"] // REPLICATES_AT_ONCE] * size, pa.int32()), pa.array([row["rep"]] * size, pa.int32()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in sent.split(", ")])

    def fold(places: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = []
        for v in values:
            numbers = np.full(BLOCK_UNITS, np.nan)
            numbers[(block["_at"] % BLOCK_UNITS).to_numpy()] = block[v].to_numpy(np.float64, na_value=np.nan)
            columns.append((np.nan_to_num(numbers), ~np.isnan(numbers)))
        made = []
        for text, rep, raw in zip(places["_text"], places["rep"], places["_spots"], strict=True):
            at = np.frombuffer(raw, np.uint16)
            made.append([text, rep, *[x for numbers, there in columns for x in (numbers[at].sum(), int(there[at].sum()))]])
        return pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")])

    draws = dealt.mapInArrow(spots, sent)
    last = dealt.agg(F.max("rep")).first()[0] or 0
    parts = F.explode(F.sequence(F.lit(0), F.lit(last // REPLICATES_AT_ONCE))).alias("_part")
    blocks = placed.select("_text", F.floor(F.col("_at") / BLOCK_UNITS).alias("_block"), "_at", *[F.col(v).cast("double").alias(v) for v in values], parts)
    key = ("_text", "_block", "_part")
    return draws.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInPandas(fold, schema)


def percentile_interval(replicates: DataFrame, by: list[str], value: str, count: int, alpha: float = 0.05) -> DataFrame:
    """(by, mean, low, high): order statistics at int(R * a / 2) and int(R * (1 - a / 2)) - 1; null replicates are left out
    of the mean and rank last."""
    low, high = int(count * alpha / 2), int(count * (1 - alpha / 2)) - 1
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), "rep")) - 1
    ranked = replicates.withColumn("_k", rank)
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col(value)))
    return ranked.groupBy(*by).agg(F.avg(value).alias("mean"), at(low).alias("low"), at(high).alias("high"))
