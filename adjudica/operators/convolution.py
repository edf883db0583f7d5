"""Chances of sums of independent trials, by merging distributions pairwise in rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.operators.folding import staged
from adjudica.sources.files import running_ids

#: Mass that may be cut off either end of a distribution, so it has as many numbers as its spread needs, not as it has trials.
CUT = 1e-18
#: Products beyond so many terms go by Fourier transform.
DIRECT = 1 << 22

_SCHEMA = "low long, mass array<double>"


def binomial(n: int, p: float) -> tuple[int, np.ndarray]:
    """(least number of successes, chances from there on) of ``n`` trials, without tails of at most ``CUT``."""
    if p <= 0 or p >= 1:
        return (0 if p <= 0 else n), np.ones(1)
    reach = int(10 * math.sqrt(n * p * (1 - p)) + 60)  # beyond it, far less than ``CUT`` is left
    low, high = max(0, int(n * p) - reach), min(n, int(n * p) + reach)
    k = np.arange(low, high + 1)
    steps = np.log((n - k[:-1]) / (k[:-1] + 1)) + math.log(p) - math.log1p(-p)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(logs - logs.max())
    return trimmed(low, mass / mass.sum())


def trimmed(low: int, mass: np.ndarray) -> tuple[int, np.ndarray]:
    """Without the tails that hold at most ``CUT`` each."""
    a, b = np.searchsorted(np.cumsum(mass), CUT, "right"), np.searchsorted(np.cumsum(mass[::-1]), CUT, "right")
    return low + int(a), mass[a : max(a + 1, len(mass) - b)]


def product(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The distribution of the sum."""
    (low, a), (other, b) = x, y
    if len(a) * len(b) <= DIRECT:
        mass = np.convolve(a, b)
    else:
        n = len(a) + len(b) - 1
        size = 1 << (n - 1).bit_length()
        mass = np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n], 0)
    return trimmed(low + other, mass)


def _row(batch: pa.RecordBatch, k: int, by: Sequence[str], low: int, mass: np.ndarray, idx: int | None) -> pa.RecordBatch:
    own = [batch.column(c).slice(k, 1) for c in by]
    place = [] if idx is None else [pa.array([idx], pa.int64())]
    return pa.RecordBatch.from_arrays([*own, *place, pa.array([low], pa.int64()), pa.array([mass], pa.list_(pa.float64()))], names=[*by, *(["idx"] if place else []), "low", "mass"])


def sums_of_trials(trials: DataFrame, by: Sequence[str], p: str) -> DataFrame:
    """(by, low, mass): for each group of rows, the chances of ``low``, ``low`` + 1, ... successes among trials of chance ``p`` each.

    Trials of one chance are counted before they move, and give a binomial distribution each.  Then two and two of a group
    are merged, in as many rounds as it takes; a task holds the two it merges, each some ten standard deviations wide.
    Null chances take no part; those outside 0 to 1 count as 0 or 1.
    """
    keys = ", ".join(f"`{c}` {trials.schema[c].dataType.simpleString()}" for c in by)
    folded = trials.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.count("*").alias("n"))
    folded = running_ids(folded.withColumn("group", F.struct(*by)), "group", "p", "idx").drop("group")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (n, chance, idx) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "p", "idx")), strict=True)):
                yield _row(batch, k, by, *binomial(n, chance), idx)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (pair, idx) in enumerate(zip(batch.column("pair").to_pylist(), batch.column("half").to_pylist(), strict=True)):
                parts = [(x["low"], np.array(x["mass"])) for x in pair]
                yield _row(batch, k, by, *(product(*parts) if len(parts) > 1 else parts[0]), idx)

    made = staged(folded.mapInArrow(leaves, f"{keys}, idx long, {_SCHEMA}"), "trials")
    while (made.agg(F.max("idx")).first()[0] or 0) > 0:
        pairs = made.groupBy(*by, F.floor(F.col("idx") / 2).alias("half")).agg(F.sort_array(F.collect_list(F.struct("low", "mass"))).alias("pair"))  # two at most
        made = staged(pairs.mapInArrow(merged, f"{keys}, idx long, {_SCHEMA}"), "trials")
    return made.select(*by, "low", "mass")


def at_least(low, mass, k):
    """Chance of ``k`` successes or more, as an expression over the columns of :func:`sums_of_trials`."""
    size = F.size(mass)
    first = F.greatest(F.lit(1), F.least(k - low + 1, size + 1)).cast("int")
    tail = F.aggregate(F.slice(mass, first, F.greatest(size - first + 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(k <= low, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))
