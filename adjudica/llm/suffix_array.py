"""Ranks of all suffixes of many strings of numbers by the difference-cover algorithm, modulus three, as Spark jobs.

Positions 1 and 2 modulo 3 are the sample.  Their triples are sorted and named; the names of each class are a string of a
third of the length, and the ranks of its suffixes (by recursion) are those of the sampled suffixes.  The others are merged
by counting: a suffix at 0 modulo 3 is held against class 1 by (symbol, rank of the next suffix) and against class 2 by (two
symbols, rank of the one after), each a sort over all strings in which a row's rank is a running count.  Rows travel as
numbers; every sort is dealt by ranges with ties broken, so no symbol, triple or string fills a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.llm.ordering import dense_names, running_counts
from adjudica.llm.shared import materialise, release

#: Rows of an Arrow batch that leaves a task.
ROWS = 200_000
#: Strings of so many symbols in all are sorted in one task, which ends the recursion: some 50 MB.
BASE = 1 << 19
#: Where one in so many sampled suffixes or fewer are not told apart by their triples, only those go on.
FEW_OPEN = 2


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, ROWS):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[at : at + ROWS]) for k, v in columns.items()})


def _exploded(strings: DataFrame, schema: str, made: Callable[..., Iterator[dict[str, np.ndarray]]], lists: list[str]) -> DataFrame:
    """Rows that ``made`` gives for (key of each symbol, its place, next(values, by how many), values of each of ``lists``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = _lists(batch.column(lists[0]))
            size = np.diff(offsets)
            key = np.repeat(batch.column("key").to_numpy(), size)
            left = np.repeat(offsets[1:], size) - np.arange(len(key))  # symbols from here to the end of the string
            idx = np.repeat(size, size) - left

            def ahead(values: np.ndarray, by: int, left: np.ndarray = left) -> np.ndarray:
                moved = np.concatenate([values[by:], np.zeros(min(by, len(values)), values.dtype)])
                return np.where(left > by, moved, 0)

            for columns in made(key, idx, ahead, *[_lists(batch.column(c))[1] for c in lists]):
                yield from _batches(columns)

    return strings.mapInArrow(run, schema)


def _triples(enough: int, key: np.ndarray, idx: np.ndarray, ahead: Callable, syms: np.ndarray, spans: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """The sampled triples; ``short``: suffixes that agree in the triple may still have to be told apart."""
    s = idx % 3 != 0
    a, b, c = syms, ahead(syms, 1), ahead(syms, 2)
    beyond = ahead(spans, 1) + ahead(spans, 2)
    short = (ahead(np.ones_like(syms), 3) > 0) & (beyond < enough)
    yield {"key": (2 * key + idx % 3 - 1)[s], "j": (idx // 3)[s], "span": (spans + beyond)[s], "short": short[s], "a": a[s], "b": b[s], "c": c[s]}


def _merging(first: bool) -> Callable:
    """Rows of the classes 0 and 1 (``first``), or 0 and 2, with what their order goes by."""

    def made(key: np.ndarray, idx: np.ndarray, ahead: Callable, syms: np.ndarray, known: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        cls = idx % 3
        s = cls != (2 if first else 1)
        after = ahead(known, 1 if first else 2)
        second = np.zeros_like(syms) if first else ahead(syms, 1)
        yield {"key": key[s], "idx": idx[s], "zero": (cls == 0)[s], "own": known[s], "a": syms[s], "b": second[s], "after": after[s]}

    return made


def _rank_strings(found: DataFrame) -> DataFrame:
    """(key, ranks) of rows (key, idx, add): the sum of ``add`` at each place of a string, in the order of places."""
    listed = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("idx", "add"))).alias("at"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at")
            offsets = at.offsets.to_numpy().astype(np.int64)
            inner = at.values.slice(offsets[0], offsets[-1] - offsets[0])
            idx, add = inner.field("idx").to_numpy(), inner.field("add").to_numpy()
            offsets = offsets - offsets[0]
            fresh = np.ones(len(idx), bool)
            fresh[1:] = idx[1:] != idx[:-1]
            fresh[offsets[:-1][offsets[:-1] < len(idx)]] = True
            starts = np.flatnonzero(fresh)
            total = np.add.reduceat(add, starts) if len(starts) else add
            ends = np.searchsorted(starts, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total))], names=["key", "ranks"])

    return listed.mapInArrow(summed, "key long, ranks array<long>")


def _few_ranks(strings: DataFrame) -> DataFrame:
    """The ranks of strings with at most ``BASE`` symbols in all, by doubling prefixes in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("key"), *_lists(b.column("syms"))) for b in batches]
        if not held:
            return
        key = pa.concat_arrays([h[0] for h in held])
        size = np.concatenate([np.diff(h[1]) for h in held])
        names = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)[1] + 1
        n, by = len(names), 1
        left = np.repeat(np.cumsum(size), size) - np.arange(n)
        while True:
            after = np.where(left > by, np.concatenate([names[by:], np.zeros(min(by, n), np.int64)]), 0)
            order = np.lexsort((after, names))
            fresh = np.ones(n, bool)
            fresh[1:] = (names[order][1:] != names[order][:-1]) | (after[order][1:] != after[order][:-1])
            names = np.empty(n, np.int64)
            names[order] = np.cumsum(fresh)
            if fresh.all() or by >= size.max():
                break
            by *= 2
        ranks = np.empty(n, np.int64)
        ranks[np.lexsort((np.arange(n), names))] = np.arange(n)
        bounds = pa.array(np.append(0, np.cumsum(size)), pa.int32())
        whole = pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(bounds, pa.array(ranks))], names=["key", "ranks"])
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)

    return strings.select("key", "syms").coalesce(1).mapInArrow(run, "key long, ranks array<long>")


def _placed(named: DataFrame) -> DataFrame:
    """(key, ranks) of rows (key, j, place)."""
    at = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("j", "place"))).alias("s"))
    return at.select("key", F.col("s.place").alias("ranks"))


def _open_strings(named: DataFrame) -> DataFrame:
    """(key, js, opens, syms, spans): of the strings of rows (key, j, named, span, open), the ``open`` symbols and those right after one.

    A symbol that isn't open is its string's last, or occurs once, or suffixes that agree in it come in any order.  So what follows it
    here, wherever that was taken from, changes no order that counts.
    """
    of_open = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("j", "open", "named", "span"))).alias("s"), F.max("open").alias("any"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s")
            offsets = s.offsets.to_numpy().astype(np.int64)
            inner = s.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets = offsets - offsets[0]
            columns = [inner.field(n).to_numpy(zero_copy_only=False) for n in ("j", "open", "named", "span")]
            kept = columns[1].copy()
            kept[1:] |= columns[1][:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            kept[starts] = columns[1][starts]
            bounds = pa.array(np.append(0, np.cumsum(kept))[offsets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.ListArray.from_arrays(bounds, pa.array(x[kept])) for x in columns]], names=["key", "js", "opens", "syms", "spans"])

    return of_open.where("any").select("key", "s").mapInArrow(run, "key long, js array<long>, opens array<boolean>, syms array<long>, spans array<long>")


def suffix_ranks(strings: DataFrame, enough: int, base: int = BASE) -> DataFrame:
    """(key, ranks) for rows (key bigint from 0, syms array of bigints from 1, spans array of the symbols' lengths).

    ``ranks`` has, for each place of the string, the rank of the suffix from there among those of all strings.  A string's end
    comes before every symbol.  Suffixes that agree in their first symbol and over a length of ``enough`` after it (or to the end of both)
    come in any order and may share a rank, but the ranks of others are never among theirs.  ``base`` is as :data:`BASE`.  Each level
    writes its tables to the shared folder.  Where most triples tell all that has to be told, only the others go on (:func:`_open_strings`).
    """
    if (strings.agg(F.sum(F.size("syms"))).first()[0] or 0) <= base:
        return materialise(_few_ranks(strings), "suffix-ranks")
    rows = _exploded(strings, "key long, j long, span long, short boolean, a long, b long, c long", partial(_triples, enough), ["syms", "spans"])
    named = dense_names(rows, ["a", "b", "c"], ["key", "j"], "suffix-triples", alone=True)
    open_ = F.col("short") & ~F.col("alone")
    n, n_open = named.agg(F.count("*"), F.count(F.when(open_, 1))).first()
    if 0 < FEW_OPEN * n_open <= n:
        shorter = materialise(_open_strings(named.withColumn("open", open_)), "suffix-open")
        told = suffix_ranks(shorter.select("key", "syms", "spans"), enough, base)
        again = shorter.join(told, "key").select("key", F.inline(F.arrays_zip("js", "opens", "syms", "ranks"))).where("opens")
        again = again.select("key", F.col("js").alias("j"), F.col("syms").alias("name"), (F.col("ranks") + 1).alias("rank"))
        closed = named.where(~open_).select("key", "j", F.col("named").alias("name"), F.lit(0).cast("long").alias("rank"))
        placed = dense_names(closed.unionByName(again), ["name", "rank"], ["key", "j"], "suffix-told")
        release(named, shorter, told)
        ranks = materialise(_placed(placed), "suffix-sampled")
        release(placed)
    elif n_open:
        shorter = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("j", "named", "span"))).alias("s"))
        shorter = materialise(shorter.select("key", F.col("s.named").alias("syms"), F.col("s.span").alias("spans")), "suffix-strings")
        release(named)
        ranks = suffix_ranks(shorter, enough, base)
        release(shorter)
    else:
        ranks = materialise(_placed(named), "suffix-sampled")
        release(named)
    none = F.lit(None).cast("array<long>")
    by_class = ranks.select(F.shiftright("key", 1).alias("key"), F.when(F.col("key") % 2 == 0, F.col("ranks")).alias("one"), F.when(F.col("key") % 2 == 1, F.col("ranks")).alias("two"), none.alias("syms"))
    together = by_class.unionByName(strings.select("key", none.alias("one"), none.alias("two"), "syms"))
    together = together.groupBy("key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("syms", "one", "two")])

    def woven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """known: at sampled places the rank from 1, else 0."""
        for batch in batches:
            offsets, syms = _lists(batch.column("syms"))
            idx = np.arange(len(syms)) - np.repeat(offsets[:-1], np.diff(offsets))
            known = np.zeros(len(syms), np.int64)
            for cls, c in ((1, "one"), (2, "two")):
                known[idx % 3 == cls] = batch.column(c).flatten().to_numpy() + 1
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("syms"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(known))], names=["key", "syms", "known"])

    whole = materialise(together.mapInArrow(woven, "key long, syms array<long>, known array<long>"), "suffix-known")
    release(ranks)
    found, held = [], [whole]
    for first in (True, False):
        schema = "key long, idx long, zero boolean, own long, a long, b long, after long"
        part = _exploded(whole, schema, _merging(first), ["syms", "known"])
        zero = F.col("zero").cast("long")
        other = F.lit(1).cast("long") if first else 1 - zero  # what a suffix of class 0 counts: its own class once
        counted = running_counts(part, ["a", "b", "after", "key", "idx"], {"zeros": zero, "others": other}, "suffix-merge")
        held.append(counted)
        found.append(counted.select("key", "idx", F.when(F.col("zero"), F.col("others")).otherwise(F.col("own") - 1 + F.col("zeros")).alias("add")))
    ranks = materialise(_rank_strings(found[0].unionByName(found[1])), "suffix-ranks")
    release(*held)
    return ranks
