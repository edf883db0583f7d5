"""Places, running counts and dense names in a global order, with no task that holds a group.

Rows are dealt by ranges of the whole order, ties broken by columns that differ, so rows of one key are spread like any
others.  Each task counts its own rows; what came before it is a sum over one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.llm.shared import materialise


def _moved(rows: DataFrame, sums: Mapping[int, Sequence[int]], names: Sequence[str], shift: Mapping[int, int] | None = None) -> DataFrame:
    """``rows`` with ``names`` raised, for each ``_task``, by ``sums`` over the tasks before it, of which one row a task has come to
    the driver; the first of ``names`` less ``shift`` of the own task."""
    table = np.zeros((len(names), max(sums, default=0) + 2), np.int64)
    for task, values in sums.items():
        table[:, task + 1] = values
    table = np.cumsum(table, axis=1)
    for task, by in (shift or {}).items():
        table[0, task] -= by
    return rows.withColumns({n: F.col(n) + F.get(F.lit(table[k]), F.col("_task").cast("int")) for k, n in enumerate(names)})


def running_counts(rows: DataFrame, order: Sequence[Column | str], weights: Mapping[str, Column], name: str) -> DataFrame:
    """``rows`` with, for each of ``weights``, the sum of its bigint expression over the rows before this one in ``order``.

    ``order`` should tell all rows apart; rows that it doesn't come in any order.  The result reads one written table, which
    :func:`shared.release` deletes.
    """
    names = list(weights)
    rows = rows.withColumns({f"w_{n}": w.cast("long") for n, w in weights.items()})
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType()) for n in names], T.StructField("_task", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sums = TaskContext.get().partitionId(), dict.fromkeys(names, 0)
        for batch in batches:
            made = []
            for n in names:
                w = batch.column(f"w_{n}").to_numpy(zero_copy_only=False)
                made.append(pa.array(np.cumsum(w) - w + sums[n], pa.int64()))
                sums[n] += int(w.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(np.full(batch.num_rows, task), pa.int64())], names=schema.names)

    counted = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, schema), name)
    stored = counted
    totals = counted.groupBy("_task").agg(*[F.sum(f"w_{n}").alias(n) for n in names]).collect()
    counted = _moved(counted, {t["_task"]: [t[n] for n in names] for t in totals}, names).drop("_task", *[f"w_{n}" for n in names])
    counted.stored_at = stored.stored_at
    return counted


def dense_names(rows: DataFrame, key: Sequence[str], ties: Sequence[str], name: str, *, alone: bool = False) -> DataFrame:
    """``rows`` without ``key`` but with ``named``: 1, 2, ... in the order of ``key``, equal keys alike, and ``place``: 0, 1, ...
    in the order of ``key`` and ``ties``.  ``ties`` tell all rows of a key apart.  With ``alone`` there is a column of that name too: true only
    if no other row has the key, and not always then.  The result reads one written table."""
    kept = [f for f in rows.schema.fields if f.name not in key]
    edge = T.StructType([rows.schema[k] for k in key])
    single = [T.StructField("alone", T.BooleanType())] * alone
    schema = T.StructType([*kept, *single, *[T.StructField(n, T.LongType()) for n in ("named", "place", "_task")], T.StructField("_edge", edge)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, names, seen = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in key]
            fresh = np.zeros(batch.num_rows, bool)
            for c in columns:
                values = c.to_numpy(zero_copy_only=False)
                fresh[1:] |= values[1:] != values[:-1]
            first, last_was = tuple(c[0].as_py() for c in columns), last
            fresh[0] = first != last_was
            last = tuple(c[batch.num_rows - 1].as_py() for c in columns)
            own = names + np.cumsum(fresh)
            at = seen + np.arange(batch.num_rows)
            names, seen = int(own[-1]), seen + batch.num_rows
            inner = np.ones(batch.num_rows, bool)
            inner[[0, -1]] = False
            edges = pa.StructArray.from_arrays([*columns], names=list(key), mask=pa.array(inner))  # the first and last key of a batch
            edges = edges.take(pa.array(np.arange(batch.num_rows), mask=inner))  # without the bytes of the others
            lone = np.append(fresh[1:], False)
            lone[1:] &= fresh[1:]
            lone[0] = False  # what is next to a batch isn't seen
            data = [*[batch.column(f.name) for f in kept], *[pa.array(lone)] * alone, pa.array(own, pa.int64()), pa.array(at, pa.int64()), pa.array(np.full(batch.num_rows, task), pa.int64()), edges]
            yield pa.RecordBatch.from_arrays(data, names=schema.names)

    order = [*key, *ties]
    done = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(named, schema), name)
    of_task = done.groupBy("_task").agg(F.max("named").alias("names"), F.count("*").alias("n"), F.min("_edge").alias("first"), F.max("_edge").alias("last"))
    sums, shared, last = {}, {}, None
    for t in sorted(of_task.collect(), key=lambda t: t["_task"]):
        shared[t["_task"]] = int(t["first"] == last)  # the first name goes on from the task before
        sums[t["_task"]], last = (t["names"] - shared[t["_task"]], t["n"]), t["last"]
    joined = _moved(done, sums, ["named", "place"], shared).select(*[f.name for f in [*kept, *single]], "named", "place")
    joined.stored_at = done.stored_at
    return joined
