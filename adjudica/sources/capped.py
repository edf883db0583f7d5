"""A table behind a service that refuses large answers, read whole by halving ranges of its key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Refused(RuntimeError):
    """An answer would have more rows than the service gives."""


class Service:
    """Counts and rows of key ranges of a Parquet table; more than ``cap`` rows at a time are refused."""

    def __init__(self, path: str, key: str, cap: int):
        self.table, self.key, self.cap = ds.dataset(path, format="parquet"), key, cap

    def _within(self, low: int | None, high: int | None) -> ds.Expression:
        field = ds.field(self.key)
        return field.is_null() if low is None else (field >= low) & (field < high)

    def count(self, low: int | None, high: int | None) -> int:
        return self.table.count_rows(filter=self._within(low, high))

    def bounds(self) -> tuple[int, int] | None:
        """The least and the greatest key."""
        least = most = None
        for batch in self.table.to_batches(columns=[self.key]):
            found = pa.compute.min_max(batch.column(0)).as_py()
            if found["min"] is not None:
                least = found["min"] if least is None else min(least, found["min"])
                most = found["max"] if most is None else max(most, found["max"])
        return None if least is None else (least, most)

    def fetch(self, low: int | None, high: int | None, columns: list[str]) -> Iterator[pa.RecordBatch]:
        if (n := self.count(low, high)) > self.cap:
            raise Refused(f"{n} rows of keys {low} to {high}; the service gives {self.cap}")
        yield from self.table.to_batches(columns=columns, filter=self._within(low, high))


@dataclass
class Range(InputPartition):
    """Keys from ``low`` to before ``high``; no bounds: rows without a key."""

    low: int | None
    high: int | None


def halved(count, low: int, high: int, cap: int) -> Iterator[tuple[int, int]]:
    """Ranges that cover [low, high) with at most ``cap`` rows each, empty ones left out; one key with more is refused."""
    n = count(low, high)
    if n > cap:
        if high - low == 1:
            raise Refused(f"key {low} has {n} rows; the service gives {cap}")
        middle = (low + high) // 2
        yield from halved(count, low, middle, cap)
        yield from halved(count, middle, high, cap)
    elif n:
        yield low, high


class CappedSource(DataSource):
    """Format ``capped``; options path, key (an integer column), cap, and the schema to read.  Nothing is left out: a range that the
    service would cut is asked for in halves, each a partition."""

    @classmethod
    def name(cls) -> str:
        return "capped"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.key, self.cap = options["path"], options["key"], int(options["cap"])
        self.columns = [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        service = Service(self.path, self.key, self.cap)
        bounds = service.bounds()
        found = [Range(a, b) for a, b in halved(service.count, bounds[0], bounds[1] + 1, self.cap)] if bounds else []
        return found + [Range(None, None)] * bool(service.count(None, None)) or [Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from Service(self.path, self.key, self.cap).fetch(partition.low, partition.high, self.columns)
