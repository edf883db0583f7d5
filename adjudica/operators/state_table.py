"""A keyed state table: copy-on-write by hash of the key, with snapshots that are swapped in as a whole.

Data lie in folders of one part of the keys each; a snapshot is a small file that lists the folder of every part.  A merge
reads and writes the parts that its updates touch, and lists the old folders of the others again.  A snapshot's file is
written aside and renamed to the next number, which fails if another writer was first: readers see one state or the
other, never half of one, and older snapshots stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a column of the state takes in a new value.
RULES = {"max": F.max, "min": F.min, "sum": F.sum, "first": lambda c: F.min_by(c, "_age"), "last": lambda c: F.max_by(c, "_age")}


class Conflict(RuntimeError):
    """Another writer has committed the same snapshot."""


class StateTable:
    """State of ``key`` columns and one column for each of ``rules`` (a name of :data:`RULES`), in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], rules: Mapping[str, str], parts: int = 16):
        self.spark, self.root, self.key, self.rules, self.parts = spark, root.rstrip("/"), list(key), dict(rules), parts
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self) -> object:
        return self._path("snapshots").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def snapshots(self) -> list[int]:
        """The numbers of the snapshots, oldest first."""
        files, folder = self._files(), self._path("snapshots")
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def folders(self, snapshot: int | None = None) -> dict[int, str]:
        """The folder of each part that has rows, in a snapshot (default: the newest)."""
        known = self.snapshots()
        if not known:
            return {}
        return {int(k): v for k, v in self._listed(known[-1] if snapshot is None else snapshot)["parts"].items()}

    def _listed(self, snapshot: int) -> dict:
        lines = self.spark.read.text(f"{self.root}/snapshots/{snapshot}.json", wholetext=True).collect()
        return json.loads(lines[0][0])

    def read(self, snapshot: int | None = None) -> DataFrame | None:
        """The state as of a snapshot (default: the newest), or None before the first."""
        known = self.snapshots()
        if not known:
            return None
        number = known[-1] if snapshot is None else snapshot
        return self._read(self._listed(number), None)

    def _read(self, listed: dict, only: set[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(listed["schema"])
        paths = [p for k, p in listed["parts"].items() if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def merge(self, updates: DataFrame) -> int:
        """Takes ``updates`` (the key and the ruled columns; keys may repeat) into the state; returns the new snapshot's number.

        Old rows and updates of a key meet in a grouped aggregate, which combines before it shuffles.  At most ``parts``
        numbers reach the driver.  A lost executor costs its tasks; a failed merge leaves no snapshot.
        """
        columns = [*self.key, *self.rules]
        updates = updates.select(*columns, F.lit(1).alias("_age"), self._part().alias("_part"))
        touched = {r[0] for r in updates.select("_part").distinct().collect()}
        known = self.snapshots()
        listed = self._listed(known[-1]) if known else {"parts": {}, "schema": json.loads(updates.select(*columns).schema.json())}
        if listed["parts"].keys() & {str(p) for p in touched}:
            old = self._read(listed, touched).select(*columns, F.lit(0).alias("_age"), self._part().alias("_part"))
            updates = old.unionByName(updates)
        merged = updates.groupBy("_part", *self.key).agg(*[RULES[rule](F.col(c)).alias(c) for c, rule in self.rules.items()])
        made = uuid.uuid4().hex
        merged.repartition("_part").write.partitionBy("_part").parquet(f"{self.root}/data/{made}")
        listed["parts"] |= {str(p): f"{made}/_part={p}" for p in touched}
        return self._commit(listed, (known[-1] if known else 0) + 1)

    def _commit(self, listed: dict, number: int) -> int:
        files = self._files()
        aside = self._path(f"snapshots/.{uuid.uuid4().hex}")
        out = files.create(aside, True)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path(f"snapshots/{number}.json"), gateway.new_array(rename, 0))
        except Exception as error:
            files.delete(aside, False)
            if number in self.snapshots():
                raise Conflict(f"snapshot {number} is there already") from error
            raise
        return number
