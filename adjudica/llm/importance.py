"""Importance resampling to a target distribution over hashed word runs.

Skewed long texts are cut in chunks at word boundaries; each chunk carries the ``n - 1`` words that follow it and owns the runs
that start in it, so no run is lost or counted twice.  Chunks of long texts are dealt over the tasks, short texts stay where
they were read; counts and weights of chunks are summed by document.  A task counts into one array of ``buckets`` numbers and
puts out that, however much it reads; the gains are that many numbers again, which is what reaches the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.llm.ordering import running_counts
from adjudica.llm.shared import materialise

BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 2024, (10, 100), 20
#: Bytes after which a text is cut at the next word boundary.
CHUNK = 1 << 16
#: Words whose bucket a worker remembers, and the longest of them in bytes.
KNOWN, KNOWN_BYTES = 500_000, 64

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class _Buckets(dict):
    """The bucket of each feature, remembered for some."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(feature) <= KNOWN_BYTES:
            if len(self) >= KNOWN:
                self.clear()
            self[feature] = found
        return found


def chunks(text: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[bytes, bytes]]:
    """(own, carry) of each chunk: its bytes, and those up to the end of the ``n - 1`` words after it."""
    at = 0
    while at < len(text):
        to = min(len(text), at + size)
        if to < len(text) and _WORD.match(text, to - 1) and (rest := _WORD.match(text, to)):  # a word goes on here
            to = rest.end()
        end = to
        for _ in range(n - 1):
            found = _WORD.search(text, end)
            if not found:
                break
            end = found.end()
        yield text[at:to], text[to:end]
        at = to


def features(own: bytes, carry: bytes, n: int) -> tuple[int, Iterator[bytes]]:
    """(words of ``own``, all runs of 1 to ``n`` words that start in it).  Both are in lower case."""
    words = _WORD.findall(own)
    if n == 1:
        return len(words), words
    both = words + _WORD.findall(carry)[: n - 1]
    return len(words), (b" ".join(both[i : i + k]) for k in range(1, n + 1) for i in range(min(len(words), len(both) - k + 1)))


def _dealt(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(short texts, chunks of long ones), as rows (row_no, doc_id, own, carry) in lower case; the chunks are dealt anew."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), raw.alias("own"))
    short = rows.where(F.octet_length("own") <= CHUNK).select("*", F.lit(b"").alias("carry"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("own")):
                for own, carry in chunks(text.as_py().lower(), n):
                    yield pa.RecordBatch.from_arrays([batch.column("row_no").slice(k, 1), batch.column("doc_id").slice(k, 1), pa.array([own]), pa.array([carry])], names=["row_no", "doc_id", "own", "carry"])

    long = rows.where(F.octet_length("own") > CHUNK).mapInArrow(cut, short.schema)
    return short, long.repartition("row_no", F.xxhash64("own"))


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, c): occurrences of all runs of 1 to ``n`` words of the whole texts; buckets without any have no row."""
    short, long = _dealt(docs.select(text_col, F.lit(None).cast("long").alias("_id")), "_id", text_col, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for own, carry in zip(batch.column("own").to_pylist(), batch.column("carry").to_pylist(), strict=True):
                found = features(own.lower(), carry, n)[1]
                total += np.bincount(np.fromiter(map(known.__getitem__, found), np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "c": total[at]})

    counted = [part.select("own", "carry").mapInArrow(count, "bucket long, c long") for part in (short, long)]
    return counted[0].unionByName(counted[1]).groupBy("bucket").agg(F.sum("c").alias("c"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket the floored 1000 * ln of its smoothed share in ``target`` over that in ``docs``."""
    found = []
    for rows in (docs, target):
        c = np.zeros(buckets, np.int64)
        for bucket, count in bucket_counts(rows, text_col, n, buckets).collect():  # at most ``buckets`` rows
            c[bucket] = count
        found.append(c)
    (s, t), (all_s, all_t) = found, (int(found[0].sum()), int(found[1].sum()))
    return np.array([math.floor(1000 * math.log((float(t[k]) + 1) * float(all_s + buckets) / ((float(s[k]) + 1) * float(all_t + buckets)))) for k in range(buckets)], np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 1, buckets: int = BUCKETS, seed: int = SEED, share: tuple[int, int] = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    Words are runs of letters, digits and bytes from 0x80, after A-Z -> a-z; features are all runs of 1 to ``n`` of them, by the
    CRC-32 of their bytes modulo ``buckets``.  ``weight`` is the floored mean of the gains of a row's features (none: 0), ``score``
    adds Gumbel noise drawn from the id (a null id counts as the empty text).  Of the N rows of at least ``least`` words,
    floor(share * N) of the highest scores have a ``rank`` from 1, ties to the smaller id (null first), rows alike in both
    in any order; others have null.  Null and empty texts have no features.  Empty tables (``docs`` or ``target``) are allowed:
    all their counts are 0.  Other columns are not read.
    """
    gain = gains(docs, target, text_col, n, buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            made = np.zeros((batch.num_rows, 3), np.int64)
            for k, (own, carry) in enumerate(zip(batch.column("own").to_pylist(), batch.column("carry").to_pylist(), strict=True)):
                words, found = features(own.lower(), carry, n)
                at = np.fromiter(map(known.__getitem__, found), np.int64)
                made[k] = words, len(at), gain[at].sum()
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("doc_id"), *[pa.array(made[:, k]) for k in range(3)]], names=names)

    short, long = _dealt(docs, id_col, text_col, n)
    names = ["row_no", "doc_id", "n_words", "n_features", "total"]
    schema = f"row_no long, doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, total long"
    sums = [F.sum(c).alias(c) for c in names[2:]]
    whole = long.mapInArrow(weigh, schema).groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), *sums)
    rows = short.mapInArrow(weigh, schema).unionByName(whole)
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))
    rows = rows.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise)
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), "importance-rows")
    enough = F.col("n_words") >= least
    drawable = share[0] * rows.where(enough).count() // share[1]
    ranked = running_counts(rows.where(enough), [F.desc("score"), F.col("doc_id"), F.col("tie")], {"place": F.lit(1)}, "importance-order")
    rank = F.when(F.col("place") < drawable, F.col("place") + 1)
    none = rows.where(~enough).select("*", F.lit(None).cast("long").alias("rank"))
    return ranked.select(*rows.columns, rank.alias("rank")).unionByName(none).drop("tie")
