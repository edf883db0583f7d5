"""Bounded samples for fitting: rows of smallest hash, the same whatever the partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class values that are learned, the commonest if there are more; and about the rows that a sample of all classes may have.
MOST_CLASSES, MOST_ROWS = 1000, 100_000


def sample_classes(rows: DataFrame, class_col: str, key: Column, per_class: int, project: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, list]:
    """At most about ``per_class`` rows of each class of ``rows`` (all, where a class has fewer), chosen by a hash of
    ``key``, and the sorted class values.

    The classes are counted over all rows, which reads only ``class_col``; the fraction that each class needs then filters
    the hash, so only rows of the sample move.  Rows that repeat a key are chosen together, so the rows of smallest hash,
    twice ``per_class`` for each class, are the hard bound.  ``project`` is applied to the chosen rows before that, and
    keeps the columns of ``key``: what a sample does not need, such as long texts, never leaves its task.  With very many
    classes each has fewer rows, so that the sample keeps within ``MOST_ROWS``.
    """
    counts = rows.groupBy(class_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), class_col).limit(MOST_CLASSES).collect()
    per_class = max(1, min(per_class, MOST_ROWS // max(1, len(counts))))
    share = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for row in counts:
        wanted = wanted | ((F.col(class_col) == F.lit(row[0])) & (share < F.lit(min(1.0, per_class / row["n"]))))
    return project(rows.where(wanted)).orderBy(share, key).limit(2 * per_class * max(1, len(counts))), sorted(row[0] for row in counts)
