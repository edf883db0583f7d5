"""Redaction where a batch has nothing to read."""

from __future__ import annotations

from adjudica.functions.redaction import redacted


def test_a_batch_of_nulls(spark):
    """Before, a task of null texts alone ended the run with an error of types."""
    rows = spark.createDataFrame([(None,)] * 3 + [('{"token":1}',)], "j string").repartition(1).sortWithinPartitions("j")
    assert [r[0] for r in rows.select(redacted("j")).collect()] == [None, None, None, '{"token":"<redacted>"}']
    alone = spark.createDataFrame([(None,)] * 2, "j string").coalesce(1)
    assert [r[0] for r in alone.select(redacted("j")).collect()] == [None, None]
