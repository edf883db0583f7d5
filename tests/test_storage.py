"""State and files under failures: resumed runs, snapshots, capped sources, attestations, numbering without a group's task."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adjudica.functions.redaction import redacted
from adjudica.operators import attestation
from adjudica.operators.matching import in_windows
from adjudica.operators.state_table import Conflict, StateTable
from adjudica.plans.checks import error_class
from adjudica.sources import files
from adjudica.sources.capped import CappedSource, Refused, Service, halved
from adjudica.sources.splits import read_split, write_buckets
from adjudica.streaming import resumable


def test_resumed_after_a_kill_between_mark_and_commit(spark, tmp_path):
    spark.range(60).repartition(6).write.parquet(f"{tmp_path}/universe")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/universe")
    calls = Counter()

    def work(fails_at):
        def made(rows):
            if rows.limit(1).count():
                calls["n"] += 1
                if calls["n"] == fails_at:
                    raise RuntimeError("killed")
            return rows.select("id", F.when(F.col("id") % 7 == 0, "bad").alias("error"), (F.col("id") * 2).alias("twice"))

        return made

    folder = f"{tmp_path}/run"
    with pytest.raises(Exception, match="killed"):
        resumable.run_resumable(stream(), work(3), folder, key="id")
    assert spark.read.parquet(f"{folder}/done").count() < 60
    resumable.run_resumable(stream(), work(0), folder, key="id")
    resumable.run_resumable(stream(), work(0), folder, key="id")  # nothing is left
    found = resumable.results(spark, folder, "id")
    assert sorted(r["id"] for r in found.collect()) == list(range(60))
    tried = spark.read.parquet(f"{folder}/marks").groupBy("batch").agg(F.countDistinct("attempt").alias("k")).collect()
    assert sorted(r["k"] for r in tried) == [1, 1, 1, 1, 1, 2]

    # failed cases once more, and never again
    universe = spark.read.parquet(f"{tmp_path}/universe")
    well = lambda rows: rows.select("id", F.when(F.col("id") == 7, "bad").alias("error"), (F.col("id") * 3).alias("twice"))
    assert resumable.retry_errors(spark, universe, well, folder, key="id") == 9
    assert resumable.retry_errors(spark, universe, well, folder, key="id") == 0
    last = {r["id"]: (r["error"], r["twice"], r["tries"]) for r in resumable.results(spark, folder, "id").collect()}
    assert last[7] == ("bad", 21, 2) and last[14] == (None, 42, 2) and last[8] == (None, 16, 1) and len(last) == 60


def test_a_batch_that_always_fails_is_given_up(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/universe")
    stream = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/universe")

    def fails(rows):
        if rows.limit(1).count():
            raise RuntimeError("killed")
        return rows.select("id", F.lit(None).cast("string").alias("error"), F.col("id").alias("x"))

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            resumable.run_resumable(stream(), fails, f"{tmp_path}/run", key="id")
    resumable.run_resumable(stream(), fails, f"{tmp_path}/run", key="id")
    assert {(r["id"], r["error"], r["x"]) for r in resumable.results(spark, f"{tmp_path}/run", "id").collect()} == {(k, "given up", None) for k in range(5)}


def test_state_table(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), ["k"], {"spent": "max", "n": "sum", "first": "first"}, parts=8)
    assert table.read() is None and table.snapshots() == []
    rows = lambda *r: spark.createDataFrame(list(r), "k string, spent double, n long, first string")
    state = lambda snapshot=None: {r["k"]: (r["spent"], r["n"], r["first"]) for r in table.read(snapshot).collect()}
    assert table.merge(rows(*[(f"k{i}", 1.0, 1, "a") for i in range(40)], ("k0", 3.0, 1, "a"), (None, 1.0, 1, "n"))) == 1
    before = table.folders()
    assert table.merge(rows(("k0", 2.0, 1, "b"), ("new", 5.0, 1, "b"))) == 2
    after = table.folders()
    touched = {p for p in after if after[p] != before.get(p)}
    assert 1 <= len(touched) <= 2 and len(before) > 4
    assert state(1)["k0"] == (3.0, 2, "a") and "new" not in state(1)
    assert state() == state(1) | {"k0": (3.0, 3, "a"), "new": (5.0, 1, "b")}
    assert state()[None] == (1.0, 1, "n")
    with pytest.raises(Conflict):  # a writer that was overtaken
        table._commit(table._listed(1), 2)
    assert table.snapshots() == [1, 2]
    with pytest.raises(Exception, match="boom"):
        table.merge(rows(("k1", 1.0, 1, "x")).withColumn("n", F.raise_error(F.lit("boom")).cast("long")))
    assert table.snapshots() == [1, 2] and state()["k1"] == (1.0, 1, "a")


@pytest.mark.parametrize("crowd", [3, 1000])
def test_matching_in_windows(spark, crowd):
    draw = random.Random(1)
    windows = [(i, draw.choice(["hot", "a", "b", None]), at, at + draw.choice([0, 1, 20, 300])) for i, at in enumerate(draw.randrange(500) for _ in range(60))]
    records = [(i, draw.choice(["hot"] * 5 + ["a", "b", None]), draw.choice([None, *range(600)])) for i in range(400)]
    pairs = in_windows(spark.createDataFrame(windows, "w long, c string, since long, until long"), spark.createDataFrame(records, "r long, c string, at long"), "c", 50, crowd=crowd)
    wanted = sorted((w, r) for w, c, a, b in windows for r, d, at in records if c is not None and c == d and at is not None and a <= at < b)
    assert sorted((x["w"], x["r"]) for x in pairs.collect()) == wanted
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_capped_source(spark, tmp_path):
    rows = [(k, str(k)) for k in [*range(100), *range(5000, 5040), 10**12, 10**12]] + [(None, "x")] * 3
    spark.createDataFrame(rows, "k long, t string").repartition(3).write.parquet(f"{tmp_path}/t")
    spark.dataSource.register(CappedSource)
    source = lambda cap: spark.read.format("capped").option("path", f"{tmp_path}/t").option("key", "k").option("cap", cap).option("columns", "t string, k bigint").load()
    assert Counter((r["k"], r["t"]) for r in source(7).collect()) == Counter(rows)
    with pytest.raises(Exception, match="has 2 rows"):  # one key has more than the service gives: an error, not a cut
        source(1).collect()
    service = Service(f"{tmp_path}/t", "k", 7)
    with pytest.raises(Refused):
        list(service.fetch(0, 50, ["k"]))
    ranges = list(halved(service.count, 0, 10**12 + 1, 7))
    assert all(a < b for a, b in ranges) and sum(service.count(a, b) for a, b in ranges) == 142 and max(service.count(a, b) for a, b in ranges) <= 7


def test_attestation(spark, tmp_path):
    table = spark.range(3000).select("id", (F.col("id") * 7 % 100).alias("x"), F.when(F.col("id") % 3 == 0, "t").alias("t"))
    folder = f"{tmp_path}/frozen"
    root = attestation.freeze(table, "id", folder)
    assert len(root) == 64
    assert attestation.differing_leaves(table.repartition(7), "id", folder) == [] and attestation.verify(table, "id", folder).count() == 0
    changed = table.withColumn("x", F.when(F.col("id") == 1234, -1).otherwise(F.col("x")))
    assert len(attestation.differing_leaves(changed, "id", folder)) == 1
    found = attestation.verify(changed, "id", folder)
    assert [tuple(r) for r in found.collect()] == [(1234, "changed")]
    assert "PartitionFilters: [leaf" in found._jdf.queryExecution().executedPlan().toString().replace("isnotnull(leaf", "leaf")  # one leaf of 256 is read
    null = table.withColumn("t", F.coalesce("t", F.lit("")))  # null is not the empty text
    assert attestation.verify(null, "id", folder).count() == 2000
    both = table.where("id <> 5").unionByName(table.where("id IN (6, 7)")).unionByName(spark.createDataFrame([(-1, 0, "t")], table.schema))
    assert {tuple(r) for r in attestation.verify(both, "id", folder).collect()} == {(5, "missing"), (6, "new"), (7, "new"), (-1, "new")}
    assert attestation.freeze(table.limit(0), "id", f"{tmp_path}/none") == ""


def test_split_files(spark, tmp_path):
    texts = ["a", " ", None, "b", "c", "", "d", "\n", "e"]
    for k in range(3):
        spark.createDataFrame([(k, i, t) for i, t in enumerate(texts)], "file long, row long, text string").coalesce(1).write.parquet(f"{tmp_path}/{k}.parquet")
    usable = F.coalesce("text", F.lit("")).rlike(r"\S")
    found = read_split(spark, [f"{tmp_path}/{k}.parquet" for k in range(3)], "train", usable, span=2)
    got = sorted((r["id"], r["file"], r["row"]) for r in found.collect())
    assert got == [(f"train-{n:06}", f, i) for n, (f, i) in enumerate((f, i) for f in range(3) for i, t in enumerate(texts) if (t or "").strip())]


def test_bucket_files_are_replaced_one_by_one(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("b"))
    write_buckets(rows, f"{tmp_path}/b", ["b"])
    write_buckets(rows.where("b = 1 AND id < 50"), f"{tmp_path}/b", ["b"])
    read = spark.read.parquet(f"{tmp_path}/b")
    assert {r["b"]: r["count"] for r in read.groupBy("b").count().collect()} == {0: 34, 1: 17, 2: 33}
    plan = read.where("b = 2").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(b" in plan


def test_numbering_by_ranges_of_sparse_keys(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("g"), F.xxhash64("id").alias("k"), F.lit(1.5).alias("v")).union(spark.createDataFrame([(None, 5, None), (None, 3, 2.0)], "g string, k long, v double"))
    found = files.running_ids(rows, "g", "k", "n").cache()
    assert [r["n"] for r in found.where("g = 'g'").orderBy("k").collect()] == list(range(20_000))
    assert [r["n"] for r in found.where("g IS NULL").orderBy("k").collect()] == [0, 1]
    sums = files.running_sums(rows, "g", "k", "v", "s")
    assert [r["s"] for r in sums.where("g = 'g'").orderBy("k").collect()] == [1.5 * k for k in range(1, 20_001)]
    assert [r["s"] for r in sums.where("g IS NULL").orderBy("k").collect()] == [2.0, 2.0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be joined
    ranges = files._ranged(rows, "g", "k", "test").groupBy("_task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 12_000  # no task holds the group


@pytest.mark.parametrize(
    ("error", "kind"),
    [
        ("HTTP Error 502: provider refused to answer", "rejection"), ("HTTP Error 502", "transport"), ("HTTP Error 400: invalid schema", "transport"), ("HTTP Error 504: timed out", "transport"),
        ("Read TIMEOUT", "timeout"), ("connection timed out", "timeout"), ("schema mismatch: invalid JSON", "local"), ("malformed", "local"), ("Connection refused", "transport"), ("ECONNRESET", "transport"), ("refused to answer", "transport"), ("strange", "other"),
    ],
)
def test_error_classes(spark, error, kind):
    row = spark.createDataFrame([(json.dumps(error),)], "e string").select(error_class(F.lit(True), F.col("e"))).first()
    assert row[0] == kind


def test_error_class_of_no_text(spark):
    rows = spark.createDataFrame([(True, None), (False, None), (True, '{"code": 1}'), (True, "7")], "there boolean, e string")
    assert [r[0] for r in rows.select(error_class(F.col("there"), F.col("e"))).collect()] == [None, "missing", "other", "other"]


def test_redaction(spark):
    cases = {
        '{"max_tokens": 5, "monkey": 1}': '{"max_tokens": 5, "monkey": 1}',
        '{"Cookie": "c", "api-key": {"a": [1]}, "apikey": 2, "xtoken": 3}': '{"Cookie":"<redacted>","api-key":"<redacted>","apikey":"<redacted>","xtoken":"<redacted>"}',
        '{"a": [{"Password": 1, "b": {"credentials": []}}, "é"]}': '{"a":[{"Password":"<redacted>","b":{"credentials":"<redacted>"}},"é"]}',
        '{"extra": " {\\"secret\\": 1, \\"n\\": [1, 2]}"}': '{"extra":"{\\"secret\\":\\"<redacted>\\",\\"n\\":[1,2]}"}',
        '{"extra": "{\\"n\\": 1}"}': '{"extra": "{\\"n\\": 1}"}',
        '{"extra": "{broken \\"token\\""}': '{"extra": "{broken \\"token\\""}',
        "not json": "not json", "": "", "[1]": "[1]",
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", redacted("t").alias("safe"))
    assert {r["t"]: r["safe"] for r in rows.collect()} == {**cases, None: None}
