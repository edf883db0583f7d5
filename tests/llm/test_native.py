"""Exact dedup, sharding and mixing against plain loops, and that their plans hold no Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from adjudica.llm import exact_dedup, mixing, sharding, shared


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


@pytest.mark.parametrize("options", [{}, {"capacity": 2}, {"hash_of": lambda c: F.length(c).cast("long") % 3, "digest_of": lambda c: F.unhex(F.sha2(F.substring(c, 1, 1), 256))}])
def test_exact_groups(odd, odd_rows, options):
    """Also with tiny buckets, and with a hash and digest so weak that texts differ under one index entry."""
    groups = defaultdict(list)
    for r in odd_rows:
        groups[norm(r[1])].append(r[0])
    found = exact_dedup.exact_groups(odd, **options).collect()
    wanted = Counter((r[0], least(groups[norm(r[1])]), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in odd_rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == wanted
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_drop_copies(odd, odd_rows, empty):
    found = exact_dedup.drop_copies(odd)
    assert found.columns == odd.columns
    rows = found.collect()
    assert Counter(norm(r["text"]) for r in rows) == Counter({norm(r[1]) for r in odd_rows})
    groups = defaultdict(list)
    for r in odd_rows:
        groups[norm(r[1])].append(r[0])
    assert all(r["doc_id"] == least(groups[norm(r["text"])]) for r in rows)
    assert exact_dedup.drop_copies(empty).count() == 0


def test_directory_doubles_where_it_must(spark):
    """Buckets split until none is overfull, also where most hashes share 40 bits, and every hash has one bucket."""
    crowded = F.shiftrightunsigned(F.xxhash64("id"), 40)
    hashes = spark.range(4000).select(F.when(F.col("id") < 3000, crowded).otherwise(F.xxhash64("id")).alias("hash")).distinct()
    buckets = exact_dedup.directory(hashes, 200)
    placed = exact_dedup.in_buckets(hashes, buckets)
    sizes = {r[0]: r[1] for r in placed.groupBy("bucket").count().collect()}
    assert placed.count() == hashes.count() and max(sizes.values()) <= 200
    depths = {r["bucket"]: r["depth"] for r in buckets.collect()}
    assert len(depths) == buckets.count() and set(sizes) <= set(depths) and max(depths.values()) > 40 > 4 >= min(depths.values())
    one = exact_dedup.directory(hashes, 10_000).collect()
    assert [(r["depth"], r["prefix"], r["bucket"]) for r in one] == [(0, 0, 0)]


def test_a_hot_text_among_many_shared_hashes(spark, monkeypatch):
    """Beyond the bound of a broadcast: the same groups, and no row of the hot text moves before it is folded."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    texts = ["hot  text"] * 300 + [f"text {k // 2}" for k in range(600)]
    docs = spark.createDataFrame([(None if k == 5 else k % 700, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = exact_dedup.exact_groups(docs, capacity=50).collect()
    assert Counter(r["group_size"] for r in found) == Counter({300: 300, 2: 600})
    assert len({r["bucket"] for r in found}) > 4 and sum(r["kept"] for r in found) == 301
    kept = exact_dedup.drop_copies(docs, capacity=50).collect()
    assert Counter(norm(r["text"]) for r in kept) == Counter(set(map(norm, texts)))


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = math.floor((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 100])
def test_jump_walk(spark, shards):
    keys = [0, 1, 2, 7, 123456789, 2**62, -1, -(2**63), 2**63 - 1, *range(1000, 1100)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    a, b = sharding.jump_shards(F.col("k"), shards)
    assert {r["k"]: (r["a"], r["b"]) for r in rows.select("k", a.alias("a"), b.alias("b")).collect()} == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}


def test_shards(odd, odd_rows, empty):
    found = sharding.shard_documents(odd, 16).collect()
    text = lambda r: (r[1] or "").encode()
    wanted = Counter((r[0], len(text(r)) + 1, zlib.crc32(text(r)), jump(r[0] or 0, 16), jump(r[0] or 0, 17)) for r in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in found) == wanted
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append((r["slot"], r["doc_id"] if r["doc_id"] is not None else -1))
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    assert all(r["grown_shard"] in (r["shard"], 16) for r in found)
    assert sharding.shard_documents(empty).count() == 0


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def draw(mean, key):
    parts, total = max(1, math.ceil(mean / 16)), 0
    for i in range(1, parts + 1):
        u, lam = uniform(17, key, i), mean / parts
        p = cdf = math.exp(-lam)
        k = 0
        while cdf <= u and k < 96:
            k += 1
            p *= lam / k
            cdf += p
        total += k
    return total


def mix_keys(rows):
    """A row's key: its id, or for null and repeated ids also the text's md5 and the number among rows alike in both."""
    ids, alike, keys = Counter(r[0] for r in rows), Counter(), []
    for r in rows:
        text = r[1] or ""
        if r[0] is not None and ids[r[0]] == 1:
            keys.append(str(r[0]))
        else:
            keys.append(f"{'' if r[0] is None else r[0]}:{hashlib.md5(text.encode()).hexdigest()}:{alike[r[0], text]}")
            alike[r[0], text] += 1
    return keys


@pytest.mark.parametrize("weights", [None, {"a": 9.0, "b": 1.0}])
def test_mixing(odd, odd_rows, empty, weights):
    found = mixing.mix_sources(odd, weights)
    rows = found.select("row.*", F.col("rate").alias("mean"), "copies", "copy_no", "mix_key").collect()
    n = Counter(r[3] for r in odd_rows)
    weight = {s: (math.sqrt(c) if weights is None else weights.get(s, 0.0)) for s, c in n.items()}
    rate = {s: weight[s] / sum(weight.values()) * len(odd_rows) / n[s] for s in n}
    wanted, keys = Counter(), mix_keys(odd_rows)[::-1]
    for r in odd_rows:
        copies = draw(rate[r[3]], keys.pop())
        for k in range(copies):
            wanted[r[0], r[1], copies, k] += 1
    assert Counter((r["doc_id"], r["text"], r["copies"], r["copy_no"]) for r in rows) == wanted
    assert found.select("row.*").columns == odd.columns
    assert mixing.mix_sources(empty, weights).count() == 0
    shuffled = mixing.mix_sources(odd, weights, broadcast_sources=0).select("row.*", "copies", "copy_no").collect()
    assert Counter((r["doc_id"], r["text"], r["copies"], r["copy_no"]) for r in shuffled) == wanted


@pytest.mark.parametrize("hot_keys", [1, 4, 1000])
def test_join_folded(spark, monkeypatch, hot_keys):
    """Hot, cold and null keys each find their row, whichever way they go."""
    monkeypatch.setattr(shared, "HOT_KEYS", hot_keys)
    values = ["a"] * 40 + ["b"] * 20 + ["c", "d", None, None, "e"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, k string").repartition(3)
    folded = spark.createDataFrame([(k, n, f"of {k}") for k, n in Counter(values).items()], "k string, n long, said string")
    found = shared.join_folded(rows, folded, ["k"], len(values))
    assert found.columns == ["i", "k", "n", "said"]
    assert sorted((r["i"], r["k"], r["said"]) for r in found.collect()) == [(i, k, f"of {k}") for i, k in enumerate(values)]


def test_mixing_draws_null_and_repeated_ids_apart(spark):
    """Rows of null ids, of one id with many texts, and of one whole row repeated each draw for themselves and spread."""
    kind = F.col("id") % 4
    docs = spark.range(8000).select(F.when(kind == 0, F.lit(None)).when(kind == 1, -1).when(kind == 2, -2).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(kind == 2, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("source"))
    found = mixing.mix_sources(docs, size=1.0)
    counts = Counter(-9 if r[0] is None else r[0] if r[0] < 0 else 0 for r in found.select("row.doc_id").collect())
    assert all(abs(counts[k] - 2000) < 5 * math.sqrt(2000) for k in (-9, -1, -2, 0))
    assert len({r["mix_key"] for r in found.collect()}) == found.count()


def test_mixing_reaches_large_and_small_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "rare").otherwise("common").alias("source"))
    shares = {r[0]: r[1] for r in mixing.mix_sources(docs, {"rare": 3.0, "common": 1.0}, size=2.0).groupBy("row.source").count().collect()}
    assert shares["rare"] == pytest.approx(6000, rel=0.05) and shares["common"] == pytest.approx(2000, rel=0.1)


@pytest.mark.parametrize("job", [exact_dedup.exact_groups, exact_dedup.drop_copies, sharding.shard_documents, mixing.mix_sources])
def test_native_plans(odd, job):
    plan = job(odd.drop("row"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
