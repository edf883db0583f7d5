"""SimHash fingerprints, links and components against loops over all pairs."""

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from adjudica.llm import components, simhash


def plain_fingerprint(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_match_spark_hash(spark, odd, odd_rows):
    found = {(r["doc_id"], r["raw_hash"]): r["fingerprint"] for r in simhash.near_groups(odd).collect()}
    hashes = {(r[0], r[1]): r[2] for r in odd.select("doc_id", "text", F.xxhash64("text")).collect()}
    for r in odd_rows:
        assert found[r[0], hashes[r[0], r[1]]] == f"{plain_fingerprint(r[1]):016x}"


def test_near_groups(odd, odd_rows, empty):
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    linked = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = roots(range(len(prints)), linked)
    least = {}
    for i, r in enumerate(odd_rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    wanted = sorted((str(r[0]), str(least.get(root[i]))) for i, r in enumerate(odd_rows))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_groups(odd).collect()) == wanted
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(root.values()))
    assert simhash.near_groups(empty).count() == simhash.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("crowd", [1, 4, 1000])
def test_links_lose_no_component(spark, crowd):
    """Families of fingerprints around centres, so that keys are crowded: by pairs, by the table of neighbours, or both."""
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(prints)[:4]:
        for _ in range(60):
            near = centre
            for _ in range(rng.randrange(1, 5)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    signed = {p: p - 2**64 if p >= 2**63 else p for p in prints}
    distance = [(a, b) for a, b in itertools.combinations(sorted(signed), 2) if (a ^ b).bit_count() <= 2]
    wanted = roots(signed.values(), [(signed[a], signed[b]) for a, b in distance])
    edges = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed.values()], "fingerprint long"), crowd)
    assert all((r["u"] ^ r["v"]).bit_count() <= 2 if r["u"] ^ r["v"] >= 0 else ((r["u"] ^ r["v"]) % 2**64).bit_count() <= 2 for r in edges.collect())
    found = {r["u"]: r["root"] for r in components.component_roots(edges).collect()}
    assert {n: found.get(n, n) for n in signed.values()} == wanted


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (102, 102), (200, 100), (-5, 300)]
    found = {r["u"]: r["root"] for r in components.component_roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100, 200: 100, 300: -5}
    assert components.component_roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_crowd_of_pairs_is_not_emitted(spark):
    """Fingerprints that all share a key: work follows their number, not its square."""
    family = spark.range(2000).select(F.shiftleft("id", 20).alias("fingerprint"))
    assert simhash.fingerprint_links(family).count() < 65 * 2000
