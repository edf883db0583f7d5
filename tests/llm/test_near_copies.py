"""The pipeline's near-dedup stage against the rule on all pairs: five words, Jaccard similarity 0.8 or more."""

import itertools
import random

import pytest

import corpus_pipeline
from adjudica.llm import near_copies, simhash
from tests.llm.conftest import EN, SCHEMA, prose, row
from tests.llm.test_simhash import roots


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similar(a, b):
    return len(a & b) / len(a | b) >= 0.8


def test_stage_drops_all_near_copies(spark):
    """Copies with a few words changed, most more than 2 bits of a fingerprint apart; a crowd of them; pairs below 0.8."""
    rng = random.Random(5)
    texts = []
    for size, copies, changes in [(200, 40, 3), (200, 6, 6), (60, 8, 1), (400, 6, 9), (120, 30, 4), (3, 3, 1)]:
        base = prose(rng, EN, size).split()
        for _ in range(copies):
            words = list(base)
            for at in rng.sample(range(size), rng.randrange(changes + 1)):
                words[at] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts = list(dict.fromkeys(texts))
    rng.shuffle(texts)
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if similar(sets[i], sets[j])]
    wanted = sorted(set(roots(range(len(sets)), links).values()))
    assert len(wanted) < len(texts) - 20 and len(wanted) > 10
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "unused").collect()) == wanted


def slotted(rng, n, slots=17, words=10):
    """Texts of slots with two wordings each, and the links: pairs that differ in one slot have 0.8 or more, all others less."""
    wordings = [[" ".join(f"{'ab'[k]}{slot}x{i}" for i in range(words)) for k in (0, 1)] for slot in range(slots)]
    masks = rng.sample(range(1 << slots), n)
    at = {m: i for i, m in enumerate(masks)}
    texts = [" ".join(wordings[slot][m >> slot & 1] for slot in range(slots)) for m in masks]
    return texts, [(i, at[m ^ 1 << slot]) for i, m in enumerate(masks) for slot in range(slots) if m < m ^ 1 << slot and m ^ 1 << slot in at]


@pytest.mark.parametrize("n", [600, 7000])
def test_no_link_is_lost_in_crowded_keys(spark, n):
    texts, links = slotted(random.Random(n), n)
    if n < 1000:
        sets = [plain_set(t) for t in texts]
        assert sorted(tuple(sorted(p)) for p in links) == [(i, j) for i, j in itertools.combinations(range(n), 2) if similar(sets[i], sets[j])]
    wanted = roots(range(n), links)
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs, shingle=5, similarity=0.8).collect()}
    assert found == wanted


@pytest.mark.parametrize("rows", [7])
def test_blocks_hold_all_links(spark, monkeypatch, rows):
    """Small blocks and crowds: every key goes through tasks of two blocks, across size classes too."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", rows)
    rng = random.Random(rows)
    texts = slotted(rng, 60, slots=9, words=14)[0]
    base = prose(rng, EN, 100).split()
    texts += [" ".join(base[: 100 - k]) for k in range(0, 60, 2)]
    sets = [plain_set(t) for t in texts]
    wanted = roots(range(len(sets)), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if similar(sets[i], sets[j])])
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs, shingle=5, similarity=0.8, crowd=1).collect()}
    assert found == wanted


def test_odd_rows(odd, odd_rows, empty):
    sets = [plain_set(r[1]) for r in odd_rows]
    linked = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if similar(sets[i], sets[j])]
    root = roots(range(len(sets)), linked)
    least = {}
    for i, r in enumerate(odd_rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    wanted = sorted((str(r[0]), str(least.get(root[i]))) for i, r in enumerate(odd_rows))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_groups(odd, shingle=5, similarity=0.8).collect()) == wanted
    kept = simhash.drop_near_copies(odd, shingle=5, similarity=0.8)
    assert kept.columns == odd.columns and kept.count() == len(set(root.values()))
    assert simhash.near_groups(empty, shingle=5, similarity=0.8).count() == simhash.drop_near_copies(empty, shingle=5, similarity=0.8).count() == 0
