"""The suffix-array operator against brute force, and the ranks of suffixes against sorting them."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adjudica.llm import suffix_array, suffix_dedup


def brute(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        covered = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(r, covered, strict=True) if not y)
        out.append((len(r), sum(covered), sum(1 for i, y in enumerate(covered) if y and not (i and covered[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def found(spark, texts: list[str | None], **options) -> list[tuple[int, int, int, str]]:
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = suffix_dedup.remove_repeats(rows, **options)
    return [tuple(r)[1:] for r in got.select("row.doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).orderBy("doc_id").collect()]


def mixed_texts(seed: int, length: int, alphabet: str) -> list[str | None]:
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choice(alphabet) for _ in range(n))
    pool = [word(draw.choice([length - 2, length, length + 3, 3 * length, 8 * length])) for _ in range(8)] + ["a" * (2 * length), "xy" * length, "abc" * (length // 2)]
    texts: list[str | None] = []
    for _ in range(60):
        text = ""
        for _ in range(draw.randint(0, 5)):
            s = draw.choice(pool)
            i = draw.randint(0, len(s) // 2)
            text += word(draw.randint(0, 2 * length)) if draw.random() < 0.5 else s if draw.random() < 0.4 else s[i : draw.randint(i, len(s))]
        texts.append(text)
    return [*texts, None, "", texts[3], texts[5][:-1], texts[7] + "z"]


@pytest.mark.parametrize(("seed", "length", "alphabet"), [(1, 65, "ab"), (2, 64, "abcdefghijklmnopqrstuvwxyz é"), (3, 400, "abcdefgh")])
def test_against_brute_force(spark, seed, length, alphabet):
    texts = mixed_texts(seed, length, alphabet)
    assert found(spark, texts, length=length, base=50) == brute(texts, length)


def test_base_case_gives_the_same(spark):
    texts = mixed_texts(4, 64, "abcdefgh")
    assert found(spark, texts, length=64) == brute(texts, 64)


def test_long_texts_in_blocks(spark, monkeypatch):
    draw = random.Random(5)
    long = "".join(draw.choice("abcdefghij ") for _ in range(9000))
    texts = [long, long[:4000] + "!" + long[4000:], "la " * 3000, "x" * 5000 + long[100:700], long[5000:5600]]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1500)
    assert found(spark, texts, length=100) == brute(texts, 100)


def test_nothing_is_broadcast_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_CUTS", 0)
    texts = mixed_texts(6, 64, "abcdefgh")
    assert found(spark, texts, length=64) == brute(texts, 64)


def test_few_cuts_and_each_position_has_one():
    draw, rule = random.Random(8), suffix_dedup.Rule(400)
    texts = [bytes(draw.choices(b"etaoin shrdlu", k=n)) for n in (100_000, 300, 399, 400, 700, 0)]
    block = suffix_dedup.Block(texts, rule)
    assert len(block.cuts) < sum(map(len, texts)) / 120
    served = [p for a, b in zip(block.first, block.last, strict=True) for p in range(a, b + 1)]
    assert set(served) >= {p for a, e in zip(block.starts, block.ends, strict=True) for p in range(a, e - 399)} and len(served) == len(set(served))
    assert all(0 <= c - b <= c - a <= rule.gap for a, b, c in zip(block.first, block.last, block.cuts, strict=True))
    alone = suffix_dedup.Block([texts[0][5000:6000]], rule)
    inside = {int(c) - 5000 for c in block.cuts if 5000 + rule.gap <= c < 6000 - rule.gap - 8}
    assert inside == {int(c) for c in alone.cuts if rule.gap <= c < 1000 - rule.gap - 8}


@pytest.mark.parametrize("length", [64, 400])
def test_stretches_of_one_period_and_several_lengths(spark, length):
    draw = random.Random(9)
    letters = lambda n: "".join(draw.choice("cdefghij") for _ in range(n))
    u, texts = letters(2 * length), []
    for size in (0.6, 0.85, 0.9, 0.95, 1, 1.05, 1.2, 1.4, 1.5, 1.55, 1.8, 2.1, 2.6, 4, 8):
        texts += [u + "ab" * int(size * length / 2) + end + letters(length // 2) for end in ("Z", "z")]
        texts.append(letters(length) + "abc" * int(size * length / 3) + draw.choice("Zz!") + letters(length))
    assert found(spark, texts, length=length, base=50) == brute(texts, length)


def test_edges(spark):
    assert found(spark, []) == []
    assert [x[:3] for x in found(spark, [None, "", "short", "short"])] == [(0, 0, 0), (0, 0, 0), (5, 0, 0), (5, 0, 0)]
    with pytest.raises(ValueError, match="at least 64"):
        suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=10)


def test_ranks_of_suffixes(spark):
    draw = random.Random(7)
    strings = [[draw.randint(1, 2) for _ in range(draw.randint(1, 40))] for _ in range(40)] + [[1] * 30, [1] * 30, [2, 1] * 15, [1]]
    rows = spark.createDataFrame([(k, s, [1] * len(s)) for k, s in enumerate(strings)], "key long, syms array<long>, spans array<long>")
    ranks = {r["key"]: r["ranks"] for r in suffix_array.suffix_ranks(rows, 1000, base=10).collect()}
    got = sorted((rank, tuple(strings[k][i:])) for k, own in ranks.items() for i, rank in enumerate(own))
    assert [s for _, s in got] == sorted(tuple(s[i:]) for s in strings for i in range(len(s)))


def test_only_triples_not_told_apart_go_on(spark, monkeypatch):
    draw, made = random.Random(10), []
    real = suffix_array.materialise
    monkeypatch.setattr(suffix_array, "materialise", lambda df, name: (made.append(name), real(df, name))[1])
    again = [draw.randint(1, 500) for _ in range(30)]
    strings = [[draw.randint(1, 500) for _ in range(draw.randint(1, 60))] for _ in range(40)] + [again + [7, 8], [9] + again, again, again[3:] + [1, 2, 3, 4], [5] * 12]
    rows = spark.createDataFrame([(k, s, [1] * len(s)) for k, s in enumerate(strings)], "key long, syms array<long>, spans array<long>")
    ranks = {r["key"]: r["ranks"] for r in suffix_array.suffix_ranks(rows.repartition(3), 1000, base=400).collect()}
    got = sorted((rank, tuple(strings[k][i:])) for k, own in ranks.items() for i, rank in enumerate(own))
    assert [s for _, s in got] == sorted(tuple(s[i:]) for s in strings for i in range(len(s)))
    assert made.count("suffix-open") == 1


def test_few_cuts_are_ranked_and_few_positions_tried_one_by_one(spark, monkeypatch):
    draw, rows = random.Random(12), {}
    real = suffix_dedup.materialise

    def counted(df, name):
        made = real(df, name)
        rows[name] = rows.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(suffix_dedup, "materialise", counted)
    letters = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    texts = []
    for _ in range(12):
        common = letters(1200)
        texts += [letters(300) + common[draw.randint(0, 250) :] + letters(300) for _ in range(3)]
    notes = [letters(200) for _ in range(12)]  # shorter than a match: their cuts occur twice and need no rank
    texts += [letters(500) + notes[k % 12] + letters(500) for k in range(36)]
    assert found(spark, texts) == brute(texts, 400)
    assert 0 < rows["suffix-strings"] <= 36, rows
    assert 0 < rows["suffix-windows"] < 1200, rows
