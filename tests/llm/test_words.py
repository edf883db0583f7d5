"""Importance resampling and collocations against plain versions, over odd rows, long texts and every way they take."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from adjudica.llm import collocation, importance

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_features(text, n):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER).encode())
    return words, [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, n, buckets, least):
    def counts(texts):
        c = Counter(zlib.crc32(f) % buckets for t in texts for f in plain_features(t, n)[1])
        return c, c.total()

    (s, all_s), (t, all_t) = counts(r[1] for r in rows), counts(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for r in rows:
        words, found = plain_features(r[1], n)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in found) // len(found) if found else 0
        h = int(sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    for place, x in enumerate(able[: 10 * len(able) // 100], 1):
        x[5] = place
    return Counter(map(tuple, out))


@pytest.mark.parametrize("n", [1, 3])
def test_resample(spark, odd, odd_rows, n, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 200)  # most texts are cut
    target = ["the and of", None, "", "das ist nicht wahr " * 50]
    found = importance.resample(odd, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=500, least=5)
    assert Counter(map(tuple, found.collect())) == plain_resample(odd_rows, target, n, 500, 5)


def test_resample_of_nothing(spark, odd, empty):
    assert importance.resample(empty, odd).collect() == []
    assert importance.resample(odd, empty).count() == odd.count()


@pytest.mark.parametrize("size", [1, 7, 50])
@pytest.mark.parametrize("n", [1, 2, 4])
def test_chunks_own_every_run_once(size, n):
    draw = random.Random(size)
    text = "".join(draw.choice("abc  ,é") for _ in range(400)).encode()
    got = Counter(f for own, carry in importance.chunks(text, n, size) for f in importance.features(own, carry, n)[1])
    assert got == Counter(plain_features(text.decode(), n)[1])
    assert b"".join(own for own, _ in importance.chunks(text, n, size)) == text


def plain_collocations(rows, least, keep):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    able = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    covered = set()
    for g, a in able.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                inner = (g[0], *g[i : i + k])
                if 100 * a >= 80 * able[inner]:
                    covered.add(inner)
    out = {}
    for g, a in able.items():
        if g not in covered:
            score, k = min((2_000_000 * a // (f[g[: k + 1]] + f[(g[0], *g[k + 1 :])]), k) for k in range(1, len(g) - 1))
            out.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), f[g[: k + 1]], f[(g[0], *g[k + 1 :])]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(own)[:keep], 1))


@pytest.fixture(scope="module")
def phrases():
    draw = random.Random(3)
    words = [c * k for k in (1, 2) for c in "abcdeé"]
    rows = [(" ".join(draw.choices(words, [2**-i for i in range(12)], k=draw.randrange(0, 120))).replace("aa", draw.choice(["A", "aa.", "aa ;", "b\tb"])), draw.choice(["en", "de", None])) for _ in range(150)]
    return [*rows, (None, "en"), ("", None), ("a a a a a a a a", "en"), (" \n ", "xx"), ("a b " * 4000, "de")]


@pytest.mark.parametrize("way", ["plain", "lots", "salted"])
def test_collocations(spark, phrases, way, monkeypatch):
    if way == "lots":
        monkeypatch.setattr(collocation, "DICTIONARY_WORDS", 0)
        monkeypatch.setattr(collocation, "LOT", 7)
    if way == "salted":
        monkeypatch.setattr(collocation, "LOAD", 300)
        monkeypatch.setattr(collocation, "HELD", 500)
        monkeypatch.setattr(collocation, "WORDS", 5)
    rows = spark.createDataFrame([(*r, "x") for r in phrases], "text string, lang string, ids string").repartition(3)
    found = collocation.collocations(rows, least=6, keep=40)
    assert sorted(map(tuple, found.collect())) == plain_collocations(phrases, 6, 40)


def test_no_phrases(spark, empty):
    assert collocation.collocations(empty).collect() == []


def test_fragments_hold_each_phrase_once():
    draw = np.random.default_rng(4)
    ids = draw.integers(0, 6, 3000)
    wanted = Counter(tuple(ids[i : i + k].tolist()) for k in (2, 3, 4) for i in range(len(ids) - k + 1) if ids[i : i + k].all())
    got: Counter = Counter()
    for grams, counts in collocation.mined(collocation.fragments(ids).astype(np.uint32), 1):
        for g, c in zip(grams.tolist(), counts.tolist(), strict=True):
            assert tuple(g) not in got
            got[tuple(g)] = c
    assert got == wanted
