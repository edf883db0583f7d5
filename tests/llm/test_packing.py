"""Packing: pieces against the tokenizer itself, exact round trip, gapless sequences, waste."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.llm import packing


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def check(rows):
    at, total = defaultdict(list), 0
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for placed in at.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 1024
    return len(at), total


def test_pieces_and_sequences(odd, odd_rows, encode, empty):
    packed = packing.pack_documents(odd, with_ids=True).cache()
    rows = packed.collect()
    check(rows)
    texts = defaultdict(list)
    for r in odd_rows:
        texts[r[0]].append(encode(r[1]))
    pieces = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert set(pieces) == set(texts)
    for doc_id, ids in texts.items():
        wanted = []
        for x in ids:
            first = len(x) % 1024 or 1024
            cuts = [0, *range(first, len(x), 1024), len(x)] if len(x) > 1024 else [0, len(x)]
            wanted += [(k, a, x[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted(pieces[doc_id]) == sorted(wanted)
    lengths = {r["sequence_id"]: r["length"] for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("length")).collect()}
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == 4 * r["length"] == 4 * lengths[r["sequence_id"]]
    assert packing.pack_documents(empty).count() == 0


def test_word_ids_are_the_tokenizers(encode):
    rng = random.Random(5)
    alphabet = ["a", "Zé", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "don't", "123", "…", "日本", "<|endoftext|>", "ß", " ", "\x1c", ".", "!?", "   ", "\r\n", "x" * 40]
    words = packing._WordIds(packing.vocabulary())
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14)))
        assert np.frombuffer(words.of(text), "<u4").tolist() == encode(text)[:-1], repr(text)


def test_ranks_are_the_whole_vocabulary(tmp_path):
    """Merging by rank gives every entry of the vocabulary its own id, as merging by rule does."""
    import json

    path = packing.vocabulary()
    ranks, words = packing.byte_ranks(path), packing._WordIds(path)
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    assert sorted(ranks.values()) == sorted(whole["model"]["vocab"].values())
    for token, number in ranks.items():
        text = token.decode("utf-8", "ignore")
        if text.encode() == token and text and max(text) < "ɐ":
            assert packing.ids_bytes(words.fast(text)) == words.encode(text), text
    whole["model"]["merges"][:2] = whole["model"]["merges"][1::-1]
    (tmp_path / "t.json").write_text(json.dumps(whole))
    assert packing.byte_ranks(str(tmp_path / "t.json")) is None


def test_long_words_are_not_kept():
    words = packing._WordIds(packing.vocabulary())
    words.of("short " + "x" * 65 + " " + "y" * 100_000 + " short end")
    assert sorted(words) == ["\tshort", "end", "short"]


def plain_best_fit(lengths, capacity, open_bins):
    """Bins as a list of [number, free], each choice by a search through all of it."""
    bins, used, out = [], 0, []
    for length in lengths:
        fits = [b for b in bins if b[1] >= length]
        if fits:
            own = min(fits, key=lambda b: b[1])
        else:
            if len(bins) >= open_bins:
                bins.remove(min(bins, key=lambda b: b[1]))
            own = [used, capacity]
            used += 1
            bins.append(own)
        out.append((own[1] - length, capacity - own[1], own[1] != capacity))
        own[1] -= length
        if not own[1]:
            bins.remove(own)
    return out, used


@pytest.mark.parametrize("open_bins", [1, 3, 20, 1000])
def test_best_fit(open_bins):
    """Every piece leaves the free space that the naive list leaves: the same bin, or one as full."""
    rng = random.Random(2)
    lengths = [rng.randrange(1, 1024) for _ in range(3000)]
    placed = list(packing.best_fit(iter(lengths), 1024, open_bins))
    rows = [{"sequence_id": b, "offset": o, "length": n} for (b, o), n in zip(placed, lengths, strict=True)]
    used, _ = check(rows)
    wanted, wanted_used = plain_best_fit(lengths, 1024, open_bins)
    assert [(1024 - o - n, o, o > 0) for (_, o), n in zip(placed, lengths, strict=True)] == wanted and used == wanted_used


def test_the_fullest_closes():
    """Two open bins of 1000 and 30 used: a piece of 1000 opens a third, so the one with 24 free closes and 24 goes elsewhere."""
    placed = list(packing.best_fit(iter([1000, 30, 1000, 24, 24]), 1024, 2))
    assert placed == [(0, 0), (1, 0), (2, 0), (2, 1000), (1, 30)]


def test_waste_is_small(spark):
    pieces = spark.range(40_000).select(F.lit(0).alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(1024)) + 1).alias("length"))
    from adjudica.llm.shared import materialise

    used, total = check(packing.pack(materialise(pieces, "t")).collect())
    assert used <= 1.01 * total / 1024
