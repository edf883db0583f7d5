"""Phrase collocations, counted by pivot partitioning.

Every word of a language gets a number by falling frequency, so a larger number is a rarer word; words too rare for any
phrase are breaks.  An n-gram belongs to its rarest word (the first one, where that occurs twice), its pivot.  Each occurrence
of a word yields one fragment: the up to three words on either side that no rarer word or break comes before.  Fragments go to
the partition of their pivot, packed by columns; there the n-grams that hold the pivot are counted level by level, longer
ones only where the shorter ones are frequent.  An n-gram is counted in its pivot's partition and nowhere else.  The fragments
of a common pivot are dealt over several partitions, whose counts are added up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.ordering import running_counts
from adjudica.llm.shared import materialise, release, small

LONGEST, LEAST, KEEP, COVER = 4, 30, 2000, (80, 100)
#: Frequent words, and their bytes, that are broadcast; beyond, lots of so many texts ask for their own words' numbers.
DICTIONARY_WORDS, DICTIONARY_BYTES, LOT = 1_000_000, 32 << 20, 64
#: Different words that a task counts before it puts them out; words whose fragments it holds; fragments of a pivot in one partition.
WORDS, HELD, LOAD = 200_000, 1_000_000, 500_000
#: Tasks that count, at most; each takes its partitions one after the other.
TASKS = 1 << 15

_TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]")
_WORD = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")
_SIDE = LONGEST - 1
#: (words before the pivot, words after it) of the n-grams, shorter ones first.
_SHAPES = sorted(((x, y) for x in range(LONGEST) for y in range(LONGEST) if 1 <= x + y <= _SIDE), key=lambda s: (sum(s), -s[0]))


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, c) of rows (lang, text); words as bytes.  A task adds up what it reads before rows move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
                if sum(map(len, held.values())) > WORDS:
                    yield from put(held)
                    held = {}
        yield from put(held)

    def put(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.binary()), "c": pa.array(list(c.values()), pa.int64())})

    return rows.mapInArrow(count, "lang string, word binary, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def fragments(ids: np.ndarray) -> np.ndarray:
    """The fragments of numbered words (0: a break), one row of ``2 * 3 + 1`` numbers each, the pivot in the middle; 0 where a
    fragment doesn't reach.  Words without a neighbour to go with give none."""
    n, pad = len(ids), np.zeros(_SIDE, ids.dtype)
    around = np.concatenate([pad, ids, pad])
    made = np.zeros((2 * _SIDE + 1, n), ids.dtype)
    made[_SIDE] = ids
    for side in (-1, 1):
        reaches = ids > 0
        for k in range(1, _SIDE + 1):
            other = around[_SIDE + side * k :][:n]
            reaches = reaches & (other > 0) & (other < ids if side < 0 else other <= ids)
            made[_SIDE + side * k] = np.where(reaches, other, 0)
    return made[:, (made[_SIDE - 1] > 0) | (made[_SIDE + 1] > 0)]


def _packed(found: np.ndarray, partitions: int, common: int, salts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, whole, blob): the fragments of each partition in one blob.  Pivots up to ``common`` are dealt over ``salts``."""
    found = found.astype(np.uint32)
    pivot = found[_SIDE].astype(np.int64)
    dealt = pivot <= common
    near = found[_SIDE - 1].astype(np.int64) * 31 + found[_SIDE + 1].astype(np.int64) * 17
    salt = np.where(dealt, near % salts[np.minimum(pivot, common)], 0)
    part = ((pivot * 2654435761 + salt * 40503) & 0xFFFFFFFF) % partitions
    order = np.lexsort((part, dealt))
    found, part, dealt = found[:, order], part[order], dealt[order]
    pack = zstandard.ZstdCompressor(level=1)
    starts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (dealt[1:] != dealt[:-1])))
    for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
        blob = pack.compress(np.ascontiguousarray(found[:, a:b]).tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part[a]], pa.int64()), "whole": [not dealt[a]], "blob": pa.array([blob], pa.binary())})


def mined(found: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams as rows of numbers, their counts): those that hold a pivot and occur ``least`` times in the fragments ``found``."""
    codes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {(0, 0): (np.ones(found.shape[1], bool), found[_SIDE].astype(np.uint64))}
    for x, y in _SHAPES:
        shorter = (x - 1, y) if x else (x, y - 1)
        valid, code = codes[shorter]
        added = found[_SIDE - x] if x else found[_SIDE + y]
        if x and y:
            valid = valid & codes[x, y - 1][0]
        valid = valid & (added > 0)
        at = np.flatnonzero(valid)
        _, first, inverse, counts = np.unique((code[at].astype(np.uint64) << np.uint64(32)) | added[at], return_index=True, return_inverse=True, return_counts=True)
        frequent = counts >= least
        own = np.zeros(found.shape[1], np.uint64)
        own[at] = inverse
        valid = valid.copy()
        valid[at] = frequent[inverse]
        codes[x, y] = (valid, own)
        if frequent.any():
            yield found[_SIDE - x : _SIDE + y + 1, at[first[frequent]]].T, counts[frequent]


def _numbered(rows: DataFrame, dictionary: DataFrame, partitions: int, common: int, salts: np.ndarray) -> DataFrame:
    """(part, whole, blob) of all fragments of ``rows`` (lang, text)."""
    schema = "part long, whole boolean, blob binary"

    def fragmented(texts: Iterator[tuple[str, bytes]], number: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        size, ids = 0, []
        for lang, text in texts:
            of = number.get(lang)
            if not of:
                continue
            tokens = _TOKEN.findall(text.lower())
            ids.append(np.fromiter((of.get(t, 0) for t in tokens), np.int64, len(tokens)))
            ids.append(np.zeros(1, np.int64))
            size += len(tokens)
            if size >= HELD:
                yield from _packed(fragments(np.concatenate(ids)), partitions, common, salts)
                size, ids = 0, []
        if ids:
            yield from _packed(fragments(np.concatenate(ids)), partitions, common, salts)

    def pairs(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[str, bytes]]:
        return zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)

    words, size = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if words <= DICTIONARY_WORDS and size <= DICTIONARY_BYTES:
        number: dict[str, dict[bytes, int]] = {}
        for r in dictionary.select("lang", "word", "id").toLocalIterator():
            number.setdefault(r[0], {})[bytes(r[1])] = r[2]
        known = rows.sparkSession.sparkContext.broadcast(number)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from fragmented((p for b in batches for p in pairs(b)), known.value)

        return rows.mapInArrow(run, schema)

    lots = materialise(rows.withColumn("lot", F.floor(F.monotonically_increasing_id() / LOT)), "phrase-lots")

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, (lang, text) in zip(batch.column("lot").to_pylist(), pairs(batch), strict=True):
                own = list(set(_WORD.findall(text.lower())))
                yield pa.RecordBatch.from_pydict({"lot": pa.array([lot] * len(own), pa.int64()), "lang": pa.array([lang] * len(own), pa.string()), "word": pa.array(own, pa.binary())})

    def in_lot(texts: pa.Table, asked: pa.Table) -> pa.Table:
        number: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(*(asked.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
            number.setdefault(lang, {})[word] = i
        made = list(fragmented(pairs(texts), number))
        return pa.Table.from_batches(made) if made else pa.table({"part": pa.array([], pa.int64()), "whole": pa.array([], pa.bool_()), "blob": pa.array([], pa.binary())})

    asked = lots.mapInArrow(own_words, "lot long, lang string, word binary").distinct().join(dictionary, ["lang", "word"]).select("lot", "lang", "word", "id")
    return lots.groupBy("lot").cogroup(asked.groupBy("lot")).applyInArrow(in_lot, schema)


def phrase_counts(rows: DataFrame, dictionary: DataFrame, n_words: int, least: int) -> DataFrame:
    """(ids, f): all phrases of 2 to 4 words that occur ``least`` times in ``rows`` (lang, text), as arrays of numbers."""
    many = dictionary.where(F.col("c") > LOAD).orderBy(F.desc("c"), "id").select("c").collect()  # at most n_words / LOAD rows
    common, salts = len(many), np.array([1, *[-(-r[0] // LOAD) for r in many]], np.int64)
    partitions = max(12, 2 * n_words // LOAD)
    packed = _numbered(rows, dictionary, partitions, common, salts)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None
        for batch in batches:
            for part, whole, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "whole", "blob")), strict=True):
                if held and at != (part, whole):
                    yield from out(held, at[1])
                    held = []
                at = (part, whole)
                held.append(np.frombuffer(zstandard.decompress(blob), np.uint32).reshape(2 * _SIDE + 1, -1))
        if held:
            yield from out(held, at[1])

    def out(held: list[np.ndarray], whole: bool) -> Iterator[pa.RecordBatch]:
        for grams, counts in mined(np.concatenate(held, axis=1), least if whole else 1):
            size = grams.shape[1]
            ids = pa.ListArray.from_arrays(pa.array(np.arange(0, grams.size + 1, size), pa.int32()), pa.array(grams.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64)), pa.array(np.full(len(counts), whole))], names=["ids", "f", "whole"])

    counted = packed.repartition(min(partitions, TASKS), "part").sortWithinPartitions("part", "whole").mapInArrow(mine, "ids array<long>, f long, whole boolean")
    if not common:
        return materialise(counted.select("ids", "f"), "phrase-counts")
    counted = materialise(counted, "phrase-partial")
    added = counted.where("NOT whole").groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    counts = materialise(counted.where("whole").select("ids", "f").unionByName(added), "phrase-counts")
    release(counted)
    return counts


def _cut(ids: Column, of: int, size: Column) -> Column:
    return F.slice(ids, of, size)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = LEAST, keep: int = KEEP, cover: tuple[int, int] = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``keep`` phrases of each language.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends and those into words at blanks and tabs; a null
    language is ``und``, a null text empty.  Candidates are phrases of 2 to 4 words within a piece that occur ``a >= least`` times,
    overlaps included.  A cut after the first k words has ``l`` and ``r`` occurrences of the parts and the score
    floor(2000000 * a / (l + r)); the lowest score counts, ties to the smallest k.  A candidate inside a longer one that occurs
    in at least ``cover`` of its occurrences goes, whether or not the longer one stays.  Order: score and ``a`` falling, phrase by its
    bytes.  ``n``: all words of the language.  Rows may repeat; other columns are not read; empty tables give no rows.
    """
    rows = _rows(docs, text_col, lang_col)
    words = materialise(word_counts(rows), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    n_words = words.agg(F.sum("c")).first()[0] or 0
    ordered = running_counts(words.where(F.col("c") >= least), [F.desc("c"), F.col("lang"), F.col("word")], {"place": F.lit(1)}, "phrase-order")
    dictionary = materialise(ordered.select("lang", "word", "c", (F.col("place") + 1).alias("id")), "phrase-dictionary")
    if dictionary.count() >= 1 << 32:
        raise ValueError("words are numbered by 32 bits")
    counts = phrase_counts(rows, dictionary, n_words, least)

    # the lowest-scoring cut
    of_part = counts.unionByName(dictionary.select(F.array("id").alias("ids"), F.col("c").alias("f")))
    cut = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    cuts = counts.select("ids", F.col("f").alias("a"), cut).select("*", _cut(F.col("ids"), 1, F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"))
    cuts = cuts.join(of_part.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(of_part.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.select("ids", "a", "k", "l", "r", score.alias("score")).groupBy("ids").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # those that a longer candidate covers
    size = F.size("ids")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: F.slice("ids", at, m))))
    longer = counts.where(size > 2).select(F.explode(F.array_distinct(inner)).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("most"))
    share, whole = cover
    left = scored.join(longer, "ids", "left").where(F.col("most").isNull() | (whole * F.col("most") < share * F.col("a")))
    # back to words
    left = materialise(left.select("ids", "a", "cut.score", "cut.l", "cut.r"), "phrase-left")
    spelt = left.select("ids", F.posexplode("ids").alias("at", "id")).join(small(dictionary.select("id", "lang", "word")), "id")
    spelt = spelt.groupBy("ids").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("s"))
    phrase = F.array_join(F.transform("s", lambda x: x["word"].cast("string")), " ").cast("binary")
    named = left.join(spelt.select("ids", "lang", phrase.alias("phrase")), "ids").drop("ids")
    placed = running_counts(named, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], {"place": F.lit(1)}, "phrase-ranks")
    begins = placed.groupBy("lang").agg(F.min("place").alias("begin")).join(totals, "lang")  # one row a language
    rank = F.col("place") - F.col("begin") + 1
    best = placed.join(small(begins), "lang").select("lang", rank.alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
    return best.where(F.col("rank") <= keep)
