"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counting: tasks hash their words and word pairs, fold equal ones, and send sorted blocks of (hash, count) to shards by hash;
a shard sums them.  No key is hot, as a task sends one entry for each of its words or pairs.  A block goes to one of at most
``FANOUT`` groups of shards, which a second step splits if there are more shards, so the blocks grow as the input.  A shard
then writes its own segment of the filter: a count is quantised to a level on a logarithmic scale, and the n-gram is entered
once for each level up to its own.  Every word and pair is entered, however rare.  The segments together are broadcast,
behind a check of their size.

Scoring: probing an n-gram for level 1, 2, ... until a probe fails gives its quantised count.  A word w after h has

    p(w | h) = (c(h, w) + M * p(w)) / (c(h) + M),   p(w) = (c(w) + D) / (N + D * (V + 1))

The text starts after an end token and ends with one, so c(h) is also the number of pairs that begin with h.

If the filter is larger than a broadcast may be, pair segments go out in a few passes; a word is scored in the pass that
holds its pair, and a document's parts are summed.  The exact counts that give the base score are broadcast too.  Where
either would be more than its bound, nothing is broadcast: texts are gathered in lots, each lot sends its distinct keys to
the shards they belong to, and the answers come back to the lot.  Both ways return the same scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.shared import held_out, materialise

#: The model: mass of the single words, and their added count.
MASS, ADDED = 10.0, 0.5
#: The filter: ratio of the levels' counts, bits of the filter for each entry, bits that an entry sets in one 64-bit word.
RATIO, ENTRY_BITS, PROBES = 1.5, 12, 4
#: Bytes of text for each counting shard; bytes that a filter broadcast and words that an exact broadcast may have.
SHARD_BYTES, FILTER_BYTES, EXACT_WORDS = 12_000_000, 160_000_000, 4_000_000
#: Passes over the texts that a broadcast filter may take; beyond that keys go to the shards.
MOST_PASSES = 4
#: Groups of shards that a task deals blocks to at once.
FANOUT = 1024
#: Bytes hashed at a time, and hashes folded at a time, in a task.
SEGMENT, FOLD = 2_000_000, 3_000_000

WORD, HELD, PAIR = 0, 1, 2
_U = np.uint64
END = _U(0x9E3779B97F4A7C15)
_END = np.array([END])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _scaled(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The upper half of each word, scaled to 0 .. n - 1."""
    return ((x >> _U(32)) * np.asarray(n, np.uint64)) >> _U(32)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, each text's words and then END, and the number of tokens of each text.  A word's hash is
    the XXH64 of its bytes, A-Z lower-cased."""
    found, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
        counts[k] = len(words) + 1
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        found.append(_END)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it (END before the first)."""
    before = np.concatenate(([END], tokens[:-1]))
    return _mix(before * _U(3) + _mix(tokens))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return _scaled(_mix(keys), shards).astype(np.int64)


def _fold(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    if counts is None:
        keys, n = np.unique(keys, return_counts=True)
        return keys, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in one byte each where they fit, else in eight."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int64).tobytes()


def _wide(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, np.uint8 if len(counts) == n else np.int64).astype(np.int64)


BLOCK = "kind int, shard int, keys binary, counts binary"


def _blocks(kind: int, keys: np.ndarray, counts: np.ndarray, shards: int, group: int = 1) -> Iterator[tuple]:
    """(kind, shard, keys, counts) of each group of ``group`` successive shards that has any; ``shard`` is the group's number."""
    of = _shard(keys, shards) // group
    order = np.argsort(of, kind="stable")
    of = of[order]
    edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    for begin, end in zip(edges, edges[1:], strict=False):
        if end > begin:
            pick = order[begin:end]
            yield kind, int(of[begin]), keys[pick].tobytes(), _narrow(counts[pick])


def _record(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "shard", "keys", "counts"])


def _gathered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The folded keys and counts of blocks."""
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
    return _fold(np.concatenate(keys), np.concatenate([_wide(c, len(k)) for k, c in zip(keys, rows["counts"], strict=True)]))


def count_blocks(docs: DataFrame, shards: int, fanout: int = FANOUT) -> DataFrame:
    """Blocks of folded counts of ``docs`` (text, held), by shard: words and pairs of the rows to learn from, words of others."""
    group = max(1, -(-shards // fanout))

    def flushed(waiting: dict[int, list], least: int, to: int, fold) -> Iterator[pa.RecordBatch]:
        for kind, parts in waiting.items():
            if parts and sum(len(p[0]) for p in parts) >= least:
                keys, counts = fold(parts)
                for block in _blocks(kind, keys, counts, shards, to):
                    yield _record([block])
                parts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {WORD: [], HELD: [], PAIR: []}
        own = lambda parts: _fold(np.concatenate([p[0] for p in parts]))
        for batch in batches:
            texts, held = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for part in _spans(texts):
                tokens, counts = hashed([texts[k] for k in part])
                learn = np.repeat(~held[part], counts)
                waiting[WORD].append((tokens[learn],))
                waiting[HELD].append((tokens[~learn],))
                waiting[PAIR].append((pair_keys(tokens)[learn],))
                yield from flushed(waiting, FOLD, group, own)
        yield from flushed(waiting, 1, group, own)

    blocks = docs.mapInArrow(count, BLOCK)
    if group == 1:
        return blocks

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {WORD: [], HELD: [], PAIR: []}
        both = lambda parts: _fold(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        for batch in batches:
            for kind, _, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.frombuffer(keys, np.uint64)
                waiting[kind].append((keys, _wide(counts, len(keys))))
                yield from flushed(waiting, FOLD, 1, both)
        yield from flushed(waiting, 1, 1, both)

    return materialise(blocks, "lm-groups").repartition(-(-shards // group), "shard").mapInArrow(split, BLOCK)


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more for each factor RATIO."""
    return 1 + np.floor(np.log(counts) / math.log(RATIO) + 1e-9).astype(np.int64)


def level_count(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts on the logarithmic scale, or 0 for level 0; a level of one count has that count."""
    low = RATIO ** (levels - 1.0)
    first = np.ceil(low - 1e-6)
    last = np.maximum(first, np.ceil(low * RATIO - 1e-6) - 1)
    return np.where(levels > 0, np.sqrt(first * last), 0.0)


def _entry(keys: np.ndarray, at_level: int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of a segment of ``size`` words that an entry is in, and the bits that it sets there."""
    h = _mix(keys + np.full(1, at_level, np.uint64) * _U(0x9E3779B97F4A7C15 >> 1))
    bits = _U(1) << (h & _U(63))
    for k in range(1, PROBES):
        bits = bits | (_U(1) << ((h >> _U(6 * k)) & _U(63)))
    return _scaled(h, size).astype(np.int64), bits


def _segment(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """A filter segment that holds every (key, 1..level)."""
    size = max(1, -(-int(levels.sum()) * ENTRY_BITS // 64))
    field = np.zeros(size, np.uint64)
    for at in range(1, int(levels.max(initial=0)) + 1):
        word, bits = _entry(keys[levels >= at], at, size)
        np.bitwise_or.at(field, word, bits)
    return field.tobytes()


SHARD = "kind int, shard int, tokens long, types long, n_keys long, keys binary, counts binary, bits binary"


def _shard_row(*values) -> pd.DataFrame:
    return pd.DataFrame([values], columns=[c.split()[0] for c in SHARD.split(", ")])


def _merge_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard of words: exact counts (those seen once only if a held-out text has them too), and the filter segment."""
    keys, counts = _gathered(pdf[pdf["kind"] == WORD])
    held, _ = _gathered(pdf[pdf["kind"] == HELD])
    wanted = (counts > 1) | np.isin(keys, held)
    return _shard_row(WORD, pdf["shard"].iloc[0], counts.sum(), len(keys), wanted.sum(), keys[wanted].tobytes(), counts[wanted].tobytes(), _segment(keys, level(counts)))


def _merge_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard of pairs: the filter segment."""
    keys, counts = _gathered(pdf)
    return _shard_row(PAIR, pdf["shard"].iloc[0], counts.sum(), len(keys), 0, b"", b"", _segment(keys, level(counts)))


class Filter:
    """The filter in a task: segments of one kind lie behind each other.  ``words`` has the number of 64-bit words of each
    (kind, shard); ``segments`` gives (kind, shard, bits), each copied into its place as it comes."""

    def __init__(self, words: dict[tuple[int, int], int], segments: Iterable[tuple[int, int, bytes]], shards: int):
        self.shards, self.field, self.at, self.size = shards, {}, {}, {}
        for kind in {k for k, _ in words}:
            sizes = np.array([words.get((kind, s), 0) for s in range(shards)], np.int64)
            self.at[kind], self.size[kind] = np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes
            self.field[kind] = np.zeros(sizes.sum(), np.uint64)
        for kind, shard, bits in segments:
            at = self.at[kind][shard]
            self.field[kind][at : at + self.size[kind][shard]] = np.frombuffer(bits, np.uint64)

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The quantised level of each key, 0 if it isn't in."""
        if kind not in self.size:
            return np.zeros(len(keys), np.int64)
        shard = _shard(keys, self.shards)
        return probed(self.field[kind], keys, self.size[kind][shard], self.at[kind][shard])


def probed(field: np.ndarray, keys: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Levels of the keys, each looked up in the ``size`` words of ``field`` from ``start``: probes for 1, 2, ... until one
    fails."""
    found, left, at_level = np.zeros(len(keys), np.int64), np.flatnonzero(size > 0), 1
    while len(left):
        word, bits = _entry(keys[left], at_level, size[left])
        left = left[field[word + start[left]] & bits == bits]
        found[left] = at_level
        at_level += 1
    return found


def _log_base(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((counts + 1) / (n + v + 1))


def score_texts(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", *, filter_bytes: int = FILTER_BYTES, exact_words: int = EXACT_WORDS, shard_bytes: int = SHARD_BYTES, most_passes: int = MOST_PASSES, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, learned, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end for each text; a null text has the end
    only.  ``base_score`` sums log10((c + 1) / (N + V + 1)) with exact counts over the texts where ``learn_from`` holds;
    ``n_known`` counts tokens with c > 0; ``score`` is the model's log10 probability.  With nothing to learn from, N and V
    are 0 and every token scores log10(1).  Rows that repeat each count and are each scored; other columns are not read.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (~F.coalesce(learn_from, F.lit(False))).alias("held"))
    total = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    blocks = materialise(count_blocks(read.select("text", "held"), shards, fanout), "lm-blocks")
    merge = lambda kinds, how: blocks.where(kinds).repartition(shards, "shard").groupBy("shard").applyInPandas(how, SHARD)
    merged = materialise(merge(F.col("kind") != PAIR, _merge_words).unionByName(merge(F.col("kind") == PAIR, _merge_pairs)), "lm-shards")
    size = F.octet_length("bits")
    sums = {r["kind"]: r for r in merged.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("tokens", "types", "n_keys")], F.sum(size).alias("bytes"), F.max(size).alias("most")).collect()}
    n, v, n_exact, word_bytes = ((sums[WORD][k] for k in ("tokens", "types", "n_keys", "bytes")) if WORD in sums else (0, 0, 0, 0))
    pair_bytes, most = ((sums[PAIR]["bytes"], sums[PAIR]["most"]) if PAIR in sums else (0, 0))
    room = filter_bytes - word_bytes  # words go out in every pass
    numbered = read.select("doc_id", "held", F.monotonically_increasing_id().alias("row_no"), "text")
    columns = ["doc_id", (~F.col("held")).alias("learned"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"]
    passes: list[list[tuple[int, int]]] = [[]]
    fits = most <= room and pair_bytes <= room * most_passes and n_exact <= exact_words
    if fits:  # few shards, then
        sizes = {(r["kind"], r["shard"]): r["size"] for r in merged.select("kind", "shard", size.alias("size")).collect()}
        for shard in range(shards):  # every shard is in one pass, an empty one too
            own = sizes.get((PAIR, shard), 0)
            if passes[-1] and sum(s for _, s in passes[-1]) + own > room:
                passes.append([])
            passes[-1].append((shard, own))
    if not fits or len(passes) > most_passes:
        return _asked_scores(numbered, merged, shards, n, v).select(*columns)

    context = docs.sparkSession.sparkContext
    keys, counts, at = np.zeros(n_exact, np.uint64), np.zeros(n_exact, np.int64), 0
    for r in merged.where(F.col("kind") == WORD).select("keys", "counts").toLocalIterator():
        to = at + len(r["keys"]) // 8
        keys[at:to], counts[at:to], at = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64), to
    order = np.argsort(keys)
    exact = context.broadcast((keys[order], counts[order].astype(np.min_scalar_type(int(counts.max(initial=0))))))
    del keys, counts, order
    if len(passes) > 1:  # parts of a row meet again by its number
        numbered = materialise(numbered, "lm-rows")
    parts = []
    for number, own in enumerate(passes):
        in_pass = {s for s, _ in own}
        wanted = merged.where((F.col("kind") != PAIR) | F.col("shard").isin(sorted(in_pass))).select("kind", "shard", "bits")
        words = {(kind, shard): b // 8 for (kind, shard), b in sizes.items() if kind != PAIR or shard in in_pass}
        field = context.broadcast(Filter(words, ((r["kind"], r["shard"], r["bits"]) for r in wanted.toLocalIterator()), shards))
        part = numbered.mapInArrow(_scorer(field, exact if number == 0 else None, n, v, number == 0, frozenset(in_pass)), f"{_ddl(numbered, 'doc_id')}, held boolean, row_no long, {SCORES}")
        parts.append(materialise(part, "lm-pass"))  # some numbers a row; so the broadcasts can go
        field.destroy()
    exact.destroy()
    scored = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            scored = scored.unionByName(part)
        scored = scored.groupBy("row_no").agg(F.first("doc_id", True).alias("doc_id"), F.first("held").alias("held"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return scored.select(*columns)


SCORES = "n_tokens long, n_known long, base_score double, score double"


def _ddl(df: DataFrame, *columns: str) -> str:
    """The columns of ``df`` with their types, as a schema string."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _spans(texts: list[str | None]) -> list[np.ndarray]:
    """Places of the texts, in order and in parts of about ``SEGMENT`` characters; a longer text is a part of its own."""
    sizes = np.cumsum([len(t or "") for t in texts])
    parts = np.split(np.arange(len(texts)), np.searchsorted(sizes, np.arange(SEGMENT, sizes[-1] if len(sizes) else 0, SEGMENT)))
    return [part for part in parts if len(part)]


def _known_counts(count: np.ndarray, of: np.ndarray, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Exact count of each token: words seen once are kept only for held-out texts, so a learned text's own are once."""
    return np.where(np.repeat(~held, counts) & (count[of] == 0), 1, count[of])


def _token_probabilities(words: np.ndarray, of: np.ndarray, pairs: np.ndarray, levels, n: int, v: int) -> np.ndarray:
    """p(w | h) of each token; ``levels(kind, keys)`` gives quantised levels, and ``of`` the place in the sorted ``words``."""
    single_count = level_count(levels(WORD, words))
    single = (single_count + ADDED) / (n + ADDED * (v + 1))
    before = np.concatenate(([np.searchsorted(words, END)], of[:-1]))
    pair = np.minimum(level_count(levels(PAIR, pairs)), single_count[before])
    return np.minimum((pair + MASS * single[of]) / (single_count[before] + MASS), 1.0)


def _scorer(field, exact, n: int, v: int, first: bool, own: frozenset[int]):
    """Arrow batches of (doc_id, held, row_no, text) -> scores; a word whose pair is of another pass's shard counts 0."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_filter = field.value
        in_pass = np.isin(np.arange(held_filter.shards), sorted(own))
        for batch in batches:
            texts, held, found = batch.column(3).to_pylist(), np.array(batch.column(1).to_pylist(), bool), []
            for part in _spans(texts):
                tokens, counts = hashed([texts[k] for k in part])
                begin = np.cumsum(counts) - counts
                words, of = np.unique(tokens, return_inverse=True)
                known, base = np.zeros(len(part), np.int64), np.zeros(len(part))
                if exact is not None:
                    keys, exact_counts = exact.value
                    at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
                    c = np.where(keys[at] == words, exact_counts[at], 0).astype(np.int64) if len(keys) else np.zeros(len(words), np.int64)
                    c = _known_counts(c, of, held[part], counts)
                    known, base = np.add.reduceat((c > 0).astype(np.int64), begin), np.add.reduceat(_log_base(c, n, v), begin)
                pairs = pair_keys(tokens)
                p = np.log10(_token_probabilities(words, of, pairs, held_filter.levels, n, v))
                here = p if in_pass.all() else np.where(in_pass[_shard(pairs, held_filter.shards)], p, 0.0)
                found.append(np.stack([counts * first, known, base, np.add.reduceat(here, begin)]))
            values = np.concatenate(found, 1) if found else np.zeros((4, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(values[0].astype(np.int64)), pa.array(values[1].astype(np.int64)), pa.array(values[2]), pa.array(values[3])], names=["doc_id", "held", "row_no", "n_tokens", "n_known", "base_score", "score"])

    return score


def _asked_scores(numbered: DataFrame, merged: DataFrame, shards: int, n: int, v: int) -> DataFrame:
    """Scores of ``numbered`` without a broadcast: distinct keys of each lot go to their shards and come back answered.

    A task holds one shard, or one lot of texts with its answers; a word that every text has is asked once for a lot.
    """

    def in_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _spans(batch.column(3).to_pylist()):
                cut = batch.slice(part[0], len(part))
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(np.full(len(part), cut.column(2)[0].as_py(), np.int64))], names=["doc_id", "held", "row_no", "text", "lot"])

    lots = materialise(numbered.mapInArrow(in_lots, f"{_ddl(numbered, 'doc_id', 'held', 'row_no', 'text')}, lot long"), "lm-lots")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lot = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(lot)) + 1), len(lot)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                tokens, _ = hashed(texts[begin:end])
                for kind, keys in ((WORD, np.unique(tokens)), (PAIR, np.unique(pair_keys(tokens)))):
                    blocks = list(_blocks(kind, keys, np.zeros(len(keys), np.uint8), shards))
                    yield pa.RecordBatch.from_arrays([pa.array([lot[begin]] * len(blocks), pa.int64()), *(pa.array([b[k] for b in blocks], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], names=["lot", "kind", "shard", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the shard at hand: its name, bits, exact keys and counts, sorted
        for batch in batches:
            rows = []
            for lot, kind, shard, keys, counts, bits in zip(*(c for c in batch.columns), strict=True):
                name, keys = (kind.as_py(), shard.as_py()), np.frombuffer(keys.as_py(), np.uint64)
                if bits.is_valid:
                    exact = (keys, np.frombuffer(counts.as_py(), np.int64)) if name[0] == WORD else None
                    held = (name, np.frombuffer(bits.as_py(), np.uint64), exact)
                    continue
                found, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                if held and held[0] == name:
                    found = probed(held[1], keys, np.full(len(keys), len(held[1])), np.zeros(len(keys), np.int64))
                    if held[2] and len(held[2][0]):
                        at = np.minimum(np.searchsorted(held[2][0], keys), len(held[2][0]) - 1)
                        count = np.where(held[2][0][at] == keys, held[2][1][at], 0)
                rows.append((lot.as_py(), name[0], keys.tobytes(), found.astype(np.uint8).tobytes(), count.tobytes() if name[0] == WORD else b""))
            if rows:
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["lot", "kind", "keys", "levels", "counts"])

    asked = lots.select("lot", "text").mapInArrow(ask, "lot long, kind int, shard int, keys binary")
    asked = asked.select("*", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("bits"))
    held = merged.select(F.lit(None).cast("long").alias("lot"), "kind", "shard", "keys", "counts", "bits")
    met = asked.unionByName(held).repartition("kind", "shard").sortWithinPartitions("kind", "shard", F.col("bits").isNull())
    answers = met.mapInArrow(answer, "lot long, kind int, keys binary, levels binary, counts binary")

    def score(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("row_no")
        tables = {}
        for kind in (WORD, PAIR):
            rows = known[known["kind"] == kind]
            load = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in rows[c]] or [np.zeros(0, t)])  # noqa: E731, B023
            keys = load("keys", np.uint64)
            order = np.argsort(keys)
            tables[kind] = keys[order], load("levels", np.uint8)[order].astype(np.int64), load("counts", np.int64)[order] if kind == WORD else None
        tokens, counts = hashed(texts["text"].tolist())
        begin = np.cumsum(counts) - counts
        words, of = np.unique(tokens, return_inverse=True)
        look_up = lambda kind, keys: tables[kind][1][np.searchsorted(tables[kind][0], keys)]
        p = _token_probabilities(words, of, pair_keys(tokens), look_up, n, v)
        c = _known_counts(tables[WORD][2][np.searchsorted(tables[WORD][0], words)], of, texts["held"].to_numpy(bool), counts)
        made = {"n_tokens": counts, "n_known": np.add.reduceat((c > 0).astype(np.int64), begin), "base_score": np.add.reduceat(_log_base(c, n, v), begin), "score": np.add.reduceat(np.log10(p), begin)}
        return pd.DataFrame({"row_no": texts["row_no"], **made})

    scored = lots.select("lot", "row_no", "held", "text").groupBy("lot").cogroup(answers.groupBy("lot")).applyInPandas(score, f"row_no long, {SCORES}")
    return lots.select("doc_id", "held", "row_no").join(scored, "row_no")


def lm_scores(docs: DataFrame, **options) -> DataFrame:
    """The scores of ``docs`` with every row but those whose crc32 of the id leaves 2 modulo 7 to learn from."""
    scored = score_texts(docs, ~held_out(F.col("doc_id"), 7), **options)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
