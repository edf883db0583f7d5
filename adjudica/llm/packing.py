"""Best-fit packing of token pieces into sequences.

Documents are tokenised once, on the executors, into narrow piece rows kept in the shared folder.  Pieces are dealt over
packing tasks by a hash of their row number, and every task packs its stream online, in the order of those numbers: a piece
goes into the open bin with the least free space that holds it, found by one bit scan over a bitset keyed by free space.
The number of open bins is fixed; when one more is needed, the fullest closes.  Pieces of a whole sequence need no bin.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.llm.shared import materialise

CAPACITY, END_ID = 1024, 2
#: Open bins of one packing task, and the pieces dealt to it; memory of a task is bounded by both.
OPEN_BINS, TASK_PIECES = 256, 100_000
#: Words whose ids a worker keeps, and the characters that a word may have to be kept: together they bound the cache.
CACHE, CACHED_WORD = 250_000, 64
#: How the vocabulary's words are told apart: contractions, letters, digits, others, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain(text: str) -> bool:
    """Whether a text's white space is single spaces and line feeds, each between other characters, and it has no other
    unprintable ones; other texts are tokenised whole."""
    edges = text[:1] + text[-1:]
    doubled = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    return bool(text) and not doubled and edges[0] not in " \n" and edges[-1] not in " \n" and text.replace("\n", "").isprintable()



def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian uint32."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The byte-level vocabulary of the tokenizer file as ranks of byte strings, or None where ids don't ascend in the order
    of the merges: only where they do is merging by rank the same as merging by rule."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip([255, *merged], merged, strict=False)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {bytes(of[c] for c in token): number for token, number in model["vocab"].items() if all(c in of for c in token)}


class _WordIds(dict):
    """Word -> ids as little-endian uint32 bytes.  Byte-level BPE never merges over the boundary before a single space or
    line feed that stands between other characters, so a text's ids are those of its words, joined.

    A word's key has its leading line feed, a leading tab if it begins its text, or else nothing for its leading space.
    Words of plain Latin letters are merged by rank, others by the tokenizer itself; both read the one file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks, self.fast = byte_ranks(path), None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        return ids_bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def __missing__(self, key: str) -> bytes:
        word = key if key[:1] == "\n" else key[1:] if key[:1] == "\t" else " " + key
        ids = ids_bytes(self.fast(word)) if self.fast and (word.isascii() or max(word) < "ɐ") else self.encode(word)
        if len(key) <= CACHED_WORD:
            if len(self) >= CACHE:
                self.clear()
            self[key] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not plain(text) or any(s in text for s in self.special):
            return self.encode(text)
        return b"".join(map(self.__getitem__, ("\t" + text.replace("\n", " \n")).split(" ")))


@lru_cache(maxsize=2)
def _word_ids(path: str) -> _WordIds:
    return _WordIds(path)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, but for the first, which takes the rest."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((at, capacity) for at in range(first, length, capacity))]


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    path: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each row's text and closing id 2.

    A null text is empty and has one piece of length 1.  Only documents of more than ``capacity`` ids are cut.  ``ids``
    are little-endian uint32 bytes.  An empty table has no pieces; other columns are not read.
    """
    path = path or vocabulary()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([read.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    if with_ids:
        schema.add("ids", T.BinaryType())
    end = ids_bytes([END_ID])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                ids = words.of(text.as_py() or "") + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(row)
                    found.append((piece, start, length, zlib.crc32(part), *([part] if with_ids else ())))
            if rows:
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=schema.names)

    return read.mapInArrow(pieces, schema)


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each length, online.  ``space`` has bit f set while an open bin has f free."""
    space, bins, used, n_open = 0, [[] for _ in range(capacity + 1)], 0, 0
    for length in lengths:
        if fits := space >> length:
            free = length + (fits & -fits).bit_length() - 1
            number = bins[free].pop()
            n_open -= 1
        else:
            if n_open >= open_bins:  # the fullest closes
                fullest = (space & -space).bit_length() - 1
                bins[fullest].pop()
                n_open -= 1
                if not bins[fullest]:
                    space ^= 1 << fullest
            free, number, used = capacity, used, used + 1
        if free < capacity and not bins[free]:
            space &= ~(1 << free)
        yield number, capacity - free
        if left := free - length:
            bins[left].append(number)
            space |= 1 << left
            n_open += 1


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """``pieces`` (a materialised table with ``length``) with ``sequence_id`` and ``offset``; every sequence holds at
    most ``capacity`` tokens, without gaps.  The number of packing tasks follows the number of pieces."""
    numbered = pieces.withColumn("row_no", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") >= capacity).select(*pieces.columns, (-1 - F.col("row_no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = numbered.where(F.col("length") < capacity)
    tasks = max(1, -(-short.count() // task_pieces))
    dealt = short.repartition(tasks, F.xxhash64("row_no")).sortWithinPartitions("row_no").drop("row_no")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = pieces.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        sizes: list[int] = []
        placed = best_fit(iter(sizes.pop, None), capacity, open_bins)
        for batch in batches:
            spots = []
            for length in batch.column(at).to_pylist():
                sizes.append(length)
                spots.append(next(placed))
            numbers, offsets = zip(*spots, strict=True) if spots else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + n for n in numbers], pa.int64()), pa.array(offsets, pa.int64())], names=schema.names)

    return full.unionByName(dealt.mapInArrow(place, schema))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, **options) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32[, ids],
    sequence_id, offset.  See :func:`token_pieces` and :func:`pack`.  Rows that repeat an id are packed each."""
    pieces = materialise(token_pieces(docs, id_col, text_col, capacity=capacity, **options), "pieces")
    return pack(pieces, capacity=capacity, open_bins=open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of a packing made ``with_ids``: the token ids of each sequence in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
