"""Bytes of repeated passages, found by a suffix array over all texts.

A position is removed if a string of ``length`` bytes that covers it starts anywhere else too.

1. *Reduction.*  The position of ``gap + 1`` in a row whose eight bytes have the least hash (the first of equals) is their cut, and
   texts are cut there, about once in ``gap / 2`` bytes.  So the ``length`` bytes from any position have a cut at most ``gap`` bytes on, at the
   same place wherever they occur, and from a cut on the next ones depend on nothing before it.  Only cuts whose next ``length - gap``
   bytes occur twice can be such; they and what follows them go on.
2. *Suffix array.*  The parts between those cuts, sorted as bytes, are named by their order, and the difference-cover
   algorithm of :mod:`suffix_array` ranks the suffixes of the strings of names.  As no part (with the bytes that its end
   depends on) is a prefix of another, that is the order of the texts' own suffixes.
   Only cuts whose next ``length`` bytes occur twice need a rank, so what is beyond their matches is left out of the strings.
3. *Adjacent prefixes.*  Such a cut's longest match is one of its two neighbours in that order, so comparing neighbours tells of
   each position from the cut to the next whether its ``length`` bytes occur elsewhere.
4. *Merging the others.*  What begins before the first cut of a match (its ragged left edge) is known by (bytes up to the
   cut, as many bytes after it as are missing): cuts that have both alike are one class.  Where cuts of one key have
   several classes, their positions are tried in stretches of doubling length: hashes of what is before and after the cut
   tell of most stretches that none or all of it can match.  The rest are tried again in eighths, and of what is still left each
   position is merged by that pair.

Equal texts are one text of which every byte goes.  Texts longer than a block are cut in overlapping blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.ordering import dense_names
from adjudica.llm.shared import join_folded, materialise, release, small
from adjudica.llm.suffix_array import BASE, suffix_ranks

LENGTH = 400
#: Bytes of a hash that tells of cuts; bytes of text handled at a time; suffixes whose neighbours are compared in one run.
GRAM, BLOCK, BUCKET = 8, 1 << 19, 8192
#: Stretches that repeat themselves after so many bytes or fewer are known without the suffix array.
PERIODS = 32
#: Cuts, spans or rows of them that may be broadcast, at 16 bytes or fewer each.
BROADCAST_CUTS = 4_000_000

_U = np.uint64
_RANDOM = np.random.default_rng(11)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = int(_RANDOM.integers(1 << 40, 1 << 62)) | 5
_FIRST, _SECOND, _MIXER = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xBF58476D1CE4E5B9)
#: The bits of a position in a block, below those of its hash.
_PLACE = _U((1 << 22) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _MIXER
    return x ^ (x >> _U(29))


def _powers(n: int, base: int) -> np.ndarray:
    made = np.full(n, base, np.uint64)
    made[:1] = 1
    return np.multiply.accumulate(made)


@dataclass(frozen=True)
class Rule:
    """Where texts are cut, for matches of ``length`` bytes."""

    length: int

    @property
    def gap(self) -> int:
        """Bytes from a position to its cut, which all occurrences share."""
        return self.length * 4 // 5

    @property
    def least(self) -> int:
        """Bytes after that cut that belong to the match in any case."""
        return self.length - self.gap

    @property
    def enough(self) -> int:
        """Bytes after any cut beyond which nothing is compared."""
        return self.length + self.gap


class Sums:
    """Some texts (or pieces of one) side by side, with the hashes of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.bytes = b"".join(texts)
        n = len(self.bytes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[np.frombuffer(self.bytes, np.uint8)] * _powers(n, _BASE))])
        self.inverse = _powers(n + 1, pow(_BASE, -1, 1 << 64))

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Of the ``size`` bytes from each of ``at``; as bigints."""
        size = np.broadcast_to(size, at.shape)
        plain = (self.sums[at + size] - self.sums[at]) * self.inverse[at]
        return _mix(plain + size.astype(np.uint64) * _SECOND).view(np.int64)


class Block(Sums):
    """Texts with their cuts, and the ``first`` and ``last`` position whose cut each is."""

    def __init__(self, texts: list[bytes], rule: Rule):
        super().__init__(texts)
        self.rule, n = rule, len(self.bytes)
        padded = self.bytes + bytes(2 * GRAM)
        grams = np.empty(n + GRAM, np.uint64)
        for k in range(GRAM):
            grams[k::GRAM] = np.frombuffer(padded, "<u8", (n + 2 * GRAM - k) // GRAM, k)[: len(grams[k::GRAM])]
        at = np.arange(n)
        self.marks = (_mix(grams[:n] * _FIRST) & ~_PLACE) | at.astype(np.uint64)
        low, size = self.marks.copy(), 1
        while size <= rule.gap:  # the least of ``size`` marks from each, doubled
            step = min(size, rule.gap + 1 - size)
            low[: max(0, n - step)] = np.minimum(low[: max(0, n - step)], low[step:])
            size += step
        whole = np.repeat(self.ends - rule.gap - GRAM, self.size) >= at
        at, cuts = at[whole], (low[whole] & _PLACE).astype(np.int64)
        fresh = np.flatnonzero(np.diff(cuts, prepend=-1))
        self.cuts, self.first, self.last = cuts[fresh], at[fresh], at[np.append(fresh[1:], len(at))[: len(fresh)] - 1]
        self.periodic = list(self._periodic(grams))
        kept = np.ones(len(self.cuts), bool)
        for begin, end, q in self.periodic:
            kept[np.searchsorted(self.cuts, begin + rule.length + 4 * q) : np.searchsorted(self.cuts, end - rule.length - q + 1)] = False
        self.cuts, self.first, self.last = self.cuts[kept], self.first[kept], self.last[kept]
        self.text_of = np.searchsorted(self.ends, self.cuts, "right")

    def _periodic(self, grams: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(from, to, period): stretches of a text that repeat themselves, long enough to hold their own second match.

        All their positions are matches of a neighbour one period away.  Cuts deep inside them serve no other position, so
        none are made there: what comes before the stretch is compared over fewer bytes than those up to the first cut left out.
        """
        raw, length = np.frombuffer(self.bytes, np.uint8), self.rule.length
        step = max(1, length // 3)
        for q in range(1, PERIODS + 1):
            at = np.arange(0, len(raw) - q - GRAM + 1, step)  # two of these in a row are in any such stretch
            hit = np.concatenate([[False], grams[at] == grams[at + q], [False]])
            ups, downs = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
            for k in np.flatnonzero(downs - ups > 1):
                lo, hi = max(0, int(at[ups[k]]) - step), min(len(raw) - q, int(at[downs[k] - 1]) + step + GRAM)
                apart = np.concatenate([[-1], np.flatnonzero(raw[lo + q : hi + q] != raw[lo:hi]), [hi - lo]])
                for m in np.flatnonzero(np.diff(apart) > length):
                    begin, end = lo + int(apart[m]) + 1, lo + int(apart[m + 1]) + q
                    yield from self._within(begin, end, q)

    def _within(self, begin: int, end: int, q: int) -> Iterator[tuple[int, int, int]]:
        """The stretches of single texts in one that may go on over several."""
        for t in range(np.searchsorted(self.ends, begin, "right"), np.searchsorted(self.starts, end, "left")):
            a, b = max(begin, int(self.starts[t])), min(end, int(self.ends[t]))
            if b - a >= self.rule.length + q:
                yield a, b, q

    def next_cuts(self) -> np.ndarray:
        """For each cut the next one of its text, or the text's end."""
        end = self.ends[self.text_of]
        return np.where(np.append(self.text_of[1:], -1) == self.text_of, np.append(self.cuts[1:], 0), end)

    def parts_end(self, to: np.ndarray) -> np.ndarray:
        """For each cut, with the next one at ``to``: the end of the bytes that the next one depends on.  It is the first of a lower
        hash, known with its own bytes, or if there is none in ``gap + 1`` positions the least of those, known with all of them."""
        end = self.ends[self.text_of]
        lower = (to < end) & (self.marks[np.minimum(to, len(self.marks) - 1)] < self.marks[self.cuts])
        known = np.where(lower, to, np.maximum(to, self.cuts + self.rule.gap + 1)) + GRAM
        return np.minimum(np.minimum(known, end), self.cuts + self.rule.enough)

    def leads(self) -> tuple[np.ndarray, np.ndarray]:
        """For each cut: the last cut at or before its first position (that position, if there is none), and whether there is none."""
        before = np.searchsorted(self.cuts, self.first, "right") - 1
        free = (before < 0) | (self.text_of[before] != self.text_of)
        return np.where(free, self.first, self.cuts[before]), free


def _pieces(text: bytes, rule: Rule) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, own from, own to) of a text's pieces: each sees enough bytes beyond what it owns."""
    around = 4 * (rule.length + PERIODS)
    for own in range(0, len(text), BLOCK):
        yield max(0, own - around), min(len(text), own + BLOCK + around), own, min(len(text), own + BLOCK)


def blocks(texts: list[tuple[object, bytes]], rule: Rule) -> Iterator[tuple[Block, list[tuple[object, int, int, int]]]]:
    """Blocks of about ``BLOCK`` bytes, with (tag, from, own from, own to) of each piece."""
    held, about, size = [], [], 0
    for tag, text in texts:
        for a, b, own, to in _pieces(text, rule):
            held.append(text[a:b])
            about.append((tag, a, own, to))
            size += b - a
            if size >= BLOCK:
                yield Block(held, rule), about
                held, about, size = [], [], 0
    if held:
        yield Block(held, rule), about


def _owned(block: Block, about: list[tuple[object, int, int, int]], tags: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tag of each cut, its place in its text, whether its piece owns it)."""
    a, own, to = (np.array([x[k] for x in about], np.int64) for k in (1, 2, 3))
    place = block.cuts - block.starts[block.text_of] + a[block.text_of]
    return tags[block.text_of], place, (place >= own[block.text_of]) & (place < to[block.text_of])


def _texts(batch: pa.RecordBatch, *extra: str) -> list[tuple[object, bytes]]:
    columns = [batch.column(c).to_pylist() for c in ("row_no", *extra)]
    return [(tag if extra else tag[0], (t or "").encode("utf-8", "surrogatepass")) for *tag, t in zip(*columns, batch.column("text").to_pylist(), strict=True)]


def _cut_keys(texts: DataFrame, rule: Rule) -> DataFrame:
    """(row_no, at, key, full, to): every cut that has ``rule.least`` bytes after it, and their hash and that of the next ``length`` bytes
    (null: there are fewer); and, without a key, positions ``at`` to ``to`` whose ``length`` bytes occur again a short period away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, about in blocks(_texts(batch), rule):
                row, place, owned = _owned(block, about, np.array([x[0] for x in about], np.int64))
                owned &= block.cuts + rule.least <= block.ends[block.text_of]
                n, again = int(owned.sum()), []
                for begin, end, _ in block.periodic:
                    tag, a, *_ = about[t := int(np.searchsorted(block.ends, begin, "right"))]
                    shift = a - int(block.starts[t])
                    again.append((tag, begin + shift, end - rule.length + shift))
                own = np.array(again, np.int64).reshape(-1, 3)
                none = np.arange(n + len(own)) >= n
                both = lambda x, k: np.concatenate([x, own[:, k]])  # noqa: B023, E731
                keys = np.concatenate([block.hashes(block.cuts[owned], rule.least), np.zeros(len(own), np.int64)])
                at = block.cuts[owned]
                fits = at + rule.length <= block.ends[block.text_of[owned]]
                full = np.concatenate([block.hashes(at, np.where(fits, rule.length, 0)), np.zeros(len(own), np.int64)])
                yield pa.RecordBatch.from_pydict({
                    "row_no": both(row[owned], 0), "at": both(place[owned], 1), "key": pa.array(keys, mask=none),
                    "full": pa.array(full, mask=none | np.append(~fits, np.ones(len(own), bool))), "to": pa.array(both(place[owned], 2), mask=~none),
                })

    return texts.mapInArrow(run, "row_no long, at long, key long, full long, to long")


_PARTS = "row_no long, at long, span long, rest long, live boolean, part binary, key long, full long, more binary, first long, last long, free boolean, lead long"


def _parts(texts: DataFrame, rule: Rule) -> DataFrame:
    """One row for each cut of ``texts`` (row_no, text, cuts, lives) that is in ``cuts``, or that follows such and ends their string.

    ``span``, ``rest``: bytes to the next cut, to the end; ``live``: the cut is in ``lives``; ``part``: the bytes to the next cut and those
    which that depends on (null: no match of a live cut before reaches so far);
    ``key``, ``full``: hashes of the next ``least`` (null: the text has fewer) and ``length`` bytes (or all there are); ``more``: what
    follows those, for the positions up to the next cut; ``first``, ``last``: the positions whose cut it is; ``lead``, ``free``: hash of the bytes
    from where :meth:`Block.leads` says to the cut, and whether no cut is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, about in blocks(_texts(batch, "cuts", "lives"), rule):
                row, place, owned = _owned(block, about, np.array([x[0][0] for x in about], np.int64))
                cuts, of, end = block.cuts, block.text_of, block.ends[block.text_of]
                kept, live = np.zeros(len(cuts), bool), np.zeros(len(cuts), bool)
                bounds = np.searchsorted(of, np.arange(len(about) + 1))
                for k, (tag, *_) in enumerate(about):
                    s = slice(bounds[k], bounds[k + 1])
                    kept[s] = np.isin(place[s], tag[1])
                    live[s] = np.isin(place[s], tag[2])
                after = np.zeros(len(cuts), bool)  # the first cut after those of a string
                after[1:] = kept[:-1] & ~kept[1:] & (of[1:] == of[:-1])
                limit = np.maximum.accumulate(np.where(after, np.minimum(cuts + rule.least, end), -1))
                to = block.next_cuts()
                reach = np.maximum.accumulate(np.where(live, np.minimum(np.minimum(to + rule.length, cuts + rule.enough), end), -1))
                needed = (kept | (cuts < limit)) & (cuts < reach)
                c = np.flatnonzero((kept | needed) & owned)
                part_end, (begin, free) = block.parts_end(to)[c], (x[c] for x in block.leads())
                at, to, stop, raw = cuts[c], to[c], end[c], block.bytes
                rest, shift = stop - at, place[c] - at
                lead = block.hashes(begin, at - begin) ^ np.where(free, int(_FIRST >> _U(1)), 0)  # the one is never equal to the other
                short = rest < rule.least
                once = ~kept[c] & ~short  # no other cut has their next bytes
                part_end = np.where(needed[c], np.where(once, np.minimum(part_end, at + rule.least), part_end), -1)
                more_to = np.where(live[c], np.minimum(np.minimum(to + rule.length - 1, stop), at + rule.enough), 0)
                cut_out = lambda a, b: pa.array([raw[x:y] if y >= 0 else None for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({
                    "row_no": row[c], "at": place[c], "span": to - at, "rest": rest, "live": live[c], "part": cut_out(at, part_end),
                    "key": pa.array(block.hashes(at, np.where(short, 0, rule.least)), mask=short), "full": block.hashes(at, np.minimum(rest, rule.length)),
                    "more": cut_out(np.minimum(at + rule.length, stop), more_to),
                    "first": block.first[c] + shift, "last": block.last[c] + shift, "free": free, "lead": lead,
                })

    return texts.mapInArrow(run, _PARTS)


def _strings(named: DataFrame) -> DataFrame:
    """(row_no, ats, syms, spans): the runs of cuts that follow each other, of rows (row_no, at, span, live, named); ``ats`` has -1 for those
    that aren't live."""
    listed = named.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("at", "span", "named", "live"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s")
            offsets = s.offsets.to_numpy().astype(np.int64)
            inner = s.values.slice(offsets[0], offsets[-1] - offsets[0])
            at, span, name = (inner.field(n).to_numpy() for n in ("at", "span", "named"))
            live = inner.field("live").to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            row = np.repeat(batch.column("row_no").to_numpy(), np.diff(offsets))
            head = np.ones(len(at), bool)
            head[1:] = (at[1:] != at[:-1] + span[:-1]) | (row[1:] != row[:-1])
            starts = np.flatnonzero(head)
            bounds, at = pa.array(np.append(starts, len(at)), pa.int32()), np.where(live, at, -1)
            yield pa.RecordBatch.from_arrays([pa.array(row[starts]), *[pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (at, name, span)]], names=["row_no", "ats", "syms", "spans"])

    return listed.mapInArrow(run, "row_no long, ats array<long>, syms array<long>, spans array<long>")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _matches(sorted_cuts: DataFrame, rule: Rule) -> DataFrame:
    """(row_no, a, b): positions a to b of a text whose ``length`` bytes occur again, by comparing neighbours of the order
    ``place`` of rows (place, row_no, at, rest, full, more).  A run's first and last rows go to both runs that meet there."""
    bucket, within = F.floor(F.col("place") / BUCKET), F.col("place") % BUCKET
    home = F.array_compact(F.array(bucket, F.when(within == 0, bucket - 1), F.when(within == BUCKET - 1, bucket + 1)))
    dealt = sorted_cuts.select("*", F.explode(home).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, place, row, at, whole, full, more, longest match with the one before)
        for batch in batches:
            names = ("bucket", "place", "row_no", "at", "rest", "full", "more")
            found: list[tuple[int, int, int]] = []
            for b, place, row, at, rest, full, more in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                match = -1
                if held and held[0] == b and held[5] == full and rest >= rule.length and held[4] >= rule.length:
                    match = _common(held[6], more)
                if held and held[1] // BUCKET == held[0] and (best := max(match, held[7])) >= 0:
                    found.append((held[2], held[3], held[3] + best))
                held = (b, place, row, at, rest, full, more, match)
            yield _spans(found)
        if held and held[1] // BUCKET == held[0] and held[7] >= 0:
            yield _spans([(held[2], held[3], held[3] + held[7])])

    return dealt.mapInArrow(run, "row_no long, a long, b long")


def _spans(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    made = np.array(found, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(made[:, k]) for k in range(3)], names=["row_no", "a", "b"])


def _edges_of(batch: pa.RecordBatch, rule: Rule) -> Iterator[tuple[Sums, dict[str, np.ndarray], np.ndarray]]:
    """The ``edges`` (at, first, last) of texts (row_no, text, edges), about a block at a time: hashes of the bytes from each
    edge's first position on, its numbers, and where it begins there."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0
    names = ("row_no", "at", "first", "last")

    def made() -> tuple[Sums, dict[str, np.ndarray], np.ndarray]:
        block = Sums([x[4] for x in held])
        return block, {n: np.array([x[k] for x in held], np.int64) for k, n in enumerate(names)}, block.starts

    for row, text, edges in zip(*(batch.column(c).to_pylist() for c in ("row_no", "text", "edges")), strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        for e in edges:
            last = min(e["last"], len(raw) - rule.length, e["at"] - 1)
            if last >= e["first"]:
                held.append((row, e["at"], e["first"], last, raw[e["first"] : e["at"] + rule.length]))
                size += len(held[-1][4])
            if size >= BLOCK:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def _stretches(far: int, fine: bool) -> Iterator[tuple[int, int]]:
    """1 to 1, 2 to 3, 4 to 7, ... up to ``far``; if ``fine``, those of 32 or more in eighths."""
    k = 1
    while k <= far:
        width = k // 8 if fine and k >= 32 else k
        yield from ((lo, lo + width - 1) for lo in range(k, min(2 * k, far + 1), width))
        k *= 2


def _edge_levels(texts: DataFrame, rule: Rule, fine: bool) -> DataFrame:
    """(row_no, at, a, b, may, must): the positions a to b of each edge that are ``lo`` to ``hi`` bytes before its cut, for each of
    :func:`_stretches`, with two hashes.  If a position of two cuts has its ``length`` bytes in common, their cuts have ``may`` in common: the
    last lo bytes before and the ``length - hi`` after.  If they have ``must`` in common, all those positions of theirs have: the hi
    bytes before and ``length - lo`` after (null: the edge or the text has fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, e, begin in _edges_of(batch, rule):
                far, near, cut = e["at"] - e["first"], e["at"] - e["last"], begin + e["at"] - e["first"]
                for lo, hi in _stretches(int(far.max()), fine):
                    s = np.flatnonzero((far >= lo) & (near <= hi))
                    top, c, left = np.minimum(far[s], hi), cut[s], block.ends[s] - cut[s]
                    may = _paired(block.hashes(c - lo, lo), block.hashes(c, np.minimum(max(0, rule.length - hi), left)))
                    fits = (far[s] >= hi) & (left >= rule.length - lo) & (lo <= rule.length)
                    must = _paired(block.hashes(np.where(fits, c - hi, c), np.where(fits, hi, 0)), block.hashes(c, np.where(fits, max(0, rule.length - lo), 0)))
                    yield pa.RecordBatch.from_pydict({
                        "row_no": e["row_no"][s], "at": e["at"][s], "a": e["at"][s] - top, "b": np.minimum(e["at"][s] - lo, e["last"][s]),
                        "may": may, "must": pa.array(must, mask=~fits),
                    })

    return texts.mapInArrow(run, "row_no long, at long, a long, b long, may long, must long")


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _mix(x.view(np.uint64) * _U(3) + y.view(np.uint64)).view(np.int64)


def _edge_windows(texts: DataFrame, rule: Rule) -> DataFrame:
    """(row_no, a, lead, tail): each position of the ``edges`` (at, first, last) of ``texts`` (row_no, text, edges), with the hashes of
    its bytes up to the cut and of those after it that make up ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, e, begin in _edges_of(batch, rule):
                n = e["last"] - e["first"] + 1
                own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p, size = np.repeat(begin, n) + own, np.repeat(e["at"] - e["first"], n) - own
                yield pa.RecordBatch.from_pydict({"row_no": np.repeat(e["row_no"], n), "a": np.repeat(e["first"], n) + own, "lead": block.hashes(p, size), "tail": block.hashes(p + size, rule.length - size)})

    return texts.mapInArrow(run, "row_no long, a long, lead long, tail long")


def _of_texts(texts: DataFrame, lists: DataFrame, held: int) -> DataFrame:
    """``texts`` that have a row in ``lists`` (row_no, a list); the lists of ``held`` items in all are broadcast if those are few."""
    return texts.join(F.broadcast(lists) if held <= BROADCAST_CUTS else lists, "row_no")


def _shared(classes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, shared): whether classes that are alike in ``by`` can share a position that no cut before it tells of."""
    found = classes.groupBy(*by).agg(F.min("lead").alias("x"), F.max("lead").alias("y"), F.max("free").alias("free"), F.count("*").alias("n"))
    return found.select(*by, "n", ((F.col("n") > 1) & ((F.col("x") != F.col("y")) | F.col("free"))).alias("shared"))


def _repeated(texts: DataFrame, rule: Rule, base: int) -> DataFrame:
    """(row_no, a, b): positions of different ``texts`` (row_no, text) whose ``length`` bytes occur elsewhere."""
    cuts = materialise(_cut_keys(texts, rule), "suffix-cuts")
    keyed = cuts.where("key IS NOT NULL").select("row_no", "at", "key", "full")
    periodic = materialise(cuts.where("key IS NULL").select("row_no", F.col("at").alias("a"), F.col("to").alias("b")), "suffix-periodic")
    n_cuts = keyed.count()
    twice = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "suffix-keys")
    chosen = materialise(join_folded(keyed, twice, ["key"], n_cuts).select("row_no", "at", "full"), "suffix-chosen")
    release(cuts, twice)
    fulls = materialise(chosen.where("full IS NOT NULL").groupBy("full").agg(F.count("*").alias("n")).where("n > 1"), "suffix-fulls")
    live = join_folded(chosen, fulls, ["full"], n_cuts).select("row_no", F.lit(None).cast("long").alias("at"), F.col("at").alias("live"))
    both = chosen.select("row_no", "at", F.lit(None).cast("long").alias("live")).unionByName(live)
    wanted = materialise(both.groupBy("row_no").agg(F.collect_list("at").alias("cuts"), F.collect_list("live").alias("lives")), "suffix-wanted")
    release(chosen, fulls)
    held = wanted.agg(F.sum(F.size("cuts") + F.size("lives"))).first()[0] or 0
    parts = materialise(_parts(_of_texts(texts, wanted, held), rule), "suffix-parts")
    matches = _suffix_matches(parts, rule, base)
    release(wanted)
    edges = _edge_matches(texts, parts, n_cuts, rule)
    return matches.unionByName(edges).unionByName(periodic)


def _suffix_matches(parts: DataFrame, rule: Rule, base: int) -> DataFrame:
    """What neighbours in the suffix array tell of the positions from each cut to the next."""
    needed = parts.where("part IS NOT NULL").select("row_no", "at", "span", "live", "part")
    named = dense_names(needed, ["part"], ["row_no", "at"], "suffix-parts-named")
    strings = materialise(_strings(named.drop("place")).withColumn("key", F.monotonically_increasing_id()), "suffix-strings")
    release(named)
    ranks = suffix_ranks(strings.select("key", "syms", "spans"), rule.length, base)
    ranked = strings.join(ranks, "key").select("row_no", F.inline(F.arrays_zip(F.col("ats").alias("at"), F.col("ranks").alias("rank")))).where("at >= 0")
    order = dense_names(ranked, ["rank"], ["row_no", "at"], "suffix-order")
    release(strings, ranks)
    found = _matches(order.drop("named").join(parts.where("live").select("row_no", "at", "rest", "full", "more"), ["row_no", "at"]), rule)
    found = materialise(found, "suffix-matches")
    release(order)
    return found


def _edge_matches(texts: DataFrame, parts: DataFrame, n_cuts: int, rule: Rule) -> DataFrame:
    """What begins before the first cut of a match: the positions of classes, and those that several classes share.  ``parts`` is
    deleted once its classes are known."""
    known = parts.where("key IS NOT NULL AND first <= last")
    last = F.least("last", F.col("at") + F.col("rest") - rule.length)
    member = F.struct("row_no", "at", "first", last.alias("last"))
    classes = known.groupBy("key", "lead", "full").agg(F.min(member).alias("m"), F.max("free").alias("free"), F.count("*").alias("n"))
    classes = materialise(classes, "suffix-classes")
    # members of a class that nothing but the class ties to each other
    free = known.where("free").select("row_no", "first", last.alias("b"), "key", "lead", "full")
    alike = classes.where("n > 1 AND free").select("key", "lead", "full", "n")
    free = join_folded(free, alike, ["key", "lead", "full"], n_cuts).select("row_no", F.col("first").alias("a"), "b").where("a <= b")
    free = materialise(free, "suffix-free")
    release(parts)

    n_classes = classes.count()
    several = materialise(_shared(classes, ["key"]).where("shared").select("key", "n"), "suffix-several")
    edges = join_folded(classes.withColumnRenamed("n", "members"), several, ["key"], n_classes).select("m.*").where("first <= last")
    edge = F.struct("at", "first", "last")
    lists = edges.groupBy("row_no").agg(F.collect_list(edge).alias("edges"), F.count("*").alias("c"))
    lists = materialise(lists, "suffix-edge-lists")
    release(classes, several)
    lists, coarse = _tried(texts, lists, rule, fine=False)
    lists, sure = _tried(texts, lists, rule, fine=True)
    # the others one by one
    held = lists.agg(F.sum("c")).first()[0] or 0
    windows = materialise(_edge_windows(_of_texts(texts, lists.drop("c"), 3 * held), rule), "suffix-windows")
    again = materialise(windows.groupBy("lead", "tail").agg(F.count("*").alias("n")).where("n > 1"), "suffix-again")
    merged = join_folded(windows, again, ["lead", "tail"], windows.count()).select("row_no", "a", F.col("a").alias("b"))
    merged = materialise(merged, "suffix-merged")
    release(lists, windows, again)
    return merged.unionByName(sure).unionByName(coarse).unionByName(free)


def _tried(texts: DataFrame, lists: DataFrame, rule: Rule, *, fine: bool) -> tuple[DataFrame, DataFrame]:
    """The ``edges`` of ``lists`` (row_no, edges, c: how many) tried in stretches: (those left to be tried, as in ``lists``; positions a to b
    of texts (row_no, a, b) known to occur elsewhere).  ``lists`` is deleted."""
    held = lists.agg(F.sum("c")).first()[0] or 0
    levels = materialise(_edge_levels(_of_texts(texts, lists.drop("c"), 3 * held), rule, fine), "suffix-levels")
    release(lists)
    n_levels = levels.count()
    twice = lambda by: materialise(levels.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).where("n > 1"), "suffix-twice")
    may, must = twice("may"), twice("must")
    possible = join_folded(levels, may, ["may"], n_levels).drop("n")
    possible = materialise(possible, "suffix-possible")
    release(levels, may)
    sure = join_folded(possible.where("must IS NOT NULL"), must, ["must"], n_levels).select("row_no", "at", "a", "b")
    sure = materialise(sure, "suffix-sure")
    release(must)
    flagged = possible.join(small(sure.select("row_no", "at", "a", F.lit(True).alias("sure"))), ["row_no", "at", "a"], "left")
    flagged = materialise(flagged.select("row_no", "at", "a", "b", "may", F.coalesce("sure", F.lit(False)).alias("sure")), "suffix-flagged")
    release(possible)
    unsure = flagged.groupBy("may").agg(F.min("sure").alias("all"), F.count("*").alias("n")).where("NOT all").select("may", "n")
    unsure = materialise(unsure, "suffix-unsure")
    left = join_folded(flagged, unsure, ["may"], n_levels)  # the sure ones too, as they can be another's match
    left = left.groupBy("row_no").agg(F.collect_list(F.struct("at", F.col("a").alias("first"), F.col("b").alias("last"))).alias("edges"), F.count("*").alias("c"))
    left = materialise(left, "suffix-edge-lists")
    release(flagged, unsure)
    return left, sure.select("row_no", "a", "b")


def _removed(found: DataFrame, length: int) -> DataFrame:
    """(row_no, spans): the maximal runs of bytes that the ``length`` bytes from the positions of ``found`` cover."""
    listed = found.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s"))
    start = F.struct(F.lit(None).cast("array<struct<from:long,to:long>>").alias("done"), F.lit(-1).cast("long").alias("from"), F.lit(-1).cast("long").alias("to"))

    def add(state: Column, x: Column) -> Column:
        apart = x["a"] > state["to"]
        put = F.concat(F.coalesce(state["done"], F.array().cast("array<struct<from:long,to:long>>")), F.array(F.struct(state["from"].alias("from"), state["to"].alias("to"))))
        return F.struct(
            F.when(apart & (state["to"] >= 0), put).otherwise(state["done"]).alias("done"),
            F.when(apart, x["a"]).otherwise(state["from"]).alias("from"),
            F.greatest(state["to"], x["b"] + length).alias("to"),
        )

    return listed.select("row_no", F.aggregate("s", start, add, lambda s: F.concat(F.coalesce(s["done"], F.array().cast("array<struct<from:long,to:long>>")), F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))).alias("spans"))


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, *, base: int = BASE) -> DataFrame:
    """One row for each row of ``docs``: row (a struct of all its columns), spans (array of (from, to) in bytes, the maximal
    removed runs, in order), n_bytes, kept (the bytes that stay).

    A byte of the UTF-8 text goes if some ``length`` bytes (64 or more) that cover it also start at another place of any text, its own
    included; overlapping matches count, and all are judged on the input.  Null counts as empty; texts shorter than ``length``
    lose nothing, however often they occur; of repeated rows every one is emptied, and so is one text under several ids.
    Empty tables give no rows.  Columns keep their names inside ``row``, whatever they are.
    """
    if length < 64:
        raise ValueError("length must be at least 64")
    rule, raw = Rule(length), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_no"), F.struct(F.xxhash64(raw).alias("x"), F.substring(F.md5(raw), 1, 16).alias("y")).alias("sign"), F.octet_length(raw).cast("long").alias("n_bytes"))
    rows = materialise(rows, "suffix-rows")
    long = rows.where(F.col("n_bytes") >= length)
    copied = materialise(long.groupBy("sign").agg(F.min("row_no").alias("kept_no"), F.count("*").alias("n")).where("n > 1"), "suffix-copied")
    copies = materialise(join_folded(long.select("row_no", "sign"), copied, ["sign"], rows.count()).select("row_no", (F.col("row_no") == F.col("kept_no")).alias("stays")), "suffix-copies")
    others = small(copies.where("NOT stays").select("row_no"))
    texts = long.join(others, "row_no", "left_anti").select("row_no", F.col("row")[text_col].alias("text"))
    found = _repeated(texts, rule, base)
    spans = materialise(_removed(found, length), "suffix-spans")
    held = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    marked = rows.join(small(copies.select("row_no", F.lit(True).alias("copy"))), "row_no", "left")
    marked = marked.join(F.broadcast(spans) if held <= BROADCAST_CUTS else spans, "row_no", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("to")))
    none = F.array().cast("array<struct<from:long,to:long>>")
    marked = marked.select("row", "n_bytes", F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", none)).alias("spans"))
    return marked.select("row", "spans", "n_bytes", _kept(F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary"), F.col("spans")).alias("kept"))


def _kept(raw: Column, spans: Column) -> Column:
    """The bytes outside the spans, concatenated."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out"))

    def add(s: Column, x: Column) -> Column:
        return F.struct(x["to"].alias("at"), F.concat(s["out"], raw.substr((s["at"] + 1).cast("int"), (x["from"] - s["at"]).cast("int"))).alias("out"))

    return F.aggregate(spans, state, add, lambda s: F.concat(s["out"], raw.substr((s["at"] + 1).cast("int"), F.lit(2**31 - 1))))
