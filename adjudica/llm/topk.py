"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors become integers.  A component of magnitude m contributes *impacts*: the powers of two that sum to m.  The index
of a group of vectors is one posting segment for each impact, largest first, which lists for each vector the dimensions
and signs that have it; zeros are in no list.  A query batch goes through the segments in that order: the postings of a
vector fetch the queries' components, whose sum times the impact is added to the vector's accumulators.  What a vector has
not contributed yet has a known norm, so by the Cauchy-Schwarz inequality its final score lies within query norm times rest
norm of its accumulator.  Segments stop when that *proves* that few vectors can be among the k best; those are rescored
exactly, all of them.  Nothing is dropped on a guess: without such a proof all segments are added.

Accumulators and scores are integers.  Groups have a bounded size in rows and bytes.  Every group meets every chunk of
queries in one task, the index resident and the queries streaming by; each task returns its k best of a query, and a grouped
limit keeps the k best of all.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.llm.shared import materialise

K, SCALE = 20, 64
#: Vectors of an index group and queries of a chunk: the most that one task holds; queries scored at a time.
GROUP_ROWS, CHUNK_ROWS, BATCH = 8192, 4096, 256
#: Bytes of components that a group or a chunk may have: wide vectors make smaller ones.
PART_BYTES = 32_000_000
#: Segments stop once, on average, so few vectors a query can still be members.
FEW = 64
#: Pairs rescored at a time, and bytes of sums made at a time.
RESCORE, GATHER = 100_000, 500_000
#: Components from here on are scored in whole numbers of any length.
LARGEST = 1 << 62
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double, which holds it exactly (at most the largest double); null where the
    vector is null or has a null or non-finite component."""
    number = lambda x: x.cast("double")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < F.lit(float("inf"))))
    most = F.lit(sys.float_info.max)
    bounded = lambda x: F.greatest(F.least(number(x) * scale, most), -most)
    whole = lambda x: F.when(F.abs(bounded(x)) < F.lit(float(1 << 53)), F.floor(bounded(x)).cast("double")).otherwise(bounded(x))
    return F.when(good, F.transform(vector, whole))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of doubles; short ones are filled with zeros."""
    found = np.zeros((len(vectors), max(1, int(vectors.map(len).max()))))
    for row, v in enumerate(vectors):
        found[row, : len(v)] = v
    return found


def _segments(vectors: np.ndarray) -> list[dict]:
    """The posting segments of integer vectors, largest impact first.  ``rows`` are the vectors that have postings, those with
    most first; a posting's code is its dimension, plus the width if it is negative.  ``codes`` has the first posting of all
    rows, then the second of all that have one, and so on; ``heights`` tells how many rows have one.  ``rest`` has every
    vector's norm after the segment."""
    sizes, width, segments = np.abs(vectors), vectors.shape[1], []
    for bit in range(int(sizes.max(initial=0)).bit_length() - 1, -1, -1):
        of, dims = np.nonzero(sizes >> bit & 1)
        if not len(of):
            continue
        counts = np.bincount(of, minlength=len(vectors))
        rows = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        place = np.zeros(len(vectors), np.int64)
        place[rows] = np.arange(len(rows))
        number = np.arange(len(of)) - np.searchsorted(of, of, "left")
        order = np.lexsort((place[of], number))
        codes = (dims + width * (vectors[of, dims] < 0))[order]
        rest = np.sqrt(((sizes & ((1 << bit) - 1)).astype(np.float64) ** 2).sum(1))
        parts = {"rows": rows.astype(np.int32), "heights": np.bincount(number).astype(np.int32), "codes": codes.astype(np.int32), "rest": rest}
        segments.append({"impact": 1 << bit} | {k: v.tobytes() for k, v in parts.items()})
    return segments


def _index(group: pd.DataFrame) -> pd.DataFrame:
    """One row: ids, vectors and the posting segments, of which vectors with a component of 2**62 or more have none."""
    group = group.sort_values(["vec_id", "row_no"])
    vectors = _matrix(group["v"])
    segments = _segments(vectors.astype(np.int64)) if np.abs(vectors).max() < LARGEST else []
    return pd.DataFrame({"grp": [group["grp"].iloc[0]], "width": [vectors.shape[1]], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()], "segments": [segments]})


def _long_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row inner products of any size, brought into the range of a bigint."""
    exact = [sum(int(a) * int(b) for a, b in zip(q, v, strict=True) if a and b) for q, v in zip(queries, vectors, strict=True)]
    return np.array([min(MOST, max(LEAST, x)) for x in exact], np.int64)


class _Group:
    """An index group in a task; ``processed`` counts the segments that its batches went through."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.vectors = np.frombuffer(row.vectors, np.float64).reshape(len(self.ids), row.width)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.norm = float(np.sqrt((self.vectors**2).sum(1).max(initial=0))) if self.largest < LARGEST else np.inf
        types = {"rows": np.int32, "heights": np.int32, "codes": np.int32, "rest": np.float64}
        self.segments = [(s["impact"], *(np.frombuffer(s[k], t) for k, t in types.items())) for s in row.segments]
        self.processed = 0

    def add(self, scores: np.ndarray, both: np.ndarray, segment: tuple) -> None:
        """Adds a segment to the accumulators (vectors, queries); ``both`` has the queries' components, and negated."""
        impact, rows, heights, codes, _ = segment
        begins = np.cumsum(heights) - heights
        room = max(16, GATHER // (both.itemsize * both.shape[1]))
        for at in range(0, len(rows), room):
            own = rows[at : at + room]
            sums = np.zeros((len(own), both.shape[1]), both.dtype)
            for begin, height in zip(begins, heights, strict=True):
                n = min(height - at, len(own))
                if n <= 0:
                    break
                sums[:n] += both[codes[begin + at : begin + at + n]]
            scores[own] += sums * both.dtype.type(impact)

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of each query's k best vectors in this group, its own id apart."""
        width = self.vectors.shape[1]
        queries = np.pad(queries, ((0, 0), (0, max(0, width - queries.shape[1]))))[:, :width]
        own = np.zeros((len(self.ids), len(queries)), bool)
        first, last = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for q in np.flatnonzero(last > first):
            own[first[q] : last[q], q] = True
        possible = ~own
        reach = width * self.largest * float(np.abs(queries).max(initial=0))  # no sum of any terms is larger
        whole = reach < LARGEST
        if whole:
            kind = np.int32 if reach < 1 << 30 else np.int64
            turned = queries.T.astype(kind)
            both, norms = np.concatenate([turned, -turned]), np.sqrt((queries**2).sum(1))
            scores = np.zeros(own.shape, kind)
            slack = 1 + (width + 8) * 2.0**-52 * (reach + norms.max(initial=0) * self.norm)
            for at, segment in enumerate(self.segments):
                self.add(scores, both, segment)
                self.processed += 1
                rest, done = segment[4], at + 1 == len(self.segments)
                # A proof is worth looking for once what is left is less than the scores' spread.
                if done or np.median(rest) * np.median(norms) > scores[:, :: max(1, len(queries) // 16)].std():
                    continue
                if len(self.ids) > k:
                    margin = rest[:, None] * norms[None] + slack
                    lower = np.where(own, -np.inf, scores - margin)
                    floor = np.partition(lower, -k, axis=0)[-k]
                    possible = ~own & (scores + margin >= floor)
                if possible.sum() <= FEW * len(queries):
                    break
            else:  # all segments are in: the accumulators are the scores
                if len(self.ids) > k:
                    possible = ~own & (scores >= np.partition(np.where(own, np.iinfo(kind).min, scores), -k, axis=0)[-k])
        found = []
        q_of, v_of = np.nonzero(possible.T)
        for at in range(0, len(q_of), RESCORE):
            q, v = queries[q_of[at : at + RESCORE]], self.vectors[v_of[at : at + RESCORE]]
            found.append((q.astype(np.int64) * v.astype(np.int64)).sum(1) if whole else _long_products(q, v))
        exact = np.concatenate(found) if found else np.zeros(0, np.int64)
        order = np.lexsort((v_of, -exact.astype(object) if not whole else -exact, q_of))  # ids are sorted: a smaller place is a smaller id
        q_of, v_of, exact = q_of[order], v_of[order], exact[order]
        rank = np.arange(len(q_of)) - np.searchsorted(q_of, q_of, "left")
        return q_of[rank < k], v_of[rank < k], exact[rank < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` highest integer inner products of each query row, over all rows with
    another id; ties go to the smaller id.

    ``is_query`` is a condition over ``vectors``.  Rows whose id or vector is null, or whose vector holds a null or
    non-finite component, take no part; a vector that is shorter than another counts as filled with zeros, an empty one
    scores 0.  Scores are exact whole numbers; one that a bigint can't hold counts as the largest or smallest that it can.  Rows that repeat an id are each a candidate, and
    each a query with ranks of its own.  Fewer candidates than ``k`` give fewer ranks.  Other columns are not read.
    """
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialise(read.where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("row_no", F.monotonically_increasing_id()), "vectors")
    n, asked, width = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    fit = max(1, PART_BYTES // (8 * max(1, width)))
    groups, chunks = max(1, -(-n // min(GROUP_ROWS, fit))), max(1, -(-asked // min(CHUNK_ROWS, fit)))
    spread = lambda parts: F.pmod(F.xxhash64("row_no"), F.lit(parts)).cast("int")
    segment = "array<struct<impact:bigint,rows:binary,heights:binary,codes:binary,rest:binary>>"
    dealt = rows.select("vec_id", "row_no", "v", spread(groups).alias("grp"))
    index = materialise(dealt.groupBy("grp").applyInPandas(_index, f"grp int, width int, ids binary, vectors binary, segments {segment}"), "impact-index")
    numbers = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    met = index.select("*", numbers(chunks).alias("chunk"))
    asking = rows.where("asks").select("vec_id", "row_no", "v", spread(chunks).alias("chunk"), numbers(groups).alias("grp"))

    def score(query: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(query) and len(held):
            group = _Group(held.iloc[0])
            q = _matrix(query["v"])
            ids, row_no = query["vec_id"].to_numpy(np.int64), query["row_no"].to_numpy(np.int64)
            for at in range(0, len(q), BATCH):
                a, b, s = group.best(ids[at : at + BATCH], q[at : at + BATCH], k)
                parts.append(pd.DataFrame({"row_no": row_no[at + a], "query_id": ids[at + a], "vec_id": group.ids[b], "score": s}))
        return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row_no", "query_id", "vec_id", "score")})

    near = asking.groupBy("grp", "chunk").cogroup(met.groupBy("grp", "chunk")).applyInPandas(score, "row_no long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row_no").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
