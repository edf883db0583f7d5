"""SimHash near-duplicates, with candidates from pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments.  If two fingerprints differ in at most 2 bits, the ring has a
start from which every chain of 1, 2, 3 and 4 consecutive segments keeps within its proportional budget of
2 * length / 4 differences: 0, 1, 1 and 2.  The first segment of such a chain is equal, and, as the chain of three has a
budget of one, the second or the third is equal too: that gives equality keys of two segments to join on, and the chain
budgets prune what the join brings before the full Hamming check.

Only distinct fingerprints take part; copies follow their fingerprint.  Keys shared by more than ``crowd`` fingerprints
(one family of near copies) would yield a square of pairs, so their members are linked otherwise, and exactly: each puts
its 65 fingerprints at distance 0 or 1 on a table, and two meet there if and only if they differ in at most 2 bits.  A
row of that table never has more than 65 members; they are linked to the least, as a star of true links.

With ``similarity`` the rule is a Jaccard similarity of shingle sets instead of a number of bits.  Candidates then come from
:mod:`near_copies`, as equal segments can't be demanded at that distance; the ring's budgets and the Hamming check prune
them, at a number of bits that such pairs keep within, and the shingle sets themselves decide.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.llm import near_copies
from adjudica.llm.components import component_roots
from adjudica.llm.shared import join_folded, keep_rows, materialise

SHINGLE, SEED, BITS, MOST = 3, 42, 64, 2
SEGMENTS, WIDTH = 4, 16
#: A key shared by more fingerprints than this is handled by the table of neighbours.
CROWD = 16
#: Shingles hashed at a time, which bounds the memory that a very long text takes.
BLOCK = 200_000
#: _ONES[b] has the 8 bits of the byte b, lowest first.
_ONES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    ones, xxh = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        pairs = zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)
        hashes = np.array([xxh(joined[a:b], SEED) for a, b in pairs], np.uint64).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(hashes[:, k], minlength=256) @ _ONES
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(text: Column, shingle: int) -> Column:
    @F.pandas_udf(T.LongType())
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return made(text)


def _segment(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, WIDTH * (k % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)


def _within_budgets(differ: Column, most: int = MOST) -> Column:
    """True where some start of the ring keeps all its chains within their budgets."""
    count = [F.bit_count(_segment(differ, k)) for k in range(SEGMENTS)]
    starts = []
    for i in range(SEGMENTS):
        chain, total = F.lit(True), F.lit(0)
        for length in range(1, SEGMENTS + 1):
            total = total + count[(i + length - 1) % SEGMENTS]
            chain = chain & (total <= most * length // SEGMENTS)
        starts.append(chain)
    return starts[0] | starts[1] | starts[2] | starts[3]


def fingerprint_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) over the distinct bigints ``fingerprint``: true links (distance 2 or less), enough of them that the
    components are those of all links."""
    fp = F.col("fingerprint")
    keys = [
        ((F.lit(k).cast("long") * (1 << 2 * WIDTH)) + F.shiftleft(_segment(fp, a), WIDTH) + _segment(fp, b))
        for k, (a, b) in enumerate(combinations(range(SEGMENTS), 2))
    ]  # every (i, i + 1) and (i, i + 2) of the ring
    keyed = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialise(keyed.join(counts, "key"), "simhash-keys")
    few = keyed.where(F.col("n") <= crowd).select("key", "fingerprint")
    other = few.select("key", F.col("fingerprint").alias("v"))
    pairs = few.select("key", F.col("fingerprint").alias("u")).join(other, "key").where("u < v")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    light = pairs.where(_within_budgets(differ)).where(F.bit_count(differ) <= MOST).select("u", "v")
    crowded = keyed.where(F.col("n") > crowd).select("fingerprint").distinct()
    near = [fp, *[fp.bitwiseXOR(F.lit(1 << k if k < BITS - 1 else -(1 << k)).cast("long")) for k in range(BITS)]]
    table = crowded.select("fingerprint", F.explode(F.array(*near)).alias("near"))
    stars = table.groupBy("near").agg(F.min("fingerprint").alias("v"), F.collect_set("fingerprint").alias("all")).where(F.size("all") > 1)
    heavy = stars.select(F.explode("all").alias("u"), "v").where("u <> v")
    return light.unionByName(heavy)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, similarity: float | None = None, crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, raw_hash, row_kept.

    Words are runs without ASCII white space after A-Z -> a-z; shingles have ``shingle`` words; a text of fewer words is one
    shingle.  Without ``similarity``, shingles count as often as they occur, a text without words (null, empty, blank) has
    the fingerprint zero, and fingerprints link at 2 or fewer differing bits.  With it, fingerprints are of the set of
    shingles, all texts without words are alike, and texts link whose sets have at least that Jaccard similarity; it must be
    0.8 or more, which the candidates are laid out for.  ``component_id`` is the smallest id that links reach (a null id
    only where no row of the component has one).  Rows that repeat an id or a whole row each get their row.  Empty tables
    give no rows; other columns are not read.  ``raw_hash`` is xxhash64 of the text.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw_hash")).alias("first")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("raw_hash"), F.col(text_col).alias("text"))
    if similarity is None:
        rows = materialise(rows.select("doc_id", "raw_hash", _fingerprints(F.col("text"), shingle).alias("fingerprint")), "simhash-rows")
        node = "fingerprint"
        classes = materialise(rows.groupBy(node).agg(first, F.count("*").alias("n")), "simhash-classes")
        roots = component_roots(fingerprint_links(classes.select(node), crowd))
    else:
        if not 0.8 <= similarity <= 1:
            raise ValueError("similarity must be from 0.8 to 1")
        texts = rows.select(F.col("raw_hash").alias("node"), "text")
        rows = materialise(rows.select("doc_id", "raw_hash", near_copies.sketches(F.col("text"), shingle).alias("s")).select("doc_id", "raw_hash", "s.*"), "simhash-rows")
        node = "raw_hash"
        classes = materialise(rows.groupBy(node).agg(first, F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("keys", "fingerprint", "size", "minima")]), "simhash-classes")
        possible = lambda differ: _within_budgets(differ, near_copies.MOST) & (F.bit_count(differ) <= near_copies.MOST)
        roots = near_copies.similar_roots(texts, classes.select(F.col(node).alias("node"), "keys", "fingerprint", "size", "minima"), possible, shingle, similarity, crowd=crowd)
        rows = rows.drop("keys", "size", "minima")
    rooted = classes.select(node, "first", "n").join(roots.withColumnRenamed("u", node), node, "left").withColumn("root", F.coalesce("root", node))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    of_class = materialise(rooted.select(node, "root", "n").join(least, "root").select(node, "least", "n"), "simhash-roots")
    n_rows = of_class.agg(F.sum("n")).first()[0] or 0
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("raw_hash") == F.col("least.raw_hash"))
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return join_folded(rows, of_class, [node], n_rows).select("doc_id", hexed, F.col("least.doc_id").alias("component_id"), "raw_hash", kept.alias("row_kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id.  All columns as they came."""
    found = near_groups(docs, id_col, text_col, **options)
    decisions = found.groupBy("doc_id", "raw_hash").agg(F.max("row_kept").alias("kept"), F.count("*").alias("n_rows"))
    return keep_rows(docs, materialise(decisions, "simhash-decisions"), ["doc_id", "raw_hash"], [F.col(id_col), F.xxhash64(text_col)])
