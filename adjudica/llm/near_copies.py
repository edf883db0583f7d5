"""Candidates and proof for SimHash near-dedup at a similarity of shingle sets, where few bits of difference miss too much.

At a Jaccard similarity of 0.8, fingerprints of 64 bits differ in 10 bits in the mean and in up to 20: no segment of the
ring need be equal, so segments can't be join keys.  Candidates come from ``BANDS`` keys instead, each made of ``ROWS``
minima of the hashed shingles; a pair of similarity s shares none with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8, and
less above.  Pigeonring budgets and the Hamming check of :mod:`simhash`, for ``MOST`` bits, prune them; the rest are held
against the rule on their whole shingle sets, so only true links are made.

A key that many texts share would yield a square of pairs, so links are made in rounds.  First each text of a key is held
against the key's least.  Keys whose texts that leaves in several components go on: of a key with at most ``CROWD`` texts,
all pairs between components are held against the rule; of a larger one, each text outside the component of a *hub* is held
against the hub, hubs being the texts with most links so far, ``HUBS`` of them in each of ``ROUNDS_OF_HUBS`` rounds.  Copies of one
original all link to it, so it becomes a hub.  What crowded keys still hold in several components is then compared to the end,
by :func:`crossed_links`: no link between texts that share a key is lost by the number of texts that share it.  What remains are
the chances stated at ``MOST`` and ``AGREE``, at any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.llm.components import component_roots
from adjudica.llm.shared import materialise, small

SEED, BANDS, ROWS = 42, 24, 4
#: A key of at most so many texts has all its pairs held against the rule; larger ones have so many hubs in each round.
CROWD, HUBS, ROUNDS_OF_HUBS = 16, 4, 2
#: Texts and bytes of shingles of a block; a task holds two blocks.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
#: Equal minima of all ``BANDS * ROWS``: sets of similarity 0.8 have fewer with a chance below 1e-7.
AGREE = 52
#: Differing bits of 64 that two sets of similarity 0.8 pass with a chance below 1e-6, small sets too.
MOST = 28
#: Shingles whose minima are taken at a time, which bounds the memory that a very long text takes.
BLOCK = 10_000

_U = np.uint64
_FACTORS = np.random.default_rng(10).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | _U(1)


_ONES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # the 8 bits of a byte, lowest first


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _ONES for k in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _chained(parts: Iterable[np.ndarray], start: np.ndarray) -> np.ndarray:
    for part in parts:
        start = _mix(start * _U(3) + part)
    return start


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashed shingles, sorted.  A text of fewer words is one shingle, and so is one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    return np.unique(_chained((hashes[k : k + n] for k in range(size)), np.full(n, size, np.uint64)))


def minima(own: np.ndarray) -> np.ndarray:
    """The ``BANDS * ROWS`` minima of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), BLOCK):
        least = np.minimum(least, ((own[at : at + BLOCK] ^ _FACTORS[:, :1]) * _FACTORS[:, 1:]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys that the minima make."""
    return _chained(least.reshape(BANDS, ROWS).T, np.arange(BANDS, dtype=np.uint64))


def sketches(text: Column, shingle: int) -> Column:
    """Struct of ``keys``, ``fingerprint`` (the SimHash of the set of shingles), ``size`` (of the set) and ``minima`` (16 bits of
    each)."""

    @F.pandas_udf("keys array<long>, fingerprint long, size long, minima binary")
    def made(texts: pd.Series) -> pd.DataFrame:
        keys, prints, sizes, short = [], [], [], []
        for text in texts:  # one set at a time
            own = shingles(text, shingle)
            least = minima(own)
            keys.append(band_keys(least).view(np.int64))
            prints.append(majority(own))
            sizes.append(len(own))
            short.append(_mix(least).astype("<u2").tobytes())
        return pd.DataFrame({"keys": keys, "fingerprint": np.array(prints, np.uint64).view(np.int64), "size": np.array(sizes, np.int64), "minima": short})

    return made(text)


def _sets(text: Column, shingle: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle).view(np.int64) for t in texts])

    return made(text)


def _own_sets(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, own) of the distinct ``nodes``."""
    wanted = texts.join(small(nodes), "node", "left_semi").select("node", _sets(F.col("text"), shingle).alias("own"))
    return materialise(wanted.dropDuplicates(["node"]), "near-sets")


def true_links(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) that the rule links; ``texts`` has (node, text) for each node, which may repeat."""
    nodes = materialise(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "near-nodes")
    sets = _own_sets(nodes, texts, shingle)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _block_links(rows: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links between the components of the two blocks of a task, enough of them to join what the rule joins."""
    left = rows[rows["block"] == rows["a"]]
    right = left if rows["a"].iat[0] == rows["b"].iat[0] else rows[rows["block"] == rows["b"]]
    if left.empty or right.empty:
        return []
    (lm, rm), band = ([np.frombuffer(b"".join(side["minima"]), "<u2").reshape(-1, BANDS * ROWS) for side in (left, right)]), int(rows["band"].iat[0])
    lr, rr = left["root"].to_numpy(), right["root"].to_numpy()
    of = {r: r for r in rows["root"]}  # components met so far, joined as links are found

    def top(r: int) -> int:
        while of[r] != r:
            of[r] = r = of[of[r]]
        return r

    apart = (lr[:, None] != rr) & (left["node"].to_numpy()[:, None] < right["node"].to_numpy() if right is left else True)
    apart &= np.bitwise_count(left["fingerprint"].to_numpy()[:, None].view(np.uint64) ^ right["fingerprint"].to_numpy().view(np.uint64)) <= MOST
    for earlier in range(band):  # such a pair was held against the rule under that key, or is so in that key's task
        apart &= np.ascontiguousarray(lm).view("<u8")[:, None, earlier] != np.ascontiguousarray(rm).view("<u8")[:, earlier]
    found, at = [], np.argwhere(apart)
    for i, group in zip(*np.unique(at[:, 0], return_index=True), strict=True):
        js = at[group:, 1][at[group:, 0] == i]
        alike = (rm[js] == lm[i]).sum(axis=1)
        for j in js[alike >= AGREE]:
            u, v = top(lr[i]), top(rr[j])
            if u == v:
                continue
            a, b = left["own"].iat[i], right["own"].iat[j]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            if shared >= similarity * (len(a) + len(b) - shared):
                of[max(u, v)] = min(u, v)
                found.append((int(left["node"].iat[i]), int(right["node"].iat[j])))
    return found


def crossed_links(members: DataFrame, sketched: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) that join all components that the rule joins within a key; ``members`` has (key, band, node, root).

    A key's texts are dealt to blocks by the size of their sets, so that sizes too different for the rule never meet, and by
    whether they are of the key's commonest component, within which nothing is left to compare.  Each task takes two blocks of
    bounded rows and bytes, tests a pair only under the first key that it shares, and puts out links, never pairs.
    """
    commonest = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("common"))
    step = max(-math.log(similarity) * 1.000001, 1e-3)
    kind = F.floor(F.log("size") / step) * 2 + (F.col("root") == F.col("common")).cast("long")
    nodes = materialise(members.select("node").distinct(), "near-nodes")
    known = sketched.join(small(nodes), "node", "left_semi").select("node", "fingerprint", "size", "minima")
    dealt = materialise(members.join(small(commonest), "key").join(known, "node").withColumn("kind", kind), "near-dealt")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.col("size") * 8) / BLOCK_BYTES)).alias("parts")
    kinds = dealt.groupBy("key", "kind").agg(parts).groupBy("key").agg(F.collect_list(F.struct("kind", "parts")).alias("kinds"))
    block = "(k.kind * 4294967296 + {part})"
    own = F.expr("element_at(filter(kinds, k -> k.kind = kind), 1)")
    placed = dealt.join(small(materialise(kinds, "near-kinds")), "key").withColumn("k", own)
    placed = placed.withColumn("block", F.expr(block.format(part="pmod(xxhash64(node), k.parts)"))).drop("k")
    meets = "abs(floor(k.kind / 2) - floor(kind / 2)) <= 1 AND (k.kind % 2 = 0 OR kind % 2 = 0)"
    others = F.expr(f"flatten(transform(filter(kinds, k -> {meets}), k -> transform(sequence(0L, k.parts - 1), p -> {block.format(part='p')})))")
    sets = _own_sets(nodes, texts, shingle)
    rows = placed.withColumn("others", others).drop("kinds", "kind", "common", "size").join(sets, "node").withColumn("other", F.explode("others")).drop("others")
    tasks = rows.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other")

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(rows, similarity), columns=["u", "v"], dtype="int64")

    return tasks.groupBy("key", "a", "b").applyInPandas(compared, "u long, v long")


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` once the links ``found`` join components."""
    known = roots.select(F.col("u").alias("node"), "root")
    of = lambda side: known.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    between = found.join(of("u"), "u", "left").join(of("v"), "v", "left")
    merged = component_roots(between.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")))
    above = merged.select(F.col("u").alias("root"), F.col("root").alias("above"))
    return materialise(roots.join(above, "root", "left").select("u", F.coalesce("above", "root").alias("root")).unionByName(merged), "near-roots")


def similar_roots(texts: DataFrame, sketched: DataFrame, possible: Callable[[Column], Column], shingle: int, similarity: float, *, crowd: int = CROWD) -> DataFrame:
    """(u, root) of the components that true links between candidates make, as :func:`component_roots` gives them.

    ``sketched`` has (node, keys, fingerprint, size, minima), ``texts`` (node, text); ``possible`` tells of the XOR of two fingerprints
    whether the pair passes the ring's budgets and the Hamming check.
    """
    members = sketched.select("node", "fingerprint", F.posexplode("keys").alias("band", "key"))
    counts = members.groupBy("key").agg(F.min(F.struct("node", "fingerprint")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    opened = materialise(members.join(counts, "key"), "near-keys")
    passes = possible(F.col("fingerprint").bitwiseXOR(F.col("hub.fingerprint")))
    stars = opened.where("node <> hub.node").where(passes).select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct()
    links = materialise(true_links(materialise(stars, "near-stars"), texts, shingle, similarity), "near-links")
    roots = component_roots(links)
    opened = opened.select("key", "band", "node", "fingerprint", (F.col("node") == F.col("hub.node")).alias("was_hub"))
    for number in range(ROUNDS_OF_HUBS):
        known = roots.select(F.col("u").alias("node"), "root")
        rooted = materialise(opened.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
        apart = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
        rooted = materialise(rooted.join(apart, "key"), "near-apart")
        degrees = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        crowded = rooted.where(F.col("n") > crowd)
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc_nulls_last("degree"), "node"))
        chosen = crowded.where(~F.col("was_hub")).join(degrees, "node", "left").withColumn("place", place).where(F.col("place") <= HUBS)
        chosen = materialise(chosen.select("key", F.struct("node", "root", "fingerprint").alias("hub")), "near-hubs")
        met = crowded.join(chosen, "key")
        pairs = met.where("root <> hub.root").where(passes).select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v"))
        if not number:  # all pairs of the other keys, once
            u, v = (rooted.where(F.col("n") <= crowd).select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "fingerprint")]) for side in "uv")
            few = u.join(v, "key").where("node_u < node_v AND root_u <> root_v").where(possible(F.col("fingerprint_u").bitwiseXOR(F.col("fingerprint_v"))))
            pairs = pairs.unionByName(few.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")))
        found = materialise(true_links(materialise(pairs.distinct(), "near-pairs"), texts, shingle, similarity), "near-links")
        if not found.limit(1).count():
            break
        roots = _merged(roots, found)
        links = links.unionByName(found)
        hubs = chosen.select("key", F.col("hub.node").alias("node"), F.lit(True).alias("is_hub"))
        opened = crowded.join(hubs, ["key", "node"], "left").select("key", "band", "node", "fingerprint", (F.col("was_hub") | F.coalesce("is_hub", F.lit(False))).alias("was_hub"))
    rooted = opened.join(roots.select(F.col("u").alias("node"), "root"), "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a <> b").where(F.col("n") > crowd)
    left = materialise(rooted.join(apart.select("key"), "key"), "near-left")
    if not left.limit(1).count():
        return roots
    return _merged(roots, materialise(crossed_links(left, sketched, texts, shingle, similarity), "near-links"))
