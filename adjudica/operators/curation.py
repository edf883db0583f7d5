"""Curation of text sets: exclusion index, n-gram decontamination, first-wins dedup, filter cascade, group-hash split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.functions.text import grams, hashed_run, hex_modulo_10, let, normalised, tokens
from adjudica.operators.folding import join_folded, spread, staged
from adjudica.sources.files import running_ids

#: Index grams up to this many are broadcast; a larger index is joined by a shuffle.
BROADCAST_GRAMS = 1_000_000


def token_table(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, norm, words) of each text; the text is normalised once."""
    made = let(normalised(F.col(text)), lambda norm: F.struct(norm.alias("norm"), tokens(norm).alias("words")))
    return spread(texts.select(key, text)).select(key, made.alias("t")).select(key, "t.norm", "t.words")


def gram_index(bank: DataFrame, key: str, text: str, n: int = 8) -> DataFrame:
    """(gram, first_key): each n-gram of the bank with its smallest key, written once."""
    words = token_table(bank, key, text)
    index = words.select(key, F.explode(grams(F.col("words"), n)).alias("gram")).groupBy("gram").agg(F.min(key).alias("first_key"))
    return staged(index, "gram-index")


def index_size(index: DataFrame) -> int:
    """Grams of the index, up to one more than may be broadcast; an empty index is refused, as it would pass all."""
    size = index.limit(BROADCAST_GRAMS + 1).count()
    if not size:
        raise ValueError("the exclusion index is empty")
    return size


def gram_hits(texts: DataFrame, key: str, text: str, index: DataFrame, n: int = 8) -> DataFrame:
    """(key, first_key) of texts that share an n-gram with the index, with the smallest bank key they share.

    Texts probe by the hashes of their grams, exploded within a task, and no gram is built as a string; only the texts that
    meet a hash are tokenised again and held against the grams themselves.
    """
    fits = index_size(index) <= BROADCAST_GRAMS
    hashed_index = index.select(hashed_run(F.split("gram", " "), n)[0].alias("hash"), "gram", "first_key")
    probe = F.broadcast(hashed_index) if fits else hashed_index
    words = token_table(texts, key, text)
    each = words.select(key, F.explode(hashed_run(F.col("words"), n)).alias("hash"))
    met = staged(each.join(probe, "hash").select(key, "gram", "first_key").distinct(), "gram-met")
    few = met.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    keys = met.select(key).distinct()
    again = token_table(texts.join(F.broadcast(keys) if few else keys, key, "left_semi"), key, text)
    spaced = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    real = again.join(met, key).where(F.instr(spaced, F.concat(F.lit(" "), F.col("gram"), F.lit(" "))) > 0)
    return real.groupBy(key).agg(F.min("first_key").alias("first_key"))


def index_digest(index: DataFrame) -> DataFrame:
    """(grams, digest): the number of grams, and a sha256 over all grams, each with its key.

    A line 'gram<tab>key' counts by its own sha256, cut into four numbers of 52 bits.  Lines are added up in 256 parts, by the
    first digits of their hash, and the digest is that of the parts' numbers in order.  Adding needs no order and combines
    before rows move, so however large the index is, 256 short rows meet; a gram or a key that changes changes the digest.
    """
    hashed = index.select(F.sha2(F.concat_ws("\t", "gram", F.col("first_key").cast("string")), 256).alias("h"))
    number = lambda k: F.conv(F.substring("h", 1 + 13 * k, 13), 16, 10).cast("decimal(20,0)")
    parts = hashed.groupBy(F.substring("h", 1, 2).alias("part")).agg(F.count("*").alias("n"), *[F.sum(number(k)).cast("string").alias(f"s{k}") for k in range(4)])
    lines = parts.select("n", F.concat_ws(":", "part", F.col("n").cast("string"), "s0", "s1", "s2", "s3").alias("line"))
    return lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("grams"), F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n").cast("binary"), 256).alias("digest"))


class BankError(ValueError):
    """An exclusion bank that would let contaminated texts through."""


def covered_index(bank: DataFrame, index: DataFrame, key: str, phase: str, required: list[str], n: int = 8) -> DataFrame:
    """``index`` (gram, first_key), if the bank behind it covers what it must; else an error, as a run over a bank with a gap
    would pass texts that it should stop.

    ``bank`` has one row a text: ``key``, ``phase`` and ``words`` (its tokens).  Errors: an index without grams, a required phase of
    which no text has ``n`` words, a text whose grams the index does not have.  At most the required phases' counts and one
    key reach the driver.
    """
    if not index.limit(1).count():
        raise BankError("the index has no grams")
    long = bank.where(F.size("words") >= n)
    there = {r[0] for r in long.where(F.col(phase).isin(required)).groupBy(phase).count().collect()}
    if missing := [p for p in required if p not in there]:
        raise BankError(f"no texts of {', '.join(missing)}")
    grams = long.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")))).alias("gram"))
    lost = grams.join(index.select("gram"), "gram", "left_anti").select(key).limit(1).collect()
    if lost:
        raise BankError(f"the index lacks grams of {lost[0][0]}")
    return index


def first_wins(texts: DataFrame, key: str, norm_key: Column) -> DataFrame:
    """(key, first, kept): of rows of equal ``norm_key`` (null is a key like any other) the smallest key stays.

    Copies fold before the shuffle, and rows of a hot key stay in place.
    """
    keyed = staged(spread(texts).select(F.col(key), norm_key.alias("norm_key")), "first-wins")
    firsts = keyed.groupBy("norm_key").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    n_rows = keyed.count()
    return join_folded(keyed, firsts, ["norm_key"], n_rows).select(key, "first", (F.col(key) == F.col("first")).alias("kept"))


def filter_reasons(texts: DataFrame, key: str, text: str, index: DataFrame, excluded: Column, n: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, reason): 'key' for excluded keys, else 'ngram' for hits of the index, else 'duplicate' of an earlier row
    that is kept, else 'kept'.  Only kept texts count as seen, so a copy of a contaminated text is booked as n-gram.

    What the reasons need of a row, a hash and two flags, is written once; texts do not move.
    """
    hits = staged(gram_hits(texts, key, text, index, n).select(key, F.lit(True).alias("hit")), "gram-hits")
    hits = F.broadcast(hits) if hits.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else hits
    norm = F.sha2(normalised(F.col(text)), 256)
    keyed = spread(texts).select(key, *carry, norm.alias("norm_key"), F.coalesce(excluded, F.lit(False)).alias("excluded"))
    flagged = staged(keyed.join(hits, key, "left").withColumn("out", F.col("excluded") | F.coalesce("hit", F.lit(False))), "flagged")
    firsts = flagged.groupBy("norm_key").agg(F.min(F.when(~F.col("out"), F.col(key))).alias("first"), F.count("*").alias("n"))
    reason = F.when(F.col("excluded"), "key").when(F.col("out"), "ngram").when(F.col(key) > F.col("first"), "duplicate").otherwise("kept")
    return join_folded(flagged, firsts, ["norm_key"], flagged.count()).select(key, *carry, reason.alias("reason"))


def split_of(group: Column, source: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """'val' for a tenth of the groups, by the sha256 of the group modulo 10, else 'train'; a source may be fixed to one."""
    split = F.when(hex_modulo_10(F.sha2(group, 256)) == 0, "val").otherwise("train")
    for name, fixed in (overrides or {}).items():
        split = F.when(source == name, fixed).otherwise(split)
    return split


def in_several_buckets(rows: DataFrame, key: str, bucket: str) -> DataFrame:
    """Keys that occur in more than one bucket; all their occurrences are to go."""
    return rows.groupBy(key).agg(F.min(bucket).alias("low"), F.max(bucket).alias("high")).where("low <> high").select(key)


def spread_order(rows: DataFrame, within: str, key: str, target: int) -> DataFrame:
    """``rows`` with ``pos``, ``step`` and ``place``: evenly spaced positions first, then the gaps between them, within each
    ``within`` in the order of the unique bigint ``key``.

    Positions come from ranges of the key; the place follows from position, step and size alone, so no group is sorted.
    With size = q * step + r, the first r residues of a position modulo the step have q + 1 positions, the others q.
    """
    placed = running_ids(rows, within, key, "pos")
    sizes = rows.groupBy(F.col(within).alias("_of")).agg(F.count("*").alias("size"))
    step = F.greatest(F.lit(1), F.floor(F.col("size") / target)).cast("int")
    sized = placed.join(F.broadcast(sizes) if sizes.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else sizes, F.col(within).eqNullSafe(F.col("_of"))).withColumn("step", step)
    residue, q, r = F.col("pos") % F.col("step"), F.floor(F.col("size") / F.col("step")), F.col("size") % F.col("step")
    place = residue * q + F.least(residue, r) + F.floor(F.col("pos") / F.col("step")) + 1
    return sized.withColumn("place", place.cast("int")).drop("_of", "size")


def majority_share(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, n, majority, share: the commonest label of each group; of equal counts the smallest label."""
    counts = rows.groupBy(*by, label).agg(F.count("*").alias("c"))
    best = F.min_by(F.col(label), F.struct(-F.col("c"), F.col(label)))
    return counts.groupBy(*by).agg(F.sum("c").alias("n"), best.alias("majority"), (F.max("c") / F.sum("c")).alias("share"))
