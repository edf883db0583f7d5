"""Exact deduplication by an extendible-hash index on shared files.

A *directory* assigns prefixes of a text's hash to buckets.  It starts with one bucket; whenever a bucket holds more
different hashes than its capacity, the directory doubles for it and the bucket splits in two by one more bit, until none
is overfull or the bits are used up.  Every task folds its own rows into *entries* (hash, digest, number of rows, the row
that stays), so a text with a third of all rows is one entry a task.  Entries go to the *owner task* of their bucket, each
with a range of buckets; it folds those of one (hash, digest), numbers those that collide on a hash as a chain, and writes
its buckets to the index files in the shared folder, from which every row gets its answer.  The texts of entries with more than one row are compared byte by byte (the text itself is
a grouping key); texts that differ under one entry, which takes a collision of the digest, become links of their own.

Everything is DataFrame expressions.  Texts are folded before they are shuffled; rows get their entry back without moving
if it is one of the few with many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.llm.shared import BROADCAST_ROWS, join_folded, keep_rows, materialise, small

#: One or more of these code points count as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Different hashes a bucket may hold before the directory doubles for it.
BUCKET_CAPACITY = 100_000
#: Doublings of the directory that one count of the hashes serves.
DOUBLINGS = 8


def normalised(text: Column) -> Column:
    """Null is empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def _prefix(value: Column, bits: Column | int) -> Column:
    """The first ``bits`` bits of a bigint, as a number."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", value, F.lit(64) - bits))


def directory(hashes: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """(depth, prefix, bucket) for every bucket: it holds the hashes whose first ``depth`` bits are ``prefix``; ``bucket`` is
    the least of them.  ``hashes`` has the distinct bigints ``hash``.

    A round counts the hashes by ``DOUBLINGS`` more bits, which gives the sizes of all buckets that so many doublings can
    make; buckets still overfull after them go through the next round alone.  The directory grows as the number of
    buckets, never as that of rows; only the number of overfull buckets reaches the driver.
    """
    depth, found = 0, None
    while True:
        deeper = min(64, depth + DOUBLINGS)
        leaves = hashes.groupBy(_prefix(F.col("hash"), deeper).alias("leaf")).agg(F.count("*").alias("n"))
        at = F.explode(F.sequence(F.lit(depth), F.lit(deeper)))
        own = F.call_function("shiftrightunsigned", F.col("leaf"), F.lit(deeper) - F.col("depth"))
        sizes = leaves.select("leaf", "n", at.alias("depth")).groupBy("depth", own.alias("prefix")).agg(F.sum("n").alias("n"))
        sizes = materialise(sizes, "dedup-sizes")
        over = sizes.where(F.col("n") > capacity)
        parents = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        first = F.lit(depth == 0) & (F.col("depth") == 0)
        split = sizes.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(parents.withColumn("was_over", F.lit(True)), ["depth", "parent"], "left")
        ended = (F.col("n") <= capacity) | (F.col("depth") == 64)
        made = split.where((first | F.col("was_over")) & ended).select("depth", "prefix")
        found = made if found is None else found.unionByName(made)
        over = over.where(F.col("depth") == deeper).select("prefix")
        if deeper == 64 or not over.limit(1).count():
            break
        hashes = hashes.join(small(over), _prefix(F.col("hash"), deeper) == F.col("prefix"), "left_semi")
        depth = deeper
    start = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.col("prefix"), F.lit(64) - F.col("depth")))
    return materialise(found.select("depth", "prefix", start.alias("bucket")), "dedup-directory")


def in_buckets(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """``entries`` with the ``bucket`` of their ``hash``.  There are at most 64 different depths, and each hash has one bucket."""
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]
    if not depths:
        return entries.withColumn("bucket", F.lit(0).cast("long"))
    prefixes = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("hash"), d).alias("prefix")) for d in depths]))
    columns = entries.columns
    return entries.withColumn("at", prefixes).select(*columns, "at.depth", "at.prefix").join(small(buckets), ["depth", "prefix"]).select(*columns, "bucket")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = BUCKET_CAPACITY,
    hash_of: Callable[[Column], Column] = F.xxhash64,
    digest_of: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, raw_hash, bucket, chain.

    Texts are equal when identical after null -> empty and each run of space, tab, LF, VT, FF, CR -> one space.  Of equal
    texts the row with the smallest id stays (a null id is the largest; of rows that tie on the id, one stays).  Empty
    tables give no rows; other columns of ``docs`` are not read.  ``raw_hash`` is xxhash64 of the text as it came.
    ``hash_of`` and ``digest_of`` (default: SHA-256) may be weak: results do not change, only chains get longer.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    read = source.select("doc_id", F.xxhash64("text").alias("raw_hash"), normalised(F.col("text")).alias("norm"))
    sha = F.unhex(F.sha2("norm", 256))
    digested = {} if digest_of is None else {"digest": digest_of(F.col("norm"))}
    keyed = read.select("doc_id", "raw_hash", hash_of(F.col("norm")).alias("hash"), sha.alias("sha"), *[c.alias(k) for k, c in digested.items()], F.monotonically_increasing_id().alias("row_no"), F.spark_partition_id().alias("part"))
    rows = materialise(keyed, "dedup-rows")
    rows = rows if digested else rows.withColumn("digest", F.col("sha"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    entries = rows.groupBy("hash", "digest", "part").agg(F.min(order).alias("first"), F.count("*").alias("n")).drop("part")
    entries = materialise(entries, "dedup-entries")
    placed = in_buckets(entries, directory(entries.select("hash").distinct(), capacity))
    owned = placed.repartitionByRange("bucket").groupBy("bucket", "hash", "digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    index = materialise(owned.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("digest")) - 1), "dedup-index")

    key = [hash_of(F.col("norm")).alias("hash"), *([c.alias(k) for k, c in digested.items()] or [sha.alias("digest")])]
    shared = index.where("n > 1").select("hash").distinct()
    n_shared = shared.limit(BROADCAST_ROWS + 1).count()
    texts = read.select("doc_id", "raw_hash", "norm", *key)
    if n_shared <= BROADCAST_ROWS:  # beyond that texts are folded without a choice: a hot one would fill the task that chooses
        texts_of_shared = read.select("norm", key[0]).join(F.broadcast(shared), "hash", "left_semi").select("norm", *key)
    else:
        texts_of_shared = texts.select("norm", "hash", "digest")
    compared = texts_of_shared.groupBy("hash", "digest", "norm").agg(F.count("*").alias("n"))
    differ = materialise(compared.groupBy("hash", "digest").agg(F.count("*").alias("links")).where("links > 1").select("hash", "digest"), "dedup-differ")
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "raw_hash", "bucket", "chain"]
    n_rows = index.agg(F.sum("n")).first()[0] or 0
    made = {"keep_id": F.col("first.doc_id"), "group_size": F.col("n"), "kept": F.col("row_no") == F.col("first.row_no")}
    answer = join_folded(rows, index, ["hash", "digest"], n_rows).withColumns(made)
    if not differ.limit(1).count():
        return answer.select(*columns)
    # Texts that differ under one hash and digest: group those few entries by the text itself.
    odd = texts.join(small(differ), ["hash", "digest"], "left_semi")
    odd = materialise(odd.withColumn("row_no", F.monotonically_increasing_id()), "dedup-odd")
    link = odd.groupBy("hash", "digest", "norm").agg(F.min(order).alias("first"), F.count("*").alias("n")).join(index.select("hash", "digest", "bucket", "chain"), ["hash", "digest"])
    split = join_folded(odd, link, ["hash", "digest", "norm"], n_rows).withColumns(made | {"sha": sha})
    return answer.join(small(differ), ["hash", "digest"], "left_anti").select(*columns).unionByName(split.select(*columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they came.  See :func:`exact_groups`."""
    found = exact_groups(docs, id_col, text_col, **options)
    decisions = found.groupBy("doc_id", "raw_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n_rows"))
    return keep_rows(docs, materialise(decisions, "dedup-decisions"), ["doc_id", "raw_hash"], [F.col(id_col), F.xxhash64(text_col)])
