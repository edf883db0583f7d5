"""Freezing a table and verifying it: a Merkle tree over digests of key ranges by hash.

A row's digest is the SHA-256 of its columns; a leaf's is that of the number and the sums of its rows' digests, so it needs no
order, combines before it shuffles and grows with nothing.  Inner nodes are digests of their children's.  Verifying
compares roots, then only the children of nodes that differ, and reads the frozen rows of the leaves that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Children of a node; levels below the root.
FAN, DEPTH = 16, 2
_PARTS = 4


def _digest(columns: list[str]) -> Column:
    """Null and the empty text differ; columns can't run into each other, as each is its own digest."""
    each = [F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(":", *each).cast("binary"), 256)


def _rows(table: DataFrame, key: str) -> DataFrame:
    leaf = F.pmod(F.xxhash64(key), F.lit(FAN**DEPTH)).cast("int")
    return table.select(F.col(key).alias("key"), leaf.alias("leaf"), _digest(sorted(table.columns)).alias("digest"))


def _leaves(rows: DataFrame) -> DataFrame:
    number = lambda k: F.conv(F.substring("digest", 1 + 13 * k, 13), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy("leaf").agg(F.count("*").alias("n"), *[F.sum(number(k)).alias(f"s{k}") for k in range(_PARTS)])
    text = F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(_PARTS)])
    return sums.select(F.lit(DEPTH).alias("level"), F.col("leaf").alias("node"), F.sha2(text.cast("binary"), 256).alias("digest"))


def tree(rows: DataFrame) -> DataFrame:
    """(level, node, digest) of all nodes that have rows: FAN ** DEPTH leaves at most."""
    levels = [_leaves(rows)]
    for level in range(DEPTH - 1, -1, -1):
        listed = F.sort_array(F.collect_list(F.struct("node", "digest")))  # at most FAN children
        text = F.array_join(F.transform(listed, lambda c: F.concat_ws("=", c["node"].cast("string"), c["digest"])), ",")
        above = levels[-1].withColumn("parent", F.floor(F.col("node") / FAN).cast("int")).groupBy("parent")
        levels.append(above.agg(F.sha2(text.cast("binary"), 256).alias("digest")).select(F.lit(level).alias("level"), F.col("parent").alias("node"), "digest"))
    return reduce(DataFrame.unionByName, levels)


def freeze(table: DataFrame, key: str, folder: str) -> str:
    """Writes the digests of ``table``'s rows, by leaf, and its tree to ``folder``; returns the root's digest ('' of an empty table)."""
    _rows(table, key).repartition("leaf").write.partitionBy("leaf").parquet(f"{folder}/rows")
    spark = table.sparkSession
    tree(spark.read.schema("key " + table.schema[key].dataType.simpleString() + ", digest string, leaf int").parquet(f"{folder}/rows")).coalesce(1).write.partitionBy("level").parquet(f"{folder}/tree")
    root = _level(spark, folder, 0).collect()
    return root[0]["digest"] if root else ""


def _level(spark: SparkSession, folder: str, level: int) -> DataFrame:
    return spark.read.schema("node int, digest string, level int").parquet(f"{folder}/tree").where(F.col("level") == level)


def differing_leaves(table: DataFrame, key: str, folder: str) -> list[int]:
    """The leaves whose rows have changed, found from the root down: a level is read only below nodes that differ."""
    spark, now = table.sparkSession, tree(_rows(table, key)).cache()
    nodes = [0]
    for level in range(DEPTH + 1):
        of = F.col("node").isin(nodes)
        frozen = _level(spark, folder, level).where(of).select("node", F.col("digest").alias("was"))
        both = frozen.join(now.where((F.col("level") == level) & of).select("node", "digest"), "node", "full")
        differ = [r[0] for r in both.where(~F.col("was").eqNullSafe(F.col("digest"))).select("node").collect()]
        if level < DEPTH:
            nodes = [FAN * n + k for n in differ for k in range(FAN)]
    now.unpersist()
    return differ


def verify(table: DataFrame, key: str, folder: str) -> DataFrame:
    """(key, problem): keys whose rows are changed, missing or new since :func:`freeze`; none if all digests agree.  A key that
    repeats is held as the multiset of its rows."""
    leaves = differing_leaves(table, key, folder)
    of = F.col("leaf").isin(leaves)
    schema = "key " + table.schema[key].dataType.simpleString() + ", digest string, leaf int"
    frozen = table.sparkSession.read.schema(schema).parquet(f"{folder}/rows").where(of)
    signed = frozen.select("key", "digest", F.lit(-1).alias("sign")).unionByName(_rows(table, key).where(of).select("key", "digest", F.lit(1).alias("sign")))
    odd = signed.groupBy("key", "digest").agg(F.sum("sign").alias("d")).where("d <> 0")
    found = odd.groupBy("key").agg(F.min("d").alias("lost"), F.max("d").alias("won"))
    return found.select("key", F.when((F.col("lost") < 0) & (F.col("won") > 0), "changed").when(F.col("lost") < 0, "missing").otherwise("new").alias("problem"))
