"""Curation queries over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.answers import rounded
from adjudica.functions.text import distinct_grams, normalised
from adjudica.operators import curation as op
from adjudica.registry import query
from adjudica.sources.tables import read

_NORM = "trim(regexp_replace(strip_accents(lower(text)), '[^0-9a-z]+', ' ', 'g'))"
_LEADS = "".join(f" || ' ' || lead(tok, {k}) OVER o" for k in range(1, 8))
_GRAMS = f"""WITH t AS (SELECT doc_id, source, sha256({_NORM}) AS norm_key, CASE WHEN length({_NORM}) > 0 THEN string_split({_NORM}, ' ') ELSE [] END AS w FROM documents),
b AS (SELECT item_id, string_split({_NORM}, ' ') AS w FROM benchmark),
gt AS (SELECT doc_id, tok{_LEADS} AS gram FROM (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM t) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, gram FROM gt WHERE gram IS NOT NULL),
bt AS (SELECT item_id, tok{_LEADS} AS gram FROM (SELECT item_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM b) WINDOW o AS (PARTITION BY item_id ORDER BY pos)),
bank AS (SELECT gram, min(item_id) AS first_key FROM bt WHERE gram IS NOT NULL GROUP BY gram),
hits AS (SELECT doc_id, min(first_key) AS first_key FROM g JOIN bank USING (gram) GROUP BY doc_id)
"""
_REASONS = (
    _GRAMS
    + """, flagged AS (SELECT t.doc_id, t.source, t.norm_key, t.doc_id % 97 = 13 AS excluded, (t.doc_id % 97 = 13 OR h.doc_id IS NOT NULL) AS out FROM t LEFT JOIN hits h USING (doc_id)),
firsts AS (SELECT norm_key, min(doc_id) AS first FROM flagged WHERE NOT out GROUP BY norm_key),
reasons AS (SELECT f.doc_id, f.source, CASE WHEN excluded THEN 'key' WHEN out THEN 'ngram' WHEN f.doc_id > first THEN 'duplicate' ELSE 'kept' END AS reason FROM flagged f LEFT JOIN firsts USING (norm_key))
"""
)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.gram_index(read(spark, sf_dir, "benchmark"), "item_id", "text")


def _excluded():
    """Rows whose key is excluded, as a record number in the bank would be."""
    return F.col("doc_id") % 97 == 13


@query(_GRAMS + "SELECT doc_id, first_key FROM hits")
def contam_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.gram_hits(read(spark, sf_dir, "documents"), "doc_id", "text", _index(spark, sf_dir))


@query(_REASONS + "SELECT doc_id, reason FROM reasons")
def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_reasons(read(spark, sf_dir, "documents"), "doc_id", "text", _index(spark, sf_dir), _excluded())


@query(_REASONS.replace("t.doc_id % 97 = 13", "FALSE") + """SELECT source, count(*) AS n_in, CAST(sum(CASE WHEN reason = 'kept' THEN 1 ELSE 0 END) AS BIGINT) AS n_out,
  CAST(sum(CASE WHEN reason = 'ngram' THEN 1 ELSE 0 END) AS BIGINT) AS n_ngram, CAST(sum(CASE WHEN reason = 'duplicate' THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicate FROM reasons GROUP BY source""")
def contam_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = op.filter_reasons(read(spark, sf_dir, "documents"), "doc_id", "text", _index(spark, sf_dir), F.lit(False), carry=("source",))
    count = lambda r: F.count_if(F.col("reason") == r)
    return reasons.groupBy("source").agg(F.count("*").alias("n_in"), count("kept").alias("n_out"), count("ngram").alias("n_ngram"), count("duplicate").alias("n_duplicate"))


_SUMS = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 13 * k}, 13) AS BIGINT)) AS VARCHAR)" for k in range(4))


@query(_GRAMS + f""", hashed AS (SELECT sha256(gram || chr(9) || CAST(first_key AS VARCHAR)) AS h FROM bank), parts AS (SELECT count(*) AS n, substr(h, 1, 2) || ':' || CAST(count(*) AS VARCHAR) || ':' || {_SUMS} AS line FROM hashed GROUP BY substr(h, 1, 2))
SELECT CAST(sum(n) AS BIGINT) AS grams, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM parts""")
def bank_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the exclusion index, which must cover every part of the bank."""
    index = _index(spark, sf_dir)
    part = F.concat(F.lit("part"), (F.col("item_id") % 4).cast("string"))
    bank = op.token_table(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text").select("item_id", part.alias("part"), "words")
    return op.index_digest(op.covered_index(bank, index, "item_id", "part", [f"part{k}" for k in range(4)]))


@query(_GRAMS + "SELECT doc_id, count(DISTINCT gram) AS grams FROM g GROUP BY doc_id")
def gram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = op.token_table(read(spark, sf_dir, "documents"), "doc_id", "text")
    some = F.filter(F.array(distinct_grams(F.col("words")).cast("long")), lambda n: n > 0)  # a filter on the count would have it made twice
    return words.select("doc_id", F.explode(some).alias("grams"))


@query(_GRAMS + "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, norm_key FROM t")
def norm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = op.token_table(read(spark, sf_dir, "documents"), "doc_id", "text")
    return words.select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.sha2("norm", 256).alias("norm_key"))


@query(_GRAMS + "SELECT doc_id, min(doc_id) OVER (PARTITION BY norm_key) AS first, doc_id = min(doc_id) OVER (PARTITION BY norm_key) AS kept FROM t")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_wins(read(spark, sf_dir, "documents"), "doc_id", F.sha2(normalised(F.col("text")), 256))


_MOD10 = "(list_sum(list_transform(range(1, 64), lambda i: CAST(('0x' || substr(h, i, 1)) AS INT))) * 6 + CAST(('0x' || substr(h, 64, 1)) AS INT)) % 10"
_SPLIT = f"""WITH s AS (SELECT doc_id, source, lang, CASE WHEN source = 'src7' THEN 'train' WHEN {_MOD10} = 0 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, sha256(source || ':' || CAST(doc_id // 3 AS VARCHAR)) AS h FROM documents)) """


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat_ws(":", "source", F.floor(F.col("doc_id") / 3).cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", op.split_of(group, F.col("source"), {"src7": "train"}).alias("split"))


@query(_SPLIT + "SELECT doc_id, split FROM s")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "split")


@query(_SPLIT + ", c AS (SELECT split, lang, count(*) AS c FROM s GROUP BY split, lang) SELECT split, CAST(sum(c) AS BIGINT) AS n, (SELECT lang FROM c x WHERE x.split = c.split ORDER BY x.c DESC, lang LIMIT 1) AS majority, round(max(c) / sum(c), 6) AS share FROM c GROUP BY split")
def split_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.majority_share(_split(spark, sf_dir), ["split"], "lang").withColumn("share", rounded(F.col("share")))


@query(_SPLIT + "SELECT split, lang = 'en' AS restricted, lang, count(*) AS n FROM s GROUP BY ALL")
def bucket_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("split", (F.col("lang") == "en").alias("restricted"), "lang").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT doc_id % 211 AS key, source FROM documents), d AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT source) > 1) SELECT key FROM d")
def double_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.in_several_buckets(read(spark, sf_dir, "documents").select((F.col("doc_id") % 211).alias("key"), "source"), "key", "source")


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY source) // 10) AS step FROM documents),
o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY pos % step, pos) AS place FROM p) SELECT source, doc_id, CAST(place AS INT) AS place FROM o WHERE place <= 10""")
def spread_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op.spread_order(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)
    return placed.where("place <= 10").select("source", "doc_id", "place")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH s AS (SELECT conv_id, turn, sha256(text) AS sha, role FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sha ORDER BY turn) AS rn FROM s) SELECT conv_id, turn, sha FROM r WHERE rn = 1""")
def transcript_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("sha"))
    return rows.groupBy("conv_id", "sha").agg(F.min("turn").alias("turn")).select("conv_id", "turn", "sha")
