"""Text operators of the reference over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.functions.text import folded, rewritten, title_and_abstract
from adjudica.registry import query
from adjudica.sources.tables import read

#: (fact, label, patterns that must all be found, patterns that must not be), over folded text.
FACTS = (
    (1, 1, ["of", "the"], ["idiot"]),
    (2, 0, ["que"], []),
    (3, 1, ["der|die|das"], ["%%%"]),
)


def evidence_status(text, evidence: list[str], traps: list[str]):
    """included / evidence_lost / trap_present; a trap counts before lost evidence."""
    trapped, held = F.lit(False), F.lit(True)
    for p in traps:
        trapped = trapped | text.rlike(p)
    for p in evidence:
        held = held & text.rlike(p)
    return F.when(trapped, "trap_present").when(held, "included").otherwise("evidence_lost")


_FOLD = "trim(regexp_replace(strip_accents(lower(text)), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_FOLD} AS f FROM conversations WHERE text IS NOT NULL), s AS (
SELECT 1 AS fact, CASE WHEN regexp_matches(f, 'idiot') THEN 'trap_present' WHEN regexp_matches(f, 'of') AND regexp_matches(f, 'the') THEN 'included' ELSE 'evidence_lost' END AS status FROM t
UNION ALL SELECT 2, CASE WHEN regexp_matches(f, 'que') THEN 'included' ELSE 'evidence_lost' END FROM t
UNION ALL SELECT 3, CASE WHEN regexp_matches(f, '%%%') THEN 'trap_present' WHEN regexp_matches(f, 'der|die|das') THEN 'included' ELSE 'evidence_lost' END FROM t)
SELECT fact, status, count(*) AS n FROM s GROUP BY ALL""")
def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against every fact: the facts are columns of one pass, not a join."""
    texts = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select(folded(F.col("text")).alias("f"))
    found = F.array(*[F.struct(F.lit(k).alias("fact"), evidence_status(F.col("f"), held, traps).alias("status")) for k, _, held, traps in FACTS])
    return texts.select(F.explode(found).alias("x")).groupBy("x.fact", "x.status").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, sha256(CASE WHEN regexp_matches(t, '(?i)\\bthe\\b') THEN regexp_replace(t, '(\\w+)%%%', '\\1', 'g') ELSE t END) AS sha
FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bidiot\\b') THEN regexp_replace(text, '(?i)\\b(moron|scum)\\b', '[\\1]', 'g') ELSE text END AS t FROM documents)""")
def context_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that rewrite only texts in which another pattern is found."""
    rules = [(r"(?i)\bidiot\b", r"(?i)\b(moron|scum)\b", "[$1]"), (r"(?i)\bthe\b", r"(\w+)%%%", "$1")]
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(rewritten(F.col("text"), rules), 256).alias("sha"))


@query("""WITH s AS (SELECT doc_id, 'Journal: x' || chr(10) || 'Title: ' || left(replace(text, chr(10), ' '), 40) || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE 'Abstract: ' || text END AS state, text FROM documents)
SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 OR left(replace(text, chr(10), ' '), 40) = '' THEN state ELSE left(replace(text, chr(10), ' '), 40) || ' ' || text END) AS sha FROM s""")
def title_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 40)
    body = F.when(F.col("doc_id") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("Abstract: "), F.col("text")))
    state = F.concat(F.lit("Journal: x\nTitle: "), title, F.lit("\n"), body)
    return read(spark, sf_dir, "documents").select("doc_id", state.alias("state")).select("doc_id", F.sha2(title_and_abstract(F.col("state")), 256).alias("sha"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^\\pL\\pN_])(?:with|from|para|pour)(?:$|[^\\pL\\pN_])')")
def primacy_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?iU)\b(?:with|from|para|pour)\b")).select("doc_id")


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^(The|Les) ')")
def verdict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.col("line").rlike("^(The|Les) "))


@query("""WITH o AS (SELECT doc_id, trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS now, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE trim(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END, '[\\x20\\x09-\\x0D]+', ' ', 'g')) END AS was FROM documents)
SELECT CASE WHEN now = '' THEN 'failed' WHEN was IS NULL THEN 'filled' WHEN sha256(was) = sha256(now) THEN 'same' ELSE 'drifted' END AS state, count(*) AS n FROM o GROUP BY 1""")
def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched text against a stored hash: same, drifted, filled where nothing was stored, failed where nothing came."""
    collapse = lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))
    docs = read(spark, sf_dir, "documents")
    stored = F.when(F.col("doc_id") % 11 != 0, F.sha2(collapse(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))), 256))
    rows = docs.select(collapse(F.col("text")).alias("now"), stored.alias("was"))
    state = F.when(F.col("now") == "", "failed").when(F.col("was").isNull(), "filled").when(F.col("was") == F.sha2("now", 256), "same").otherwise("drifted")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(t.shown, d.lang) AS label, count(*) AS n FROM documents d LEFT JOIN (VALUES ('en', 'English'), ('de', 'German')) t(lang, shown) USING (lang) GROUP BY 1")
def label_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "de", "German")])
    return read(spark, sf_dir, "documents").groupBy(F.coalesce(names[F.col("lang")], "lang").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS number FROM pages")
def slug_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions encoded in a name."""
    part = lambda p: F.regexp_extract("url", p, 1)
    return read(spark, sf_dir, "pages").select("url", part(r"^https?://([^/?#]+)").alias("host"), part("/([a-z]{2})/").alias("lang"), F.nullif(part("/([0-9]+)"), F.lit("")).alias("number"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, 'review') THEN 'review' WHEN source IN ('src1', 'src2') AND n_chars > 4000 THEN NULL WHEN source IN ('src1', 'src2') THEN 'meta' WHEN n_chars > 4000 THEN 'rct' WHEN lang = 'de' THEN 'basic' ELSE 'cohort' END AS design FROM documents")
def design_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak labels in order of precedence; two that exclude each other give none."""
    kinds = F.array_compact(F.array(F.when(F.col("source").isin("src1", "src2"), "meta"), F.when(F.col("n_chars") > 4000, "rct"), F.when(F.col("lang") == "de", "basic")))
    has = lambda k: F.array_contains("kinds", k)
    label = F.when(F.col("text").contains("review"), "review").when(has("meta") & has("rct"), F.lit(None)).when(has("meta"), "meta").when(has("rct"), "rct").when(has("basic"), "basic").otherwise("cohort")
    return read(spark, sf_dir, "documents").withColumn("kinds", kinds).select("doc_id", label.alias("design"))


@query("SELECT doc_id, CASE WHEN floor(q + 0.5) BETWEEN 1 AND 6 THEN CASE WHEN floor(q + 0.5) <= 2 THEN 0 WHEN floor(q + 0.5) <= 4 THEN 1 ELSE 2 END END AS level FROM (SELECT doc_id, CAST(n_chars % 140 AS DOUBLE) / 20 AS q FROM documents)")
def level_roundup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-up rounding to 1..6 and a lookup; a value outside has no level."""
    whole = F.floor((F.col("n_chars") % 140).cast("double") / 20 + 0.5)
    return read(spark, sf_dir, "documents").select("doc_id", F.when(whole.between(1, 6), F.when(whole <= 2, 0).when(whole <= 4, 1).otherwise(2)).alias("level"))
