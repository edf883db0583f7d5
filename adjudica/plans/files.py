"""Sources and sinks of the reference over rows made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.registry import query
from adjudica.sources import files
from adjudica.sources.tables import read


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS id FROM documents")
def split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running ids within each split."""
    return files.running_ids(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "id")


@query("SELECT CAST(doc_id AS VARCHAR) AS pmid, 'On ' || lang AS title, CASE WHEN doc_id % 3 = 0 THEN 'AIM: a' || chr(10) || 'END: ' || source ELSE source END AS abstract, CAST(1 + doc_id % 2 AS INT) AS authors, lang AS langs, CAST(CASE WHEN doc_id % 2 = 0 THEN 1990 + doc_id % 30 ELSE 2001 END AS INT) AS year FROM documents")
def article_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = F.when(F.col("doc_id") % 3 == 0, F.format_string('<AbstractText Label="AIM">a</AbstractText><AbstractText Label="END">%s</AbstractText>', "source")).otherwise(F.format_string("<AbstractText>%s</AbstractText>", "source"))
    date = F.when(F.col("doc_id") % 2 == 0, F.format_string("<Year>%d</Year>", 1990 + F.col("doc_id") % 30)).otherwise(F.lit("<MedlineDate>Spring 2001 to 2002</MedlineDate>"))
    author = F.repeat(F.lit("<Author><LastName>N</LastName></Author>"), (1 + F.col("doc_id") % 2).cast("int"))
    xml = F.concat(F.format_string("<A><PMID>%d</PMID><Language>%s</Language><ArticleTitle>On %s</ArticleTitle>", "doc_id", "lang", "lang"), sections, author, F.lit("<PubDate>"), date, F.lit("</PubDate></A>"))
    return read(spark, sf_dir, "documents").select(files.article(xml).alias("a")).select("a.pmid", "a.title", "a.abstract", "a.authors", F.array_join("a.langs", ",").alias("langs"), "a.year")


@query("SELECT 'r' || CAST(event_id AS VARCHAR) AS request, CAST(user_id % 50 AS INT) AS prompt_tokens, event_id * 2 AS received, CASE WHEN event_id % 5 <> 0 THEN event_id * 2 + 1 END AS finished FROM events")
def log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    begun = events.select((F.col("event_id") * 2).alias("line_no"), F.format_string("INFO boot\rReceived request r%d tokens=%d", "event_id", F.col("user_id") % 50).alias("line"))
    ended = events.where("event_id % 5 <> 0").select((F.col("event_id") * 2 + 1).alias("line_no"), F.format_string("noise\rFinished request r%d", "event_id").alias("line"))
    return files.log_requests(begun.unionByName(ended))


@query("SELECT doc_id, '<redacted>' AS api_key, lang AS model FROM documents")
def redact_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = files.redacted(F.create_map(F.lit("api_key"), F.col("source"), F.lit("model"), F.col("lang")))
    return read(spark, sf_dir, "documents").select("doc_id", options["api_key"].alias("api_key"), options["model"].alias("model"))


@query("SELECT source, lang, count(*) AS n, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS yes FROM documents GROUP BY source, lang")
def legacy_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old answers yes/no as 1.0/0.0, through a map from old values to new."""
    wire = F.create_map(F.lit("yes"), F.lit(1.0), F.lit("no"), F.lit(0.0))
    old = F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("no")
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(wire[old]).alias("yes"))


@query("SELECT source, CAST(split_part(r, ':', 1) AS VARCHAR) AS run, CAST(split_part(r, ':', 2) AS VARCHAR) AS phase FROM (SELECT DISTINCT source, lang || ':' || source AS r FROM documents) WHERE source <> 'src3'")
def run_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and phases that exist, legacy ones (here src3) left out."""
    return read(spark, sf_dir, "documents").where("source <> 'src3'").select("source", F.col("lang").alias("run"), F.col("source").alias("phase")).distinct()
