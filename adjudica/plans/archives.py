"""Corpora in archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.operators.folding import own_folder, spread
from adjudica.registry import query
from adjudica.sources.archives import read_archives, write_archives
from adjudica.sources.tables import read

#: The blanks that are trimmed, the least length of a text, and the length that is kept of it.
BLANKS, LEAST, KEPT = " \t\n\x0b\f\r", 200, 1200


@query("""WITH m AS (SELECT doc_id, lang, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents WHERE doc_id % 10 < 8 AND doc_id % 7 <> 0)
SELECT 'd' || doc_id || '.txt' AS name, CASE WHEN lang = 'en' THEN 'en' ELSE 'es' END AS lang, CAST(length(t) AS BIGINT) AS n_chars, substr(t, 1, 1200) AS head FROM m WHERE length(t) > 200""")
def archive_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to ZIP archives under split and language, then read back: text members of train and dev of over 200
    characters, the language by the path, the first 1200 characters kept as the seed."""
    doc_id, folder = F.col("doc_id"), own_folder(spark, "archives")
    split = F.when(doc_id % 10 < 6, "train").when(doc_id % 10 < 8, "dev").otherwise("test")
    language = F.when(F.col("lang") == "en", "text_files_en").otherwise("text_files")
    ending = F.when(doc_id % 7 == 0, "ann").otherwise("txt")
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))  # an archive for each part of the scan
    write_archives(docs.select(F.format_string("corpus/%s/%s/d%d.%s", split, language, doc_id, ending).alias("name"), "text"), folder)
    found = read_archives(spark, folder, r"/(train|dev)/.*\.txt$", span=1 << 18)
    text = F.trim(F.col("text"), F.lit(BLANKS))
    named = found.select(F.element_at(F.split("name", "/"), -1).alias("name"), F.when(F.col("name").contains("/text_files_en/"), "en").otherwise("es").alias("lang"), text.alias("text"))
    return named.where(F.char_length("text") > LEAST).select("name", "lang", F.char_length("text").cast("long").alias("n_chars"), F.substring("text", 1, KEPT).alias("head"))
