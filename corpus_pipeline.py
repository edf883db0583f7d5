"""The corpus pipeline: language ID, exact dedup, near-dedup, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs`` as they
came.  Every stage works on all rows that its predecessor kept, handles nulls in any column, empty texts, repeated rows
and empty tables as its operator says, and reads nothing but ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.llm import exact_dedup, language_id, mixing, packing, simhash
from adjudica.llm.shared import held_out, materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read as one of the languages in ``lang``: those without a letter (null and empty ones too) go, and those
    of 80 bytes or more that the network gives to no language with a probability of 0.9 or more."""
    return language_id.keep_known_languages(docs, language_id.train(docs, ~held_out(F.col("doc_id"))))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the one of the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more: the one of the
    smallest id."""
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target mix: the square root of each source's share, and as many rows in the mean."""
    return mixing.mix_sources(docs).select("row.*")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of at most 1024 tokens, with its sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("best_fit_packing", pack_stage),
]
#: SQL can't express the language network, the shingle sets or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written to the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
