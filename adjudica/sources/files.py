"""Files around the tables: JSON lines, manifests of hashes, article XML, engine logs, report sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.functions.redaction import HIDDEN, TELLING
from adjudica.operators.folding import staged


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines give no rows.  The schema is given, so nothing is read to infer it."""
    return spark.read.schema(schema).json(paths).na.drop("all")


def write_jsonl(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, in one folder for each value of ``by``."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def file_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, sha256) of files, each hashed where it is read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _ranged(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """``rows`` dealt by ranges of (by, order) and written, with _place (rising in that order) and _task (its range)."""
    sorted_rows = rows.repartitionByRange(by, order).sortWithinPartitions(by, order)
    return staged(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), name).withColumn("_task", F.shiftright("_place", 33))


def _shifted(ranged: DataFrame, by: str, what: Column, none: Column) -> DataFrame:
    """``ranged`` with _first, the least place of its group in its range, and _before, the sum of ``what`` over the ranges before.

    Only one row a group and range is summed up in order, however many rows a group has.
    """
    spans = ranged.groupBy(by, "_task").agg(F.min("_place").alias("_first"), what.alias("_what"))
    earlier = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col(by).alias("_by"), F.col("_task").alias("_of"), "_first", F.coalesce(F.sum("_what").over(earlier), none).alias("_before"))
    return ranged.join(spans, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_task") == F.col("_of")))


def running_ids(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... within each ``by`` in the order of ``order``, whatever its type and gaps.

    Rows are dealt by ranges of near equal size, so a group is never sorted in one task.
    """
    shifted = _shifted(_ranged(rows, by, order, "running-ids"), by, F.count("*"), F.lit(0))
    return shifted.withColumn(name, F.col("_place") - F.col("_first") + F.col("_before")).select(*rows.columns, name)


def running_sums(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (null: 0) over the rows of ``by`` up to this one in the order of the unique
    ``order``, summed within ranges and shifted by the ranges before, as in :func:`running_ids`."""
    known = F.coalesce(F.col(value), F.lit(0.0))
    ranged = _ranged(rows, by, order, "running-sums")
    ranged = ranged.withColumn("_sum", F.sum(known).over(Window.partitionBy("_task", by).orderBy("_place")))
    shifted = _shifted(ranged, by, F.sum(known), F.lit(0.0))
    return shifted.withColumn(name, F.col("_sum") + F.col("_before")).select(*rows.columns, name)


def article(xml: Column) -> Column:
    """struct(pmid, title, abstract, authors, pubtypes, langs, year) of one article's XML.

    Sections of the abstract that have a label start with it; the year is the first four digits found in the issue's year,
    its free date or the completion date.  What is missing is empty or null; XML that can't be read gives an error.
    """
    texts = lambda path: F.xpath(xml, F.lit(path + "/text()"))
    sections = F.zip_with(F.xpath(xml, F.lit("//AbstractText/@Label")), texts("//AbstractText[@Label]"), lambda a, b: F.concat(a, F.lit(": "), b))
    year = F.array_compact(F.transform(F.flatten(F.array(*[texts(p) for p in ("//PubDate/Year", "//PubDate/MedlineDate", "//DateCompleted/Year")])), lambda y: F.nullif(F.regexp_extract(y, r"\d{4}", 0), F.lit(""))))
    return F.struct(
        F.nullif(F.xpath_string(xml, F.lit("//PMID")), F.lit("")).alias("pmid"),
        F.xpath_string(xml, F.lit("//ArticleTitle")).alias("title"),
        F.array_join(F.concat(sections, texts("//AbstractText[not(@Label)]")), "\n").alias("abstract"),
        F.size(F.xpath(xml, F.lit("//Author/LastName/text()"))).alias("authors"),
        texts("//PublicationType").alias("pubtypes"),
        texts("//Language").alias("langs"),
        F.try_element_at(year, F.lit(1)).cast("int").alias("year"),
    )


def log_requests(lines: DataFrame) -> DataFrame:
    """(request, prompt_tokens, received, finished) of an engine log's lines (line_no, line).

    A physical line may hold several segments divided by carriage returns; two kinds of event, received and finished,
    meet by the request's id.  A request without an end has a null ``finished``.
    """
    segments = lines.select("line_no", F.explode(F.split("line", "\r")).alias("s"))
    take = lambda pattern: F.nullif(F.regexp_extract("s", pattern, 1), F.lit(""))
    events = segments.select("line_no", F.coalesce(take(r"Received request (\w+)"), take(r"Finished request (\w+)")).alias("request"), take(r"tokens=(\d+)").cast("int").alias("tokens"), F.col("s").contains("Received").alias("begins"))
    at = lambda begins: F.min(F.when(F.col("begins") == begins, F.col("line_no")))
    return events.where("request IS NOT NULL").groupBy("request").agg(F.max("tokens").alias("prompt_tokens"), at(True).alias("received"), at(False).alias("finished"))


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; undefined values are a dash.  More than ``limit`` rows are refused."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report table has at most {limit} rows")
    shown = lambda x: "—" if x is None or x != x else f"{x:.3f}" if isinstance(x, float) else str(x)
    lines = [rows.columns, ["---"] * len(rows.columns), *[[shown(x) for x in r] for r in found]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def replace_section(document: str, name: str, body: str) -> str:
    """``document`` with new text between ``<!-- AUTO:name -->`` and ``<!-- /AUTO:name -->``; the rest stays.  Doing it again
    changes nothing.  A document without the section is an error."""
    pattern = re.compile(rf"(<!-- AUTO:{re.escape(name)} -->).*?(<!-- /AUTO:{re.escape(name)} -->)", re.S)
    if not pattern.search(document):
        raise ValueError(f"no section {name}")
    return pattern.sub(lambda m: f"{m[1]}\n{body}\n{m[2]}", document)


def redacted(values: Column) -> Column:
    """A map of strings with the values of telling keys replaced."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(f"(?i){TELLING.pattern}"), F.lit(HIDDEN)).otherwise(v))
