"""Readers: files as reports, JSON lines, snapshots, generated series, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import report_id
from ..operators.growth import SNAPSHOT
from ..operators.validate import require_rows
from . import schemas

EXAMPLE = "id string, question string, reference_answer string, gold_source_ids array<string>, ticker string, report_year int, category string, expected_tools array<string>, metadata map<string, string>"


def manifest(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The reports to hold: company, ticker, report_year, filename, url, validate_year. A file named twice is an error."""
    df = spark.createDataFrame(rows, schemas.MANIFEST)
    names = [(r[1], r[2], r[3]) for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a report is in the manifest twice")
    return df


def missing_reports(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Reports of the manifest without a valid file: what is left to fetch."""
    return wanted.join(files.where("valid").select("ticker", "report_year", "filename"), ["ticker", "report_year", "filename"], "left_anti")


def ordered_reports(reports: DataFrame) -> DataFrame:
    """Reports by ticker, year and file name; an empty table or a row without a file is an error."""
    require_rows(reports, "reports")
    if not reports.where(F.coalesce("file_path", F.lit("")) == "").isEmpty():
        raise ValueError("a report has no file")
    return reports.orderBy("ticker", "report_year", "filename")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Text blocks with their boxes and fonts, from JSON lines that a PDF reader leaves; a malformed line fails the read."""
    return spark.read.schema(schemas.BLOCKS).option("mode", "FAILFAST").json(path)


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """Detected tables with their boxes and cells, from JSON lines."""
    return spark.read.schema(schemas.MATRICES).option("mode", "FAILFAST").json(path)


def report_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", magic: str = "%PDF") -> DataFrame:
    """One row a file under ``folder/<ticker>/<year>/``: id, size, digest, and whether the content begins as it should.

    Contents are read by the executors; files that are not what they claim stay
    as rows with ``valid`` false. A folder without files is an error.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    ticker, year = F.regexp_extract("path", r"/([^/]+)/\d{4}/[^/]+$", 1), F.regexp_extract("path", r"/(\d{4})/[^/]+$", 1).try_cast("int")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    require_rows(f.select("path"), f"files like {pattern}")
    head = F.regexp_replace(F.decode(F.expr("substring(content, 1, 64)"), "ISO-8859-1"), r"^\s+", "")
    return f.select(
        report_id(ticker, year, F.regexp_replace(name, r"\.[^.]+$", "")).alias("report_id"), ticker.alias("ticker"), year.alias("report_year"), name.alias("filename"), F.col("path").alias("file_path"),
        F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"), head.startswith(magic).alias("valid"), F.lit("downloaded").alias("processing_status"),
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """Counts of page texts: report_id, page_number, text in; character_count and has_text added."""
    return pages.withColumns({"character_count": F.length(F.coalesce("text", F.lit(""))), "has_text": F.trim(F.coalesce("text", F.lit(""))) != ""})


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation examples from JSON lines; empty lines are skipped, a malformed one fails the read."""
    return spark.read.schema(EXAMPLE).option("mode", "FAILFAST").json(path)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A growth snapshot: one JSON document."""
    return spark.read.schema(SNAPSHOT).option("multiLine", "true").json(path)


def flashcards(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects."""
    return spark.read.option("multiLine", "true").json(path)


def hour_series(spark: SparkSession, start, end) -> DataFrame:
    bound = lambda t: F.date_trunc("hour", F.lit(t)).cast("timestamp_ntz")
    return spark.range(1).select(F.explode(F.sequence(bound(start), bound(end), F.expr("interval 1 hour"))).alias("time"))


def synthetic_questions(spark: SparkSession, n: int, questions: list[str], seed: int = 42) -> DataFrame:
    """``n`` requests over fixed questions, pipelines mixed, the same for the same seed."""
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(questions)))
    return spark.range(n).select("id", F.element_at(F.array(*map(F.lit, questions)), (pick + 1).cast("int")).alias("question"), F.when(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2)) == 0, "rag").otherwise("agent").alias("pipeline"))


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1").first()[0] == 1
