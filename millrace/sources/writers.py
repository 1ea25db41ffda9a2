"""Writers: replace, upsert, append, JSON lines, reports of an evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.monitor import merge_by_key


def replace(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Full replacement of a Parquet table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add rows; a partitioned table takes the columns it was written with, or readers would not see the new files."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert(new: DataFrame, path: str, keys: list[str], version: str) -> None:
    """Merge rows into a Parquet table by key, latest version wins; a table that is not there is made.

    The merged table is written beside the old one and takes its place by two
    renames, so a job that is lost leaves one of them whole.
    """
    spark = new.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path(path)):
        merge_by_key(new.limit(0), new, keys, version).write.parquet(path)
        return
    own, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    merge_by_key(spark.read.parquet(path), new, keys, version).write.parquet(own)
    fs.delete(jvm_path(old), True)
    fs.rename(jvm_path(path), jvm_path(old))
    fs.rename(jvm_path(own), jvm_path(path))
    fs.delete(jvm_path(old), True)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot_json(metrics: DataFrame, path: str) -> None:
    """Companies and metrics back in one document."""
    by_company = metrics.groupBy("as_of_year", "previous_year", "ticker", "name").agg(F.collect_list(F.struct(*[c for c in metrics.columns if c not in ("as_of_year", "previous_year", "ticker", "name")])).alias("metrics"))
    doc = by_company.groupBy("as_of_year", "previous_year").agg(F.map_from_entries(F.collect_list(F.struct("ticker", F.struct("name", "metrics")))).alias("companies"))
    doc.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def evaluation_report(results: DataFrame, summary: DataFrame, folder: str) -> None:
    """Summary, details and errors as three tables."""
    replace(summary, f"{folder}/summary")
    replace(results.where("error is null"), f"{folder}/details")
    replace(results.where("error is not null").select("id", "category", "error"), f"{folder}/errors")


def markdown_report(df: DataFrame, path: str, title: str) -> None:
    """Rows of (section, text) as one Markdown text, in the order given by ``position``."""
    parts = df.agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.col("text")).alias("s")))).alias("p"))
    parts.select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("p", lambda x: x["s"]), "\n\n")).alias("value")).write.mode("overwrite").text(path)


def chart_is_valid(categories, values):
    """Whether a chart has a value for each category."""
    return F.size(categories) == F.size(values)


def debug_dump(df: DataFrame, path: str, line, enabled: bool = False) -> None:
    """Rows as text by report, for reading; does nothing unless enabled. ``line`` is a column of text."""
    if enabled:
        df.select("report_id", line.alias("value")).write.mode("overwrite").partitionBy("report_id").text(path)


def copy_tables(spark, source: str, target: str, names: list[str]) -> dict[str, int]:
    """Replace the tables under ``target`` by those under ``source``; the copied rows are counted on both sides."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{source}/{name}")
        replace(df, f"{target}/{name}")
        out[name] = spark.read.parquet(f"{target}/{name}").count()
        if out[name] != df.count():
            raise ValueError(f"{name}: rows were lost on the way")
    return out


def generated_file(folder: str, name: str) -> str:
    """The path of a generated file; a name that leads out of the folder is refused."""
    if not name or name in (".", "..") or "/" in name or "\\" in name:
        raise ValueError("Invalid filename.")
    return f"{folder.rstrip('/')}/{name}"
