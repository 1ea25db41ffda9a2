"""Keep-first deduplication.

The first row of each key is found by a minimum that combines before the
shuffle, not by a window over the key's rows, so a key with many copies costs
one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedup_form, question_form


def keep_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """One row for each value of ``keys``: that of the smallest ``order`` columns. Null keys are a value."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    best = df.select(*named, F.struct(*order).alias("__o"), F.struct("*").alias("__r")).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by("__r", "__o").alias("r"))
    return best.select("r.*")


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """First chunk of each report and dedup form, renumbered from 1; chunk ids keep the old number."""
    first = keep_first(chunks, [F.col("report_id"), dedup_form(F.col("text"))], ["chunk_index"])
    return first.withColumn("chunk_index", F.row_number().over(Window.partitionBy("report_id").orderBy("chunk_index")))


def dedup_exact(chunks: DataFrame, order: list[str]) -> DataFrame:
    """First chunk of each report and text digest."""
    return keep_first(chunks, [F.col("report_id"), F.sha2("text", 256)], order)


def dedup_questions(examples: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(examples, [question_form(F.col("question"))], order)
