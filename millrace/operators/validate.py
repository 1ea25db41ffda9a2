"""Checks that fail a job, and report years read from opening pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import question_form

# Where a report names its year, in order of trust.
YEAR_PATTERNS = (
    r"annual report(?: and accounts)?\s+(20\d{2})", r"annual report\s+for\s+(20\d{2})", r"integrated annual report\s+(20\d{2})", r"integrated report\s+(20\d{2})",
    r"for the year ended[^0-9]{0,60}(20\d{2})", r"financial year[^0-9]{0,20}(20\d{2})", r"year ended[^0-9]{0,40}(20\d{2})",
)
YEARS, LEAST_MENTIONS = (2023, 2024, 2025), 3


class ValidationError(ValueError):
    """A table that a job may not go on with."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValidationError(f"no {what}")
    return df


def check_index(docs: DataFrame) -> dict:
    """Counts of the index; an index without rows or with a document that lacks its embedding fails."""
    row = docs.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("embedding").isNull()).alias("missing"),
        F.count_if(F.col("content_type") == "narrative").alias("narratives"), F.count_if(F.col("content_type") == "table").alias("tables"),
    ).first().asDict()
    if not row["documents"] or row["missing"]:
        raise ValidationError(f"{row['missing']} of {row['documents']} documents have no embedding")
    return row


def report_year(text: Column) -> Column:
    """The year a report is for: the first pattern that fits, else the year named most, at least three times; null if neither."""
    t = question_form(text)
    named = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in YEAR_PATTERNS]
    counts = F.array(*(F.struct(F.regexp_count(t, F.lit(rf"\b{y}\b")).alias("n"), F.lit(-y).alias("y")) for y in YEARS))
    best = F.array_max(counts)
    return F.coalesce(*(x.cast("int") for x in named), F.when(best["n"] >= LEAST_MENTIONS, -best["y"]))


def year_status(found: Column, expected: Column) -> Column:
    """A mismatch rejects; an unknown year only warns."""
    return F.when(found.isNull(), "unknown").when(found == expected, "ok").otherwise("mismatch")


def valid_scores(payload: Column, metrics: tuple[str, ...] = ("correctness", "faithfulness", "relevance")) -> Column:
    """Struct (valid, one score a metric) of a judge's JSON: every metric an object with score in [0, 1] and a reason."""
    kind = "struct<" + ",".join(f"{m}:struct<score:double,reason:string>" for m in metrics) + ">"
    parsed = F.from_json(payload, kind)
    ok = F.lit(True)
    for m in metrics:
        ok = ok & parsed[m]["score"].between(0, 1) & parsed[m]["reason"].isNotNull()
    return F.struct(F.coalesce(ok, F.lit(False)).alias("valid"), *(parsed[m]["score"].alias(m) for m in metrics))
