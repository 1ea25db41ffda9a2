"""Year-on-year growth snapshots: long metrics in, current and previous year side by side out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import growth, money, signed_percent


def with_growth(metrics: DataFrame) -> DataFrame:
    """Adds growth and display columns to rows of current, previous and unit.

    The texts round half up on the decimal form, as the JVM does.
    """
    g = growth(F.col("current"), F.col("previous"))
    return metrics.withColumns({
        "growth_percent": g, "growth_display": signed_percent(g), "display_value": money(F.col("current"), F.col("unit")), "previous_display_value": money(F.col("previous"), F.col("unit")),
    })


def year_on_year(series: DataFrame, keys: list[str], year: str = "year", value: str = "value") -> DataFrame:
    """Each year with the one before it in its series; the first has no previous."""
    w = Window.partitionBy(*keys).orderBy(year)
    return series.select(*keys, year, F.col(value).alias("current"), F.lag(value).over(w).alias("previous")).withColumn("growth_percent", growth(F.col("current"), F.col("previous")))


def flatten_snapshot(source: DataFrame) -> DataFrame:
    """One row a company and metric from a snapshot document (companies: map to name and metrics)."""
    by_company = source.select("as_of_year", "previous_year", F.explode("companies").alias("ticker", "c"))
    return by_company.select("as_of_year", "previous_year", "ticker", F.col("c.name").alias("name"), F.explode("c.metrics").alias("m")).select("as_of_year", "previous_year", "ticker", "name", "m.*")


SNAPSHOT = (
    "as_of_year int, previous_year int, companies map<string, struct<name: string, metrics: array<struct<label: string, current: double, previous: double, unit: string, "
    "change_mode: string, source: string, source_page: int>>>>"
)
