"""Sends this package to the executors, which may not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the application; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="millrace-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(name))
    _shipped[app] = str(name)
