"""Getting this package to executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to all executors through Spark, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_mapweave_shipped", False):
        return
    top = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(suffix=".zip", prefix="mapweave-", delete=False) as file, zipfile.ZipFile(file, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    context.addPyFile(file.name)
    context._mapweave_shipped = True
