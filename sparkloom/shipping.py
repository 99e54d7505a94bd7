"""Sends this package to the executors, whose Python workers do not have the repository on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession | None = None) -> None:
    """Once per application, before the first function that runs in Python."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_loom_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="loom-"))
    path = os.path.join(folder, f"{PACKAGE.name}_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in PACKAGE.rglob("*.py"):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._loom_shipped = True
