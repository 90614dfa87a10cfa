"""Sending this package to executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", None) is None:
        package = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(), "tessera.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"{package.name}/{f.relative_to(package)}")
        sc.addPyFile(path)
        sc._tessera_shipped = path
