"""Sends this package to Python workers, so that executors need no installation of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the application's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp()).resolve() / f"{root.name}.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(at))
        _shipped.add(app)
    return spark
