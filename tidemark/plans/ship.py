"""The package on the executors: a zip that Spark hands out, where workers wouldn't find the package by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_done: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once for each application, and only where neither PYTHONPATH nor the working folder holds the package."""
    known = [Path(p or ".").resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), ".")]
    context = spark.sparkContext
    if ROOT in known or any((p / "tidemark").exists() for p in known) or context.applicationId in _done:
        return
    target = Path(tempfile.mkdtemp(prefix="package-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for file in sorted((ROOT / "tidemark").rglob("*.py")):
            packed.write(file, file.relative_to(ROOT))
    context.addPyFile(str(target))
    _done.add(context.applicationId)
