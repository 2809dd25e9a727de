"""Sends the package to Spark's Python workers where they wouldn't find it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's files, once, unless the workers inherit a path to it."""
    paths = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd()}
    app = spark.sparkContext.applicationId
    if ROOT.resolve() in paths or app in _sent:
        return
    folder = tempfile.mkdtemp(prefix="spark-package-")
    shutil.copytree(ROOT / "emberline", f"{folder}/code/emberline", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/emberline", "zip", f"{folder}/code"))
    _sent.add(app)
