"""Python workers find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reach(spark: SparkSession) -> None:
    """Adds the package's folder to the path of Python workers on this machine, unless PYTHONPATH names it. A cluster gets the package by --py-files."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in [*paths, *os.environ.get("PYTHONPATH", "").split(os.pathsep)]:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
