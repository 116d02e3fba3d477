"""Sending this package to Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(prefix="studyloom-ship-"), "studyloom_package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(at)
    _sent.add(app)


def shipped(query):  # noqa: ANN001, ANN201
    """query, with the package sent to the workers before it runs."""

    @wraps(query)
    def run(spark: SparkSession, at: str) -> DataFrame:
        ship(spark)
        return query(spark, at)

    return run
