"""Makes the package importable on the executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once an application; not if PYTHONPATH has its folder, which executors inherit."""
    context = spark.sparkContext
    if context.applicationId in _SENT or str(ROOT.parent) in map(os.path.realpath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    path = Path(tempfile.mkdtemp(prefix="tidesmith-")) / "tidesmith.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(str(path))
    _SENT.add(context.applicationId)


def shipped(query):
    """A query or stage that sees to it that executors have the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, *more):
        ship(spark)
        return query(spark, *more)

    return run
