"""Sends this package to the executors when they could not import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def _within_reach() -> bool:
    """Do workers that start with the driver's folder and PYTHONPATH find the package?"""
    places = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    return any(Path(p).resolve() == _PACKAGE.parent for p in places)


def ship(spark: SparkSession) -> None:
    """Add the package's source to the session once, unless it is within reach or installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped or _within_reach() or "site-packages" in _PACKAGE.parts:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="crowdlake-ship-"), "crowdlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with the package sent along first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
