"""Sends this package to the executors, whose Python workers import it."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's Python files, once per Spark context.

    Operators that send functions to the workers call this themselves.
    """
    sc = spark.sparkContext
    if getattr(sc, "_sylvaq_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sylvaq-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "sylvaq.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("sylvaq") / f.relative_to(root))
    sc.addPyFile(str(path))
    sc._sylvaq_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` that first makes sure the workers have the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
