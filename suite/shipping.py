"""Give the Python workers the package when they cannot import it themselves."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PACKAGES = ("pairwell",)
_NAME = "pairwell-src.zip"


def archive(root: str) -> bytes:
    """The library's sources as a zip."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for package in PACKAGES:
            for folder, _, files in os.walk(os.path.join(root, package)):
                for name in sorted(f for f in files if f.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    return out.getvalue()


def ship(spark: SparkSession, root: str) -> None:
    """Send the sources with every later task, once per Spark context.

    The zip lies on the driver, which serves it; executors need no shared path.
    """
    context = spark.sparkContext
    if any(f.endswith(_NAME) for f in getattr(context, "_python_includes", [])):
        return
    folder = tempfile.mkdtemp(prefix="pairwell-ship-")
    path = os.path.join(folder, _NAME)
    with open(path, "wb") as f:
        f.write(archive(root))
    context.addPyFile(path)


def with_package(query: Callable[[SparkSession, str], DataFrame], root: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark, root)
        return query(spark, sf_dir)

    return run
