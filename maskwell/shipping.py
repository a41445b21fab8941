"""Getting this package to the executors' Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's source to all Python workers of this application, once.

    Spark's own file server carries it, so nothing has to be installed on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    # Spark's file server reads it from here for as long as the driver lives.
    folder = tempfile.mkdtemp(prefix="maskwell-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "maskwell_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                archive.write(path, Path("maskwell") / path.relative_to(package))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def group_arrow(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """``df.groupBy(keys).applyInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(function, schema)
