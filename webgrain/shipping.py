"""Putting this package on the executors' import path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package's source to all Python workers, once for each Spark context.

    Functions that run in Python workers are pickled by name, so the workers
    must be able to import the package whatever the driver's own path is.
    """
    sc = spark.sparkContext
    if getattr(sc, "_webgrain_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="webgrain-")) / "webgrain.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(_HERE.rglob("*.py")):
            z.write(path, path.relative_to(_HERE.parent))
    sc.addPyFile(str(archive))
    sc._webgrain_shipped = True
