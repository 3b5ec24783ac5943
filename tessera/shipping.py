"""Getting this package to Python workers that can't import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Hand this package's source to the executors, once a context; nothing without a session."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # The driver serves the file for as long as it lives.
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tessera-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/tessera.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._tessera_shipped = True
