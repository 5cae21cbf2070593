"""Brings this package to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Python workers can import the package from now on, wherever they run; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _DONE:
        name = os.path.join(tempfile.mkdtemp(prefix="package-"), "siftstone_package.zip")
        with zipfile.ZipFile(name, "w") as z:
            for folder, _, files in os.walk(_PACKAGE):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
        sc.addPyFile(name)
        _DONE.add(sc.applicationId)
    return spark
