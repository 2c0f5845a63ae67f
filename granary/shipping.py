"""Getting this package to the Python workers: executors need not have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application. The driver serves it to executors as they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # else it runs from such a file already
        folder = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, folder, True)
        name = os.path.join(folder, "granary-package.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
            for at, _, files in os.walk(here):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(at, f)
                        out.write(path, os.path.join("granary", os.path.relpath(path, here)))
        sc.addPyFile(name)
    _shipped.add(sc.applicationId)
