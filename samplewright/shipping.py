"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application as a zip, once per application.

    Clusters that install the package, or name it in ``--py-files``, need not call this.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped_to:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # The driver's own copy; Spark hands it to the executors.
    target = os.path.join(tempfile.mkdtemp(prefix="samplewright-"), "samplewright.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _shipped_to.add(context.applicationId)
