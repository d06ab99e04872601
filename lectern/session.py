"""Gives the workers of a session this package, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_given: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, once a Spark application; the driver serves the file to them."""
    application = spark.sparkContext.applicationId
    if application in _given:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if package.endswith(".zip/lectern") or not os.path.isdir(package):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lectern-code-"), "lectern.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("lectern", os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(target)
    _given.add(application)
