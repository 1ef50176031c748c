"""Make this package importable on the executors, wherever the driver was started."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application. Python workers don't see the driver's ``sys.path``."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # not when the package itself was shipped as an archive
        path = os.path.join(tempfile.mkdtemp(prefix="tidelog-ship-"), "tidelog.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)  # Spark serves it to every executor, also to later ones
    _shipped.add(app)


def travel_by_value(*modules: str) -> None:
    """Data sources and stateful processors are set up in workers that don't see shipped packages: their code goes along."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])
