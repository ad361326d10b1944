"""Brings this package to the Python workers, wherever the session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    Functions of this package are pickled by name, so workers have to import it. The
    archive is served by the driver; nothing needs a shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    name = os.path.basename(_PACKAGE)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(_PACKAGE):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
