"""Sends this package to the executors, wherever the driver imported it from."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import spectrail

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package's source as a zip file, through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(spectrail.__file__).parent
    # Spark's file server on the driver reads it until the application ends.
    folder = tempfile.mkdtemp(prefix="spectrail-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "spectrail.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)
