"""The package on the executors: a worker must import it wherever the driver found it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_served: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Serve the package's sources to the Python workers of ``spark``, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _served:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="tokensift-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)  # from the driver's file server
    _served.add(context.applicationId)
