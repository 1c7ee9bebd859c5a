"""The library's own code for Python tasks on executors that have no copy of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()  # applications that have the code


def ship(spark: SparkSession) -> None:
    """Send this package to every Python task of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="tillmart-code-")) / "tillmart.zip"  # read by the driver's file server only
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, f"{PACKAGE.name}/{file.relative_to(PACKAGE).as_posix()}")
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
