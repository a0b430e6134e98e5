"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, unless PYTHONPATH already has it."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    sc._millrace_shipped = True
    if str(PACKAGE.parent) in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="millrace-ship-"), "millrace_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(out)
