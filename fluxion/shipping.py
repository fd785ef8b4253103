"""Sends this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application: adds the package as a zip file that every executor fetches from the driver."""
    key = spark.sparkContext.applicationId
    if key not in _sent:
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="fluxion-")) / "fluxion.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("fluxion") / p.relative_to(root))
        spark.sparkContext.addPyFile(str(to))
        _sent.add(key)
    return spark
