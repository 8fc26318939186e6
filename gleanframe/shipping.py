"""Sending this package to the workers of a session that don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession


@lru_cache(maxsize=None)
def _archive() -> str:
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="gleanframe-")) / "gleanframe.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    return str(path)


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's workers, once for each application."""
    if spark.sparkContext.applicationId not in _sent:
        spark.sparkContext.addPyFile(_archive())
        _sent.add(spark.sparkContext.applicationId)
