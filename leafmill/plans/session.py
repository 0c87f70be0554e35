"""Making the package importable where the work runs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to executors, unless their Python path already holds it."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if app in _shipped or str(root) in on_path:
        return
    target = Path(tempfile.mkdtemp()) / "leafmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (root / "leafmill").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
