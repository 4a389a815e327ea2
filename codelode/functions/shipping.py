"""The package itself as a file that Spark gives to its executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, by Spark's own file service."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(str(f.relative_to(root.parent)), f.read_bytes())
    folder = tempfile.mkdtemp(prefix="codelode-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "codelode.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
