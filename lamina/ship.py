"""Send this package to the executors, so that their Python workers can import it wherever the driver runs."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once. Executors fetch them from the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).parent
    handle, archive = tempfile.mkstemp(prefix="lamina-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, f"{package.name}/{source.relative_to(package)}")
    atexit.register(Path(archive).unlink, missing_ok=True)
    spark.sparkContext.addPyFile(archive)
