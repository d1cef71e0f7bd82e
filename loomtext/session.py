"""What a session needs before queries run: the package on the executors, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession, arrow_rows: int = 1000, arrow_bytes: str = "8m") -> None:
    """Ships this package to the executors as a zip file, once for each application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    # Long texts make batches of fewer rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", arrow_bytes)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).parent
    out = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)
