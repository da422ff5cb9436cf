"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch: texts can be long, so workers get fewer at a time than Spark's default.
BATCH_ROWS = "1024"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once per application, and bound their batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        file = os.path.join(tempfile.mkdtemp(prefix="casewell-"), "casewell.zip")
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        spark.sparkContext.addPyFile(file)
        _shipped.add(app)
    return spark
