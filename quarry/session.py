"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Arrow batches between the JVM and Python hold so many bytes at most, else what a worker holds would go by the length of rows.
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once per application; Spark's own file server
    hands them out, so nothing has to be installed there."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="quarry-src-")) / "quarry-src.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)
    return spark
