"""What a Spark session needs before this package's Python code can run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch unless the session sets its own: documents are long, and a batch is held several times over.
BATCH_ROWS = 1000
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch, unless the session sets fewer.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, so that it needs no installation there."""
    if spark.conf.get(_BATCH) == "10000":  # Spark's default
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.get(_BYTES) == "67108864b":  # Spark's default
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="citeplane-"), "citeplane.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
    return spark


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over enough tasks for all cores: rows that take long in Python may be few bytes, and a small file is one task.

    The number is given, so that tasks aren't put together again for being small. Rows equal in ``by`` stay together.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *by)
