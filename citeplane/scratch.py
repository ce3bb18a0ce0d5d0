"""Written intermediate tables: lineage and plans end there, and any executor may be lost."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder of the cluster, ``spark.checkpoint.dir``; a temporary one in local mode, where all share a machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="citeplane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Columns have other names on disk, so that names which clash but for case, or hold odd signs, survive.
    """
    spark, names = df.sparkSession, df.columns
    path = f"{root(spark)}/citeplane-{uuid.uuid4().hex}"
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    plain.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(plain.schema).parquet(path).toDF(*names)


def drop(keep: int = 0) -> None:
    """Delete what ``materialize`` has written, but for the first ``keep`` tables; all of it when the driver ends."""
    while len(_WRITTEN) > keep:
        spark, path = _WRITTEN.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already  # noqa: BLE001
            return


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables that are written inside go at the end: use or write the result inside as well."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        drop(before)


atexit.register(drop)
