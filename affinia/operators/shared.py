"""Tables that a job writes to the folder which driver and executors share, to cut its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's own folder; a temporary folder only on a local master where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local[app] = _local.get(app) or "file://" + tempfile.mkdtemp(prefix="affinia-")
    return f"{at.rstrip('/')}/affinia/{app}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
