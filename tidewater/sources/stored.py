"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, one folder for the application on a single machine, and an
    error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: its lineage ends, and lost executors do not lose it."""
    path, schema = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}", frame.schema
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(schema).parquet(path)
