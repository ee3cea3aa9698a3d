"""Folders for stores that live as long as the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from tidelog.model import InvalidArgument


def folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster shares, or, on a local master only,
    on this machine where none is set; removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise InvalidArgument("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
