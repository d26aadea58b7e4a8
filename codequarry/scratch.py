"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, as in local tests, under a temporary folder, which is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = tempfile.mkdtemp(prefix="codequarry-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/codequarry-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Written and read again: lineage is cut and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
