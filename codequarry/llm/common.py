"""Shared plumbing: scratch tables in the folder all executors see, and joins sized by a count."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (local tests) under a temporary folder, which is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = tempfile.mkdtemp(prefix="codequarry-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/codequarry-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, size: str = "2m", rows: int = 512) -> None:
    """Arrow batches of ``size`` and Parquet batches of ``rows`` at most, where the session was not given limits of its own: the defaults of 64 MB and 4,096 rows are much memory where a row is a whole text."""
    for name, value in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.parquet.columnarReaderBatchSize", str(rows))):
        if name not in spark.conf.getAll:
            spark.conf.set(name, value)


def stored(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Write a table and read it again, which cuts its lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all of ``columns``."""
    taken = {c.lower() for c in columns}
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def byte_size(df: DataFrame) -> int:
    """Bytes of a table's values: strings and binaries by their length, 8 for any other, 16 more for each row."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for name, kind in df.dtypes), F.lit(16))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", most: int = 48 << 20, salts: int = 32, salt: Column | None = None) -> DataFrame:
    """Join a large, perhaps skewed left side with a stored right side that is unique in ``on``.

    A right side of up to ``most`` bytes is broadcast. Beyond, both are dealt by
    the key and a salt (the right side once for each salt), so that one hot key
    of the left side is spread over ``salts`` tasks.
    """
    if byte_size(right) <= most:
        return left.join(F.broadcast(right), on, how)
    name = free_name([*left.columns, *right.columns], "_salt")
    left = left.withColumn(name, F.pmod(F.xxhash64(salt if salt is not None else F.struct(*left.columns)), F.lit(salts)).cast("int"))
    right = right.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, name], how).drop(name)
