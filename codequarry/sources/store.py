"""Chunk store over Parquet, dealt to buckets by file.

A change rewrites the buckets that it touches and no others: their new rows are
staged beside the table, then put in place by a dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions.scalars import similarity


#: Rows of a bucket's file, about.
FILE_ROWS = 1_000_000


class Store(Protocol):
    """What the engine asks of a store of chunks."""

    def read(self) -> DataFrame: ...
    def upsert(self, rows: DataFrame) -> None: ...
    def delete(self, keys: DataFrame, by: str | None = None) -> None: ...
    def clear(self) -> None: ...
    def count(self) -> int: ...
    def get_by_id(self, key: str) -> DataFrame: ...
    def get_many(self, keys: DataFrame) -> DataFrame: ...
    def file_chunk_ids(self, file_path: str) -> DataFrame: ...
    def query(self, vector: list[float], k: int, where: dict | None = None, digits: int | None = None) -> DataFrame: ...


class ChunkStore:
    """Rows with a key column, kept under ``path``; ``schema`` is a DDL string. metric: cosine or l2."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "chunk_id", deal_by: str = "file_path", buckets: int = 64, metric: str = "cosine") -> None:
        self.spark, self.path, self.key, self.deal_by, self.buckets, self.metric = spark, path, key, deal_by, buckets, metric
        self.schema = spark.createDataFrame([], schema).schema
        if metric not in ("cosine", "l2"):
            raise ValueError(f"unknown metric {metric!r}")

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.deal_by), F.lit(self.buckets)).cast("int").alias("bucket")

    def _all(self) -> DataFrame:
        kind = self.spark.createDataFrame([], self.schema).schema.add("bucket", "integer")
        return self.spark.read.schema(kind).parquet(self.path) if self._exists() else self.spark.createDataFrame([], kind)

    def read(self) -> DataFrame:
        return self._all().select(*self.schema.fieldNames())

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        """Put ``rows`` in place of the touched buckets. A bucket left without rows is removed, as an overwrite by no rows would leave it."""
        staged = scratch.stored(rows.select(*self.schema.fieldNames(), self._bucket()), f"{scratch.folder(self.spark)}/staged")
        left = {r["bucket"]: r["n"] for r in staged.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # ``buckets`` at most
        files = max(1, -(-max(left.values(), default=0) // FILE_ROWS))
        place = F.pmod(F.xxhash64(self.key), F.lit(files))  # a large bucket has several files, each of a task of its own
        staged.repartition(max(1, len(left) * files), "bucket", place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in set(touched) - set(left):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["bucket"] for r in rows.select(self._bucket()).distinct().collect()]  # ``buckets`` at most

    def upsert(self, rows: DataFrame) -> None:
        """Insert rows, replacing those of the same key and dealing column. Of rows given twice one stays."""
        rows = scratch.stored(rows.select(*self.schema.fieldNames()).dropDuplicates([self.key]), f"{scratch.folder(self.spark)}/new")
        if touched := self._touched(rows):
            old = self._all().filter(F.col("bucket").isin(touched)).join(rows.select(self.key), self.key, "left_anti")
            self._replace(old.select(*self.schema.fieldNames()).unionByName(rows), touched)

    def delete(self, keys: DataFrame, by: str | None = None) -> None:
        """Delete the rows whose key (or column ``by``) is among keys."""
        by = by or self.key
        keys = keys.select(by).distinct()
        hit = self._all().join(keys, by, "left_semi")
        if touched := [r["bucket"] for r in hit.select("bucket").distinct().collect()]:
            self._replace(self._all().filter(F.col("bucket").isin(touched)).join(keys, by, "left_anti"), touched)

    def clear(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def count(self) -> int:
        return self._all().count()

    def get_by_id(self, key: str) -> DataFrame:
        return self.read().filter(F.col(self.key) == key)

    def get_many(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys.select(self.key).distinct(), self.key, "left_semi")

    def file_chunk_ids(self, file_path: str) -> DataFrame:
        return self._all().filter((F.col("bucket") == F.pmod(F.xxhash64(F.lit(file_path)), F.lit(self.buckets)).cast("int")) & (F.col(self.deal_by) == file_path)).select(self.key)

    def query(self, vector: list[float], k: int, where: dict | None = None, digits: int | None = None) -> DataFrame:
        """The k rows nearest to vector with their score, best first, ties by key; ``where`` holds equalities tested before, ``digits`` rounds scores before they are ranked."""
        rows = self.read()
        for name, value in (where or {}).items():
            rows = rows.filter(F.col(name) == value)
        score = similarity(F.col("embedding"), F.array(*map(F.lit, map(float, vector))), self.metric)
        return rows.withColumn("score", F.round(score, digits) if digits is not None else score).orderBy(F.desc("score"), self.key).limit(k)


def ephemeral(spark: SparkSession, schema: str, **options) -> ChunkStore:
    """An empty store in a new scratch folder, for what needn't outlive the session's scratch space."""
    return ChunkStore(spark, f"{scratch.folder(spark)}/store", schema, **options)


#: Stores by the name of their kind; each takes (spark, path, schema, **options).
BACKENDS: dict[str, Callable[..., Store]] = {"parquet": ChunkStore, "ephemeral": lambda spark, path, schema, **options: ephemeral(spark, schema, **options)}


def open_store(kind: str, spark: SparkSession, path: str, schema: str, **options) -> Store:
    """A store of a kind of ``BACKENDS``; ValueError for others."""
    if kind.lower() not in BACKENDS:
        raise ValueError(f"unknown store {kind!r}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[kind.lower()](spark, path, schema, **options)
