"""What changed between the files there are and the manifest of those indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """file_path, status (new, changed, unchanged, deleted), sha256 of the file there is."""
    new = files.select("file_path", F.col("sha256").alias("now"))
    old = manifest.select("file_path", F.col("sha256").alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return new.join(old, "file_path", "full").select("file_path", status.alias("status"), F.col("now").alias("sha256"))


def counts(changes: DataFrame) -> DataFrame:
    """One row: files of each status."""
    return changes.agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "changed", "unchanged", "deleted")))


def manifest_of(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The manifest of indexed files: their hash and chunks, and the time."""
    ids = chunks.groupBy("file_path").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    return files.select("file_path", "sha256").join(ids, "file_path", "left").select("file_path", "sha256", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), F.coalesce(F.size("chunk_ids"), F.lit(0)).alias("chunk_count"), F.current_timestamp().alias("indexed_at"))


def status(manifest: DataFrame) -> DataFrame:
    """One row: n_files, n_chunks (chunk_count, or the number of chunk_ids), last_indexed."""
    return manifest.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.coalesce("chunk_count", F.size("chunk_ids"))), F.lit(0)).cast("long").alias("n_chunks"), F.max("indexed_at").alias("last_indexed"))


def undescribed(rows: DataFrame, described: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key has no description yet."""
    return rows.join(described.select(key), key, "left_anti")
