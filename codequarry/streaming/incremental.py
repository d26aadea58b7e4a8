"""Index changes as they arrive on a stream of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental
from ..operators.parsing import parse_files


def latest(batch: DataFrame, version: str = "version") -> DataFrame:
    """The newest version of each file of a batch; of equal versions the greatest hash."""
    return batch.groupBy("file_path").agg(F.max_by(F.struct("language", "content", "sha256"), F.struct(version, "sha256")).alias("x")).select("file_path", "x.*")


def apply_batch(engine, batch: DataFrame, version: str = "version") -> None:
    """Bring the engine's store up to a batch of file versions (file_path, language, content, version); null content deletes the file. A batch applied twice changes nothing the second time."""
    rows = latest(batch.withColumn("sha256", F.sha2("content", 256)), version)
    changes = incremental.diff(rows.filter("content is not null").select("file_path", "sha256"), engine.manifest.get_many(rows.select("file_path")))
    todo = rows.join(changes.filter("status in ('new', 'changed')").select("file_path"), "file_path", "left_semi")
    chunks = engine.enrich(parse_files(todo, engine.settings.chunk_max_tokens, engine.settings.chunk_overlap_tokens).filter("error is null").dropDuplicates(["chunk_id"]))
    gone = changes.filter("status in ('changed', 'deleted')").select("file_path")
    from .. import scratch

    work = scratch.folder(batch.sparkSession)
    todo, chunks, gone = (scratch.stored(df, f"{work}/{k}") for k, df in enumerate((todo, chunks, gone)))
    engine.store.delete(gone, by="file_path")
    engine.store.upsert(chunks)
    engine.manifest.delete(gone)
    engine.manifest.upsert(incremental.manifest_of(todo, chunks))


def index_stream(engine, versions: DataFrame, checkpoint: str, version: str = "version", **trigger) -> StreamingQuery:
    """Start a stream that applies every micro-batch of file versions to the engine's store."""
    return versions.writeStream.foreachBatch(lambda batch, _: apply_batch(engine, batch, version)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
