"""The engine's front: index a tree, ask questions, report status, evaluate."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, scratch
from ..config import Settings
from ..functions import fixed
from ..functions import scalars as S
from ..functions.embedders import embedder
from ..operators import graph, incremental, retrieval
from ..operators.parsing import parse_files
from ..operators.reranking import reranker
from ..sources import files as source_files
from ..sources.repo import resolve
from ..sources.store import ChunkStore, open_store
from . import answers

log = logging.getLogger(__name__)

STORED = schemas.CHUNKS + ", calls array<string>, qualified_name string, node_id string, citation string, summary string, enriched_text string, embedding array<double>"


#: Failures that IndexStats quotes; the table ``failures`` has them all.
SHOWN_ERRORS = 100


@dataclass
class IndexStats:
    repo_path: str
    files_processed: int = 0
    files_skipped: int = 0
    files_failed: int = 0
    files_deleted: int = 0
    chunks_indexed: int = 0
    chunks_deleted: int = 0
    elapsed_seconds: float = 0.0
    errors: list[str] = field(default_factory=list)

    def summary(self) -> str:
        return f"Indexed {self.files_processed} files ({self.files_skipped} unchanged, {self.files_failed} failed, {self.files_deleted} deleted): {self.chunks_indexed} chunks in {self.elapsed_seconds:.1f} s"

    def to_dict(self) -> dict:
        return asdict(self)


class Engine:
    """State lives under ``settings.store_path``: tables ``chunks``, ``manifest``, ``nodes`` and ``edges``.

    ``embed`` maps a text column to a vector column and replaces the hash
    embedding; ``docgen`` maps chunk columns to a summary for definitions
    without a docstring; ``rerank`` takes and returns a table of results. What
    isn't given comes from the settings' providers.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, embed: Callable[[Column], Column] | None = None, docgen: Callable[[DataFrame], Column] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, llm: answers.Client | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings()
        self.root = self.settings.store_path if "://" in self.settings.store_path or self.settings.store_path.startswith("/") else f"{_cwd()}/{self.settings.store_path}"
        self.store = open_store(self.settings.store_kind, spark, f"{self.root}/chunks", STORED, buckets=self.settings.store_buckets, metric=self.settings.metric)
        self.manifest = ChunkStore(spark, f"{self.root}/manifest", schemas.MANIFEST, key="file_path", buckets=self.settings.store_buckets)
        self.embed = embed or embedder(self.settings.embedding_provider, self.settings.embedding_model, self.settings.openai_api_key, self.settings.embedding_dim)
        self.docgen, self.rerank = docgen, rerank or reranker(self.settings.reranking_enabled, self.settings.reranker_model)
        self.summaries = ChunkStore(spark, f"{self.root}/summaries", "chunk_id string, file_path string, summary string", buckets=self.settings.store_buckets)
        s = self.settings
        self.llm = llm or answers.client(s.llm_provider, s.llm_model, s.api_key(), f"{s.ollama_base_url}/v1" if s.llm_provider == "ollama" else None)
        self.jobs: dict[str, dict] = {}

    # ------------------------------------------------------------ writing

    def index(self, source: str, incremental_run: bool = True) -> IndexStats:
        """Index a tree; by default only files whose hash differs from the manifest's. Chunks of changed and deleted files go, as do those that a changed file no longer has."""
        began = time.time()
        path = str(resolve(source, self.settings.clone_root)) if "://" not in source or source.startswith(("http://", "https://")) else source
        work = scratch.folder(self.spark)
        if not incremental_run:
            self.store.clear(), self.manifest.clear()
        found = source_files.scan_files(self.spark, path, self.settings.languages)
        files = scratch.stored(source_files.with_content(found), f"{work}/files")
        readable = files.filter("content is not null")
        changes = scratch.stored(incremental.diff(readable.select("file_path", "sha256"), self.manifest.read()), f"{work}/changes")
        todo = readable.join(changes.filter("status in ('new', 'changed')").select("file_path"), "file_path", "left_semi")
        parsed = scratch.stored(parse_files(todo, self.settings.chunk_max_tokens, self.settings.chunk_overlap_tokens), f"{work}/parsed")
        failed = parsed.filter("error is not null").select("file_path", "error")
        chunks = scratch.stored(self.enrich(parsed.filter("error is null").dropDuplicates(["chunk_id"])), f"{work}/chunks")
        stale = changes.filter("status in ('changed', 'deleted')").select("file_path")
        stats = IndexStats(path)
        counted = incremental.counts(changes).first()
        stats.chunks_deleted = self.store.read().join(stale, "file_path", "left_semi").count()
        self.store.delete(stale, by="file_path")
        self.store.upsert(chunks)
        done = todo.join(failed.select("file_path"), "file_path", "left_anti")
        self.manifest.delete(changes.filter("status <> 'unchanged'").select("file_path"))
        self.manifest.upsert(incremental.manifest_of(done, chunks))
        self._write_graph(work)
        unreadable = files.filter("content is null").select("file_path", F.lit("unreadable").alias("error"))
        failures = scratch.stored(failed.unionByName(unreadable), f"{work}/failures")
        failures.write.mode("overwrite").parquet(f"{self.root}/failures")
        stats.files_failed, unparsed = failures.count(), failed.count()
        errors = [f"{r['file_path']}: {r['error']}" for r in failures.orderBy("file_path").limit(SHOWN_ERRORS).collect()]
        if stats.files_failed > len(errors):
            errors.append(f"and {stats.files_failed - len(errors)} more, all in {self.root}/failures")
        stats.files_processed = counted["n_new"] + counted["n_changed"] - unparsed
        stats.files_skipped, stats.files_deleted = counted["n_unchanged"], counted["n_deleted"]
        stats.chunks_indexed, stats.errors, stats.elapsed_seconds = chunks.count(), errors, time.time() - began
        return stats

    def enrich(self, chunks: DataFrame) -> DataFrame:
        """Chunks with names, citation, summary, the text that is embedded, and its vector."""
        rows = graph.with_node_id(chunks).withColumn("citation", S.citation("file_path", "start_line", "end_line", "qualified_name")).withColumn("summary", S.doc_summary("docstring"))
        if self.docgen:
            self._document(rows.filter("summary is null"))
            kept = self.summaries.read().select("chunk_id", F.col("summary").alias("_s"))
            rows = rows.join(kept, "chunk_id", "left").withColumn("summary", F.coalesce("summary", "_s")).drop("_s")
        rows = rows.withColumn("enriched_text", S.enriched_text("citation", "language", "qualified_name", "summary", "imports", "raw_code"))
        return rows.withColumn("embedding", self.embed(F.col("enriched_text"))).select(*self.store.schema.fieldNames())

    def _document(self, chunks: DataFrame) -> None:
        """Summaries from ``docgen`` for chunks that have neither a docstring nor a kept summary; they are kept for later runs. A null summary is asked for again."""
        asked = incremental.undescribed(chunks, self.summaries.read())
        told = asked.withColumn("summary", self.docgen(asked)).filter("summary is not null")
        self.summaries.upsert(told.select("chunk_id", "file_path", "summary"))

    def _write_graph(self, work: str) -> None:
        nodes, edges = graph.build(self.store.read())
        scratch.stored(nodes, f"{work}/nodes").write.mode("overwrite").parquet(f"{self.root}/nodes")
        scratch.stored(edges, f"{work}/edges").write.mode("overwrite").parquet(f"{self.root}/edges")

    def submit_index(self, source: str, incremental_run: bool = True) -> str:
        """Index in the background; returns a job id for ``progress``."""
        job = uuid.uuid4().hex
        self.jobs[job] = {"job_id": job, "status": "started", "stats": None, "error": None}

        def run() -> None:
            self.jobs[job]["status"] = "running"
            try:
                self.jobs[job] |= {"stats": self.index(source, incremental_run).to_dict(), "status": "done"}
            except Exception as e:
                log.exception("indexing failed")
                self.jobs[job] |= {"status": "error", "error": str(e)}

        threading.Thread(target=run, daemon=True).start()
        return job

    def progress(self, job: str) -> dict:
        """KeyError for an unknown job."""
        return dict(self.jobs[job])

    # ------------------------------------------------------------ reading

    def status(self) -> dict:
        row = incremental.status(self.manifest.read()).first()
        return {"indexed": row["n_files"] > 0, "files": row["n_files"], "chunks": row["n_chunks"], "last_indexed": row["last_indexed"]}

    def has_graph(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/edges/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def graph_tables(self) -> tuple[DataFrame, DataFrame]:
        return self.spark.read.parquet(f"{self.root}/nodes"), self.spark.read.parquet(f"{self.root}/edges")

    def retrieve(self, questions: DataFrame, top_k: int | None = None, depth: int | None = None) -> DataFrame:
        """Contexts (see ``retrieval.context``) for questions (query_id, question), all in one job; a question that finds nothing has no row."""
        s = self.settings
        depth = s.graph_expansion_depth if depth is None else depth
        chunks = self.store.read()
        queries = questions.select("query_id", self.embed(F.col("question")).alias("query_vector"))
        shown = ["chunk_id", "node_id", "file_path", "start_line", "citation", "enriched_text", "qualified_name", "raw_code", "summary"]
        found = retrieval.top_k(chunks.select(*shown, "embedding"), queries, top_k or s.top_k, metric=s.metric)
        found = scratch.stored(found.withColumn("source", F.lit("vector_search")), f"{scratch.folder(self.spark)}/found")
        if depth > 0:
            nodes, edges = self.graph_tables()
            ranked = found.groupBy("query_id", "node_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
            reach = graph.neighbors(edges, ranked.select(F.col("node_id").alias("seed")).distinct(), depth)
            more = graph.expand(ranked, reach, fixed.EXPANSION_DECAY)
            more = more.join(chunks.select(*shown), "node_id").withColumns({"rank": F.lit(1 << 20), "source": F.lit("graph_expansion")})
            found = retrieval.dedup_best(found.unionByName(more.select(*found.columns)), ["query_id", "chunk_id"])
        if self.rerank:
            named = found.join(questions.select("query_id", "question"), "query_id").withColumns({"scope": F.col("qualified_name"), "file": F.col("file_path"), "code": F.col("raw_code")})
            found = self.rerank(named)
        return retrieval.context(found, s.context_token_budget)

    def ask(self, question: str, top_k: int | None = None, depth: int | None = None, llm: answers.Client | None = None) -> answers.Answer:
        """The answer to one question, by the engine's model or the one given; its ``context`` is the text that the model saw."""
        if not 1 <= len(question) <= 2000:
            raise ValueError("a question has 1 to 2000 characters")
        if top_k is not None and not 1 <= top_k <= 50:
            raise ValueError("top_k is 1 to 50")
        row = self.retrieve(self.spark.createDataFrame([(0, question)], "query_id int, question string"), top_k, depth).first()
        answer = answers.generate(question, row["context_text"] if row else "", list(row["citations"]) if row else [], llm or self.llm)
        answer.context = row["context_text"] if row else ""
        return answer

    # ------------------------------------------------------------ evaluation

    def evaluate(self, qa: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows, summary) for questions of ``schemas.QA``. Retrieval is one job; a question whose answer fails counts as an error and doesn't stop the others."""
        qa = qa.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("expected_chunks", "expected_keywords")})
        contexts = self.retrieve(qa.select(F.col("id").alias("query_id"), "question")).select(F.col("query_id").alias("id"), "context_text", "citations")
        asked = qa.select("id", "question").join(contexts, "id", "left")
        told = scratch.stored(asked.mapInPandas(_answering(self.llm), "id string, question string, answer string, citations array<string>, latency double, error string"), f"{scratch.folder(self.spark)}/answers")
        rows = told
        rows = rows.join(qa.select("id", "expected_chunks", "expected_keywords"), "id").withColumns({"retrieval_recall": S.retrieval_recall("expected_chunks", "citations"), "keyword_recall": S.keyword_recall("expected_keywords", "answer")})
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        summary = rows.agg(F.count("*").alias("n"), zero(F.avg("retrieval_recall")).alias("mean_retrieval_recall"), zero(F.avg("keyword_recall")).alias("mean_keyword_recall"), zero(F.avg("latency")).alias("avg_latency"), zero(F.sum("latency")).alias("total_latency"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
        return rows, summary


def _answering(llm: answers.Client):
    """Answers questions (id, question, context_text, citations) where they lie, one after the other in each task; a failure is that row's error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for q in part.itertuples():
                began, some = time.time(), q.citations is not None
                a = answers.generate(q.question, q.context_text if some else "", list(q.citations) if some else [], llm)
                failed = a.answer.startswith(answers.FAILED)
                rows.append((q.id, q.question, a.answer, a.citations, time.time() - began, a.answer if failed else None))
            yield pd.DataFrame(rows, columns=["id", "question", "answer", "citations", "latency", "error"])

    return run


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a JSON array file."""
    return spark.read.schema(schemas.QA).option("multiLine", True).json(path)


def report(rows: DataFrame, summary: DataFrame) -> str:
    """An evaluation as Markdown: totals, a line for each question, then details."""
    s = summary.first()
    out = ["# Evaluation report", "", "| Metric | Value |", "| --- | --- |"]
    out += [f"| {name} | {s[name]:.3f} |" if isinstance(s[name], float) else f"| {name} | {s[name]} |" for name in summary.columns]
    out += ["", "| Id | Retrieval | Keywords | Seconds | Error |", "| --- | --- | --- | --- | --- |"]
    details = []
    for r in rows.orderBy("id").collect():  # a row for each question asked
        out.append(f"| {r['id']} | {r['retrieval_recall']:.2f} | {r['keyword_recall']:.2f} | {r['latency']:.2f} | {r['error'] or ''} |")
        details += ["", f"## {r['id']}", "", r["question"], "", *(f"- {c}" for c in r["citations"][:5]), "", r["answer"][:200]]
    return "\n".join(out + details) + "\n"


def _cwd() -> str:
    from pathlib import Path

    return str(Path.cwd())
