"""From scored chunks to a context text. Everything is keyed by query_id, so many questions are one job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions import fixed
from ..functions import scalars as S

#: Bytes of query vectors that are broadcast at once, and scores that a task holds at once.
BLOCK_BYTES, BLOCK_SCORES = 32 << 20, 1 << 22


def top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding", metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """The k best rows for each query (query_id, query_vector), with score and rank, and the rows' other columns; ties by key, which is unique in rows.

    Exact. The queries go to the tasks as a matrix, in blocks of bounded size;
    every task meets them with its rows batch by batch and keeps k for each, so
    that nothing else is shuffled. Vectors that are null, of another length
    than the query's, or hold nulls take no part; nor do zero vectors, which
    have no cosine. ``digits`` rounds scores before they are ranked.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = rows.sparkSession
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("query_vector")), F.lit(1))).first()
    blocks = max(1, -(-n * max(width, 1) * 8 // BLOCK_BYTES))
    narrow = rows.select(key, F.col(vector).cast("array<double>").alias(vector))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(rows.dtypes)[key]}, score double"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    found, work = None, scratch.folder(spark)
    for b in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        held = some.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).toArrow()
        near = narrow.mapInArrow(_nearest(spark.sparkContext.broadcast(held), k, metric, digits), schema)
        near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        near = scratch.stored(near, f"{work}/{b}") if blocks > 1 else near
        found = near if found is None else found.unionByName(near)
    others = [c for c in rows.columns if c not in (key, vector)]
    if not others:
        return found.select(key, "query_id", "score", "rank")
    small = n * k <= 500_000
    return rows.select(key, *others).join(F.broadcast(found) if small else found, key)


def _nearest(queries, k: int, metric: str, digits: int | None):
    """Rows (key, vector) in Arrow batches to the k best of the task for each query of a broadcast table."""

    def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors that take part, and their numbers."""
        sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(sizes == width)
        part = column.take(pa.array(at))
        flat = part.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if len(at) else np.zeros((0, width))
        sound = np.isfinite(x).all(1) & ((x != 0).any(1) if metric == "cosine" else True)
        return x[sound], at[sound]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = queries.value
        names = table.column("query_id").combine_chunks()
        vectors = table.column("query_vector").combine_chunks()
        widths = np.unique(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))
        sides = [(w, *matrix(vectors, int(w))) for w in widths if w > 0]
        sides = [(w, q / np.sqrt((q * q).sum(1))[:, None] if metric == "cosine" else q, at) for w, q, at in sides if len(at)]
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        waiting, bound, kind = 0, np.full(len(names), -np.inf), None

        def compact() -> None:
            """Of what is held, the k best of each query."""
            nonlocal waiting
            who, score, keys = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])
            by_key = np.empty(len(keys), np.int64)
            by_key[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
            order = np.lexsort((by_key, -score, who))
            first = np.concatenate([[True], who[order][1:] != who[order][:-1]])
            place = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            stay = order[place < k]
            full = order[place == k - 1]
            bound[who[full]] = score[full]
            held[:] = [(who[stay], score[stay], keys.take(pa.array(stay)))]
            waiting = 0

        for batch in batches:
            column, keys = batch.column(1), batch.column(0)
            kind = keys.type
            for width, q, asked in sides:
                x, at = matrix(column, int(width))
                if not len(x):
                    continue
                if metric == "cosine":
                    x = x / np.sqrt((x * x).sum(1))[:, None]
                step = max(1, BLOCK_SCORES // len(x))
                for first in range(0, len(q), step):
                    part, who = q[first : first + step], asked[first : first + step]
                    score = part @ x.T if metric == "cosine" else np.stack([1 - ((x - v) ** 2).sum(1) for v in part])
                    score = np.round(score, digits) if digits is not None else score
                    least = bound[who]
                    if len(x) > k:
                        least = np.maximum(least, np.partition(score, len(x) - k, axis=1)[:, len(x) - k])
                    i, j = np.nonzero(score >= least[:, None])
                    if len(i):
                        held.append((who[i], score[i, j], keys.take(pa.array(at[j]))))
                        waiting += len(i)
                    if waiting > max(4 * k * len(names), BLOCK_SCORES):
                        compact()
        if held:
            compact()
            who, score, keys = held[0]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), keys, pa.array(score)], names=["query_id", batch.schema.names[0], "score"])

    return run


def dedup_best(results: DataFrame, keys: list[str], order: Column | str = "rank") -> DataFrame:
    """The best-scored row of each key; of equal scores the first in ``order``."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), order)
    return results.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def rerank_lexical(results: DataFrame, question: str = "question") -> DataFrame:
    """Results scored anew by keywords of their question; scope, file, code and summary are columns."""
    return results.withColumn("score", S.keyword_relevance(S.keywords(question), "scope", "file", "code", "summary", question))


def relevant_only(results: DataFrame, key: str = "query_id", score: str = "score") -> DataFrame:
    """Rows with a score above 0, or all rows of a query that has none."""
    best = F.max(score).over(Window.partitionBy(key))
    return results.withColumn("_m", best).filter((F.col(score) > 0) | (F.col("_m") <= 0)).drop("_m")


def select_within(items: Column, budget: int, overhead: int = fixed.BLOCK_OVERHEAD_TOKENS) -> Column:
    """Of an array of structs with ``tokens``, best first: each item whose cost fits what is left is taken, others are passed over; the first if none fits."""
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        cost = x["tokens"].cast("long") + overhead
        fits = cost <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - cost).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["taken"], F.array(acc["at"]))).otherwise(acc["taken"]).alias("taken"), (acc["at"] + 1).alias("at"))

    taken = F.aggregate(items, start, step)["taken"]
    chosen = F.transform(taken, lambda i: F.get(items, i))
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.slice(items, 1, 1))


def context(results: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """query_id, context_text, total_tokens, n_results, citations for results with rank, score, source, file_path, start_line, citation, enriched_text.

    A query's results (its top k and their neighbours) are gathered; selection
    is by score, the text in reading order.
    """
    item = F.struct((-F.col("score")).alias("worst"), F.col("rank"), F.col("file_path"), F.col("start_line"), F.col("score"), F.col("source"), F.col("citation"), F.col("enriched_text"), S.count_tokens("enriched_text").alias("tokens"))
    gathered = results.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    chosen = F.array_sort(F.transform(select_within(F.col("items"), budget), lambda x: F.struct(x["file_path"], x["start_line"], x["rank"], x["score"], x["source"], x["citation"], x["enriched_text"])))
    picked = gathered.select(key, chosen.alias("chosen"))
    block = lambda x, i: F.concat(S.block_header(i + 1, F.size("chosen"), x["citation"], x["score"], x["source"]), F.lit("\n"), x["enriched_text"])
    text = picked.withColumn("context_text", F.array_join(F.transform("chosen", block), "\n\n"))
    return text.select(key, "context_text", S.count_tokens("context_text").alias("total_tokens"), F.size("chosen").alias("n_results"), S.distinct_citations(F.transform("chosen", lambda x: x["citation"])).alias("citations"), "chosen")


def source_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("source").agg(F.count("*").alias("n_results"))
