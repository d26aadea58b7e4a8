"""Approximate nearest neighbours by adaptive dimension scan.

Index: vectors are rotated by a random orthogonal matrix, dealt to lists by
their nearest centre, and kept in blocks, each a matrix whose rows are
dimensions. Search: a query probes the lists with the nearest centres. In a
block distances grow by groups of dimensions; after each group a candidate is
abandoned when its partial distance, scaled to all dimensions, exceeds the
query's bound by more than a hypothesis test allows. Survivors are measured
again in double precision on the original vectors.

Equal vectors are one candidate with its k + 1 smallest ids, which is all that
any result can hold of them, so copies never make a list hot; a list that is
large all the same is dealt to several blocks, as are the queries that probe
it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored

SAMPLE, LISTS_PER_ROOT, MOST_LISTS = 20_000, 2.0, 4096
#: Of the true neighbours within the sample, the share whose lists are probed, and the sample's queries that this is measured on.
REACHED, TRIALS = 0.96, 512
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
GROUP = 16
#: Width of the test in standard errors of the scaled partial distance.
EPSILON = 2.1


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if isinstance(column, pd.Series) else column.to_pylist(), dtype=np.float64)


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, n: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means over the sample."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    n = min(n, len(sample))
    c = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        near = _nearest(sample, c, 1)[:, 0]
        count = np.bincount(near, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    d = (c * c).sum(1)[None, :] - 2 * x @ c.T
    if n == 1:
        return d.argmin(1)[:, None]
    part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1), 1)


def probe_share(sample: np.ndarray, c: np.ndarray, k: int, reached: float = REACHED, trials: int = TRIALS, seed: int = 9) -> float:
    """The share of the lists that must be probed to reach ``reached`` of the k nearest, as measured within the sample.

    Neighbours in a sample are farther away than in the whole, so their lists
    are, too: the share errs on the safe side. Vectors in clusters need few
    lists; vectors that lie about evenly on a sphere need many, whatever the
    index.
    """
    if len(sample) < 2 or len(c) < 2:
        return 1.0
    at = np.random.default_rng(seed).permutation(len(sample))[:trials]
    lists, ranks = _nearest(sample, c, 1)[:, 0], []
    for some in np.array_split(at, max(1, len(at) // 64)):
        q = sample[some]
        d = (sample * sample).sum(1)[None, :] - 2 * q @ sample.T
        d[np.arange(len(some)), some] = np.inf
        near = np.argpartition(d, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
        order = _nearest(q, c, len(c))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(c))[None, :], 1)
        ranks.append(np.take_along_axis(place, lists[near], 1).ravel())
    return (float(np.quantile(np.concatenate(ranks), reached, method="higher")) + 1) / len(c)


def sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector: rows that take part. Those with a null id, or a vector that is null, empty, zero or holds null or non-finite components don't; nor do vectors of another length than the commonest (of equally common ones the longest)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = rows.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (dim["d"] if dim else 0))


def scan(queries: np.ndarray, bounds: np.ndarray, block: np.ndarray, epsilon: float = EPSILON, group: int = GROUP) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the numbers of the block's vectors that the tests don't abandon. ``block`` has dimensions as rows; ``bounds`` are squared distances."""
    dim = len(block)
    for k, q in enumerate(queries):
        alive, partial = None, np.zeros(block.shape[1], block.dtype)
        for at in range(0, dim, group):
            end = min(dim, at + group)
            rows = block[at:end] if alive is None else block[at:end, alive]
            d = rows - q[at:end, None]
            partial = partial + np.einsum("ij,ij->j", d, d)
            limit = bounds[k] * (1 + 1e-6) if end == dim else bounds[k] * (end / dim) * (1 + epsilon / np.sqrt(end)) ** 2
            stay = np.flatnonzero(partial <= limit)
            alive = stay if alive is None else alive[stay]
            partial = partial[stay]
            if not len(alive):
                break
        if len(alive):
            yield k, alive


def _best(q: np.ndarray, vectors: np.ndarray, ids: list, k: int) -> list[tuple[float, int]]:
    """The k nearest (distance, id) of vectors with lists of ids, in double precision."""
    d = vectors - q
    far = np.sqrt((d * d).sum(1))
    few = np.argpartition(far, k - 1)[:k] if len(far) > k else np.arange(len(far))
    top = far[few].max()
    return sorted((float(far[j]), int(i)) for j in np.flatnonzero(far <= top) for i in ids[j])[:k]


def neighbours(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, probed: float | None = None, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by Euclidean distance of every row whose id is divisible by ``every``, ties to the smaller id.

    A query's candidates are all rows but those of its own id. Rows that
    ``sound`` leaves out take no part. Rows repeated whole are one row; an id
    with several vectors is several rows, and a query with its first vector.
    Rotation and centres are fitted on a hash sample of about ``sample`` vectors,
    every row is indexed. The share ``probed`` of the lists is probed, by default
    what ``probe_share`` finds, and as many more as it takes to find k
    candidates if there are so many.
    """
    spark = df.sparkSession
    folder = scratch(spark)
    rows = sound(df, id_col, vector_col)
    # Equal vectors: the k + 1 smallest ids each. The limit on ranks is applied before the shuffle, too.
    ranked = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_r") <= k + 1)
    vectors = stored(ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), f"{folder}/vectors")
    n = vectors.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    drawn = vectors.select("v").filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))) if n > sample else vectors.select("v")
    fitted = np.array([r["v"] for r in drawn.collect()], dtype=np.float64)
    turn = rotation(fitted.shape[1])
    fitted = fitted @ turn
    c = centres(fitted, max(1, min(MOST_LISTS, int(LISTS_PER_ROOT * n**0.5))))
    probes = max(1, int(np.ceil((probe_share(fitted, c, k) if probed is None else probed) * len(c))))
    model = spark.sparkContext.broadcast((turn, c, fitted[: 4 * SAMPLE // 20]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, c, _ = model.value
        for b in batches:
            near = _nearest(_matrix(b.column(0)) @ turn, c, 1)[:, 0] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], names=["v", "ids", "list"])

    indexed = stored(vectors.select("v", "ids").mapInArrow(assign, vectors.select("v", "ids").schema.add("list", "integer")), f"{folder}/index")
    lists = stored(indexed.groupBy("list").agg(F.count("*").alias("n")), f"{folder}/lists")
    held = np.zeros(len(c), np.int64)
    for r in lists.collect():  # MOST_LISTS at most
        held[r["list"]] = r["n"]
    sizes = spark.sparkContext.broadcast(held)
    lists = lists.select("list", F.ceil(F.col("n") / BLOCK_VECTORS).cast("int").alias("blocks"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, c, some = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1)) @ turn
            ranked = _nearest(x, c, len(c))
            # The share of the lists asked for, and more until they hold k + 1 vectors.
            n_probes = np.minimum(np.maximum(probes, (np.cumsum(sizes.value[ranked], axis=1) <= k).sum(axis=1) + 1), len(c))
            probed = np.zeros((len(x), len(c)), bool)
            np.put_along_axis(probed, ranked, np.arange(len(c))[None, :] < n_probes[:, None], 1)
            d = np.maximum((x * x).sum(1)[:, None] + (some * some).sum(1)[None, :] - 2 * x @ some.T, 0)
            # A bound on the k-th nearest in these lists. The query itself may be in the sample, so it is the (k + 1)-th of the sample's.
            d[~probed[:, _nearest(some, c, 1)[:, 0]]] = np.inf
            bound = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k else np.full(len(x), np.inf)
            near = [r[:m] for r, m in zip(ranked.tolist(), n_probes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bound + 1e-9, pa.float64()), pa.array(near, pa.list_(pa.int32()))], names=["q", "qv", "bound", "near"])

    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(F.col("id").alias("q"), F.col("v").alias("qv")).mapInArrow(probe, f"q long, qv {dict(rows.dtypes)['v']}, bound double, near array<int>")
    asked = stored(asked.select("q", "qv", "bound", F.explode("near").alias("list")), f"{folder}/asked")
    sides = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("sides"))
    both = lists.join(sides, "list")  # a row for each list
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    small = F.broadcast(both)
    left = asked.join(small, "list").select("list", part("q", "sides").alias("side"), each("blocks").alias("block"), "q", "qv", "bound")
    right = indexed.join(small, "list").select("list", each("sides").alias("side"), part("v", "blocks").alias("block"), "v", "ids")
    rotate = spark.sparkContext.broadcast(turn)

    def search(key, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(found):
            exact, q = _matrix(found["v"]), _matrix(queries["qv"])
            block = np.ascontiguousarray((exact @ rotate.value).T, dtype=np.float32)
            ids, names = found["ids"].tolist(), queries["q"].tolist()
            bounds = queries["bound"].to_numpy(np.float64)
            for at, alive in scan((q @ rotate.value).astype(np.float32), bounds * (1 + 1e-4), block, epsilon):
                own = names[at]
                kept = [[i for i in ids[j] if i != own] for j in alive]
                best = _best(q[at], exact[alive], kept, k + 1)[: k]
                out += [(own, i, d) for d, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    pairs = left.groupBy("list", "side", "block").cogroup(right.groupBy("list", "side", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
