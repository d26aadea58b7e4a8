"""Quality by hierarchical empirical Bayes.

A logistic classifier on text statistics and on words, both weighed by labelled
documents, gives each document its own evidence.
Grouped sums of its probabilities give hosts and paths (a path is a part of a
host) posterior rates: a path shrinks towards its host and a host towards the
whole corpus, by as much as the observed spread of rates asks for. A document's
quality is its own odds times the odds of its path against the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_batches, scratch, sized_join, stored

MOST_LABELLED = 20_000
#: Word features: a word counts for one of so many buckets of its hash.
BUCKETS = 256
_KINDS = {"upper": range(65, 91), "digit": range(48, 58), "line": [10], "pipe": [0x7C], "stop": [0x2E, 0x3F], "comma": [0x2C], "bang": [0x21], "mark": [0x23, 0x24, 0x25, 0x26, 0x2A, 0x40, 0x5E, 0x7E, 0x3C, 0x3E, 0x7B, 0x7D]}


def _kind_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, (_, values) in enumerate(_KINDS.items()):
        table[list(values)] = k + 1
    return table


_KIND = _kind_table()


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a slice; whole texts count."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    kinds = _KIND[data]
    counts = np.bincount(row * (len(_KINDS) + 1) + kinds, minlength=n * (len(_KINDS) + 1)).reshape(n, -1)[:, 1:].astype(float)
    counts[:, list(_KINDS).index("line")] -= 1  # the slice's own ending
    size = np.maximum(np.diff(bounds) - 1, 1).astype(float)
    words, first = K.spaced_words(data, bounds)
    n_words = np.diff(first)
    same = np.zeros(len(words) + 1)
    same[1:-1] = np.cumsum(words[1:] == words[:-1]) if len(words) > 1 else same[1:-1]
    if len(words) > 1:
        same[-1] = same[-2]
    again = same[np.maximum(first[1:], 1) - 1] - same[np.minimum(first[:-1], len(words) - 1 if len(words) else 0)] if len(words) else np.zeros(n)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], float)
    some = np.maximum(n_words, 1)
    shares = np.log1p(200 * counts / size[:, None])
    rest = np.stack([np.log1p(n_words), np.log1p(size), size / some / 10, np.log1p(20 * np.maximum(again, 0) / some), distinct / np.sqrt(some) / 10, distinct / some], 1)
    x = np.concatenate([shares, rest], 1)
    return np.concatenate([x, x * x, _word_shares(words, n_words)], 1)


def _word_shares(words: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """For each text and bucket the root of the share of its words that fall into the bucket."""
    row = np.repeat(np.arange(len(n_words)), n_words)
    counts = np.bincount(row * BUCKETS + (words >> np.uint64(56)).astype(np.int64) % BUCKETS, minlength=len(n_words) * BUCKETS).reshape(-1, BUCKETS)
    return np.sqrt(counts / np.maximum(n_words, 1)[:, None])


def width() -> int:
    """Features of a text."""
    return 2 * (len(_KINDS) + 6) + BUCKETS


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Newton steps: (means, scales, weights, intercept). With fewer than two classes the weights are 0."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(rate / (1 - rate))
    if len(np.unique(y)) < 2:
        return mean, scale, w[:-1], float(w[-1])
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def _map_features(docs: DataFrame, carry: list[str], kinds: str, make, arrow: list) -> DataFrame:
    schema = pa.schema(arrow)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.enter("quality")
        with np.errstate(over="ignore"):
            for batch in batches:
                for first, end, data, bounds in K.text_slices(batch.column(len(carry))):
                    part = [batch.column(k).slice(first, end - first).cast(schema.field(k).type) for k in range(len(carry))]
                    yield pa.RecordBatch.from_arrays([*part, make(features(data, bounds), schema.field(len(carry)).type)], schema=schema)

    return docs.mapInArrow(run, kinds)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED):
    """The classifier, fitted on about ``most`` labelled documents, drawn by a hash of the id, and twice as many at most.

    An id labelled more than once has its commonest label, 1 where even; null
    labels and ids are left out. Of an id that is repeated in docs one text
    counts, that with the smallest hash.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    n = rows.count()
    drawn = rows.withColumn("draw", F.xxhash64("id", F.lit(3))).filter(F.pmod("draw", F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))
    drawn = stored(drawn.orderBy("draw").limit(2 * most).drop("draw"), f"{scratch(docs.sparkSession)}/drawn")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("id", "y", F.xxhash64("text").alias("mark"), "text")
    pack = lambda x, kind: pa.array([r.tobytes() for r in x.astype("<f4")], kind)
    got = _map_features(texts, ["id", "y", "mark"], "id long, y double, mark long, x binary", pack, [("id", pa.int64()), ("y", pa.float64()), ("mark", pa.int64()), ("x", pa.binary())])
    got = got.groupBy("id").agg(F.min_by(F.struct("y", "x"), "mark").alias("r")).select("r.*").collect()  # 2 * most rows at most
    return fit(np.array([np.frombuffer(r["x"], "<f4") for r in got], float).reshape(len(got), width()), np.array([r["y"] for r in got], float))


def _strength(groups: DataFrame, s: str, n: str, prior: Column) -> float:
    """By how many documents a group's prior counts: the method of moments on the spread of group rates around their priors, beyond what their sizes explain."""
    rate = F.col(s) / F.col(n)
    spread = groups.select(F.sum(F.col(n) * (rate - prior) ** 2).alias("between"), F.sum(prior * (1 - prior)).alias("chance"), F.sum(F.col(n) * prior * (1 - prior)).alias("within"), F.sum(n).alias("n")).first()
    if not spread["n"]:
        return 1.0
    extra = max((spread["between"] - spread["chance"]) / spread["n"], 1e-9)
    return float(np.clip(spread["within"] / spread["n"] / extra - 1, 1.0, 1e6))


def score(docs: DataFrame, model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, classifier, host_rate, path_rate, quality, keep for every row of docs.

    ``host_rate`` and ``path_rate`` are the shrunk rates of the document's site
    without the document itself. Null hosts form one host, null paths one path
    of their host. A null text is empty. An empty table gives no rows. The sums
    are aggregated before any shuffle, and go back to the documents by a join
    that is broadcast or salted.
    """
    folder = scratch(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def logits(x: np.ndarray, kind) -> pa.Array:
        mean, scale, w, b = shared.value
        return pa.array(np.clip(((x - mean) / scale) @ w + b, -12, 12), kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    scored = stored(_map_features(rows, ["doc_id", "host", "path"], "doc_id long, host string, path string, logit double", logits, [("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("logit", pa.float64())]), f"{folder}/scored")
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), f"{folder}/paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = float(np.clip((total["s"] or 0.5) / (total["n"] or 1), 1e-6, 1 - 1e-6))
    of_host = _strength(hosts, "host_s", "host_n", F.lit(prior))
    shrunk = (F.col("host_s") + of_host * prior) / (F.col("host_n") + of_host)
    sites = stored(paths.join(hosts.withColumn("host_prior", shrunk), "host"), f"{folder}/sites")
    of_path = _strength(sites, "s", "n", F.col("host_prior"))
    joined = sized_join(scored, sites, ["host", "path"], "inner", salt=F.col("doc_id"))
    host_rate = (F.col("host_s") - p + of_host * prior) / (F.col("host_n") - 1 + of_host)
    joined = joined.withColumns({"classifier": p, "host_rate": host_rate})
    joined = joined.withColumn("path_rate", (F.col("s") - p + of_path * F.col("host_rate")) / (F.col("n") - 1 + of_path))
    inside = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_rate")))
    odds = F.col("logit") + F.log(inside / (1 - inside)) - float(np.log(prior / (1 - prior)))
    out = joined.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "classifier", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("keep"))
