"""The queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its host; its language within the source is the path."""
    from pyspark.sql import functions as F

    from .quality import score, train

    docs = _read(spark, sf_dir, "documents")
    return score(docs, train(docs, _read(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import length_histogram

    return length_histogram(_read(spark, sf_dir, "documents"))


def op3_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import token_files

    return token_files(_read(spark, sf_dir, "documents"))


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wumanber import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=80)


def op7_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_read(spark, sf_dir, "documents"))


def op10_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digest

    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat_digest(turns.unionByName(extra))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(_read(spark, sf_dir, "documents"))


def op8_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import neighbours

    return neighbours(_read(spark, sf_dir, "embeddings"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import example_findings, learn_words, scan, train

    docs = _read(spark, sf_dir, "documents")
    learned = learn_words(docs)
    return scan(docs, train(example_findings(spark), learned), learned)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_quality": op1_hierarchical_quality,
    "op2_token_counts": op2_token_counts,
    "op3_repair_token_files": op3_repair_token_files,
    "op4_wu_manber": op4_wu_manber,
    "op5_temperature_mixing": op5_temperature_mixing,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_compression_langid": op7_compression_langid,
    "op8_adaptive_dimension_scan": op8_adaptive_dimension_scan,
    "op9_secret_forest": op9_secret_forest,
    "op10_chat_prefix_target": op10_chat_prefix_target,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}') AS w FROM {table}"


_WU_MANBER = rf"""
WITH d AS ({_words("documents", "doc_id", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}),
b AS ({_words("benchmark", "item_id", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}),
i AS (SELECT item_id::VARCHAR AS item, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda x: array_to_string(w[x:x + 9], ' '))) AS win FROM b WHERE len(w) > 0),
u AS (SELECT DISTINCT item, k, win FROM i),
p AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS x FROM d, (SELECT DISTINCT k FROM u) WHERE len(w) >= k),
h AS (SELECT doc_id, x, p.k, item FROM p JOIN u ON u.k = p.k AND u.win = array_to_string(p.w[x:x + p.k - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT y) AS n_hit FROM (SELECT doc_id, unnest(range(x, x + k)) AS y FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_NEAR = rf"""
WITH RECURSIVE d AS ({_words("documents", "doc_id", r"[^\x20\x09-\x0D]+")}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda x: array_to_string(w[x:x + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)"""

_ORDER = "ORDER BY turn NULLS FIRST, role, text"
_CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(24 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '<\\*\|')) + len(regexp_extract_all(role, '[\\\n]')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

#: The others have none: tokenizers, compression, learned models, approximate search and the mixture's hashes are not SQL. Tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_wu_manber": _WU_MANBER,
    "op6_minhash_near_dedup": _NEAR,
    "op10_chat_prefix_target": _CHAT,
}
