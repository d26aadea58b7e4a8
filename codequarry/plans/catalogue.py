"""Registered queries over the driver's tables, and their SQL twins.

``documents`` plays a tree of files, ``lineitem`` a call graph (orders are
files, suppliers callers, parts callees), ``orders`` and ``events`` stores and
manifests. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions import fixed
from ..functions import scalars as S
from ..operators import graph, incremental, retrieval
from ..sources import files as source_files
from ..sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_EXT = "CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.JS' WHEN 'de' THEN '.rs' ELSE '.png' END"
_PATH = f"concat(source, '/', CAST(doc_id AS STRING), {_EXT})"
_PATH_SQL = f"source || '/' || doc_id || {_EXT}"
_LANGUAGE_SQL = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'rust' END"


def _files(spark, d):
    return read(spark, d, "documents").withColumn("file_path", F.expr(_PATH))


# ---------------------------------------------------------------- scans and scalars


@query(f"SELECT {_PATH_SQL} AS file_path, {_LANGUAGE_SQL} AS language, len(string_split(text, chr(10))) AS line_count FROM documents WHERE lang IN ('en', 'fr') AND n_chars <= 5000 AND source NOT IN ('build', 'dist')")
def scan_filter_files(spark, d):
    kept = _files(spark, d).filter(source_files.wanted_file(F.col("file_path"), F.col("n_chars"), ["python", "javascript"], 5000) & ~source_files.in_skipped_dir(F.col("file_path")))
    return kept.select("file_path", S.detect_language(S.extension("file_path")).alias("language"), S.line_count("text").alias("line_count"))


@query(f"SELECT doc_id, lower({_EXT}) AS extension, {_LANGUAGE_SQL} AS language, source AS folder, CAST(doc_id AS VARCHAR) AS stem FROM documents")
def detect_language(spark, d):
    f = _files(spark, d)
    return f.select("doc_id", S.extension("file_path").alias("extension"), S.detect_language(S.extension("file_path")).alias("language"), F.split("file_path", "/")[0].alias("folder"), S.file_stem("file_path").alias("stem"))


@query("SELECT count(*) AS visited, count(*) FILTER (WHERE lang = 'es' OR n_chars > 5000) AS skipped, count(*) FILTER (WHERE lang <> 'es' AND n_chars <= 5000) AS yielded FROM documents")
def walk_counts(spark, d):
    return source_files.tally(_files(spark, d), source_files.wanted_file(F.col("file_path"), F.col("n_chars"), None, 5000))


@query("SELECT page_id, split_part(url, '/', 4) AS owner, regexp_replace(split_part(url, '/', 5), '[^0-9].*$', '') AS repo FROM pages")
def repo_url_parse(spark, d):
    address = F.concat(F.lit("https://github.com/"), F.split("url", "/")[3], F.lit("/"), F.regexp_replace(F.split("url", "/")[4], "[^0-9].*$", ""), F.lit(".git"))
    pages = read(spark, d, "pages").select("page_id", address.alias("url"))
    return pages.select("page_id", F.regexp_extract("url", fixed.GITHUB_URL, 1).alias("owner"), F.regexp_extract("url", fixed.GITHUB_URL, 2).alias("repo"))


@query(f"SELECT doc_id, substr(sha256({_PATH_SQL} || '|function_definition|' || n_chars || '|' || coalesce(lang, '')), 1, 16) AS chunk_id FROM documents")
def chunk_id(spark, d):
    return _files(spark, d).select("doc_id", S.chunk_id("file_path", F.lit("function_definition"), "n_chars", "lang").alias("chunk_id"))


@query(
    "SELECT p_partkey, q AS qualified_name, 'f.py:L' || p_size || '-L' || (p_size + 3) || CASE WHEN q = '<anonymous>' THEN '' ELSE ' (' || q || ')' END AS citation, 'f.py::' || q AS node_id FROM "
    "(SELECT p_partkey, p_size, CASE WHEN p_size % 7 = 0 AND p_size % 5 = 0 THEN '<anonymous>' WHEN p_size % 7 = 0 THEN p_brand WHEN p_size % 5 = 0 THEN p_name ELSE p_brand || '.' || p_name END AS q FROM part)"
)
def qualified_name_citation(spark, d):
    p = read(spark, d, "part").withColumns({"fn": F.when(F.col("p_size") % 7 != 0, F.col("p_name")), "cls": F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise("")})
    p = p.withColumn("q", S.qualified_name("cls", "fn"))
    return p.select("p_partkey", F.col("q").alias("qualified_name"), S.citation(F.lit("f.py"), "p_size", F.col("p_size") + 3, "q").alias("citation"), S.node_id(F.lit("f.py"), "q").alias("node_id"))


@query("SELECT doc_id, greatest(1, (length(text) + 3) // 4) AS n_tokens, len(string_split(text, chr(10))) AS line_count FROM documents")
def token_count(spark, d):
    return read(spark, d, "documents").select("doc_id", S.count_tokens("text").alias("n_tokens"), S.line_count("text").alias("line_count"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    "WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: greatest(1, (length(x) + 4) // 4)) AS t FROM documents WHERE greatest(1, (length(text) + 3) // 4) > 512), "
    "c AS (SELECT doc_id, list_transform(range(0, len(t) + 1), lambda i: coalesce(list_sum(t[1:i]), 0)::BIGINT) AS cum, len(t) AS n FROM l), "
    "s AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS a, greatest(1, len(list_filter(cum, lambda x: x <= 512)) - 1)::BIGINT AS b, cum, n FROM c UNION ALL "
    "SELECT doc_id, k + 1, st, greatest(st + 1, len(list_filter(cum, lambda x: x <= cum[st + 1] + 512)) - 1)::BIGINT, cum, n FROM (SELECT *, greatest(a + 1, least(b, len(list_filter(cum, lambda x: x <= cum[b + 1] - 64)) - 1))::BIGINT AS st FROM s WHERE b < n)) "
    "SELECT doc_id, k::INT AS split_index, a + 1 AS start_line, b AS end_line FROM s"
)
def token_split(spark, d):
    import pandas as pd

    from ..operators.parsing import count_tokens, split_lines

    def split(batches):
        for batch in batches:
            rows = [(i, k, at + 1, at + 1 + text.count("\n")) for i, whole in zip(batch["doc_id"], batch["text"], strict=True) if whole is not None and count_tokens(whole) > 512 for k, (text, at) in enumerate(split_lines(whole, 512, 64))]
            yield pd.DataFrame(rows, columns=["doc_id", "split_index", "start_line", "end_line"])

    return read(spark, d, "documents").select("doc_id", "text").mapInPandas(split, "doc_id long, split_index int, start_line long, end_line long")


# Every document as a body of code: what stands before and after its text are import lines that differ from document to document.
_IMPORTS_SQL = "CASE doc_id % 3 WHEN 0 THEN 'import m' || doc_id % 7 || '|from pack' || doc_id % 5 || '.sub import c' WHEN 1 THEN '' ELSE 'import json' END"


@query(f"SELECT doc_id, {_IMPORTS_SQL} AS imports FROM documents WHERE NOT regexp_matches(text, '(^|\\n)\\s*(import|from) ')")
def local_imports(spark, d):
    docs = read(spark, d, "documents").filter(~F.col("text").rlike(r"(?m)^\s*(import|from) "))
    one = F.concat(F.lit("def f():\n    import m"), F.col("doc_id") % 7, F.lit("\n\tfrom pack"), F.col("doc_id") % 5, F.lit(".sub import c\n"), "text", F.lit("\n    import m"), F.col("doc_id") % 7, F.lit("\n"))
    code = F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x = 1\n"), "text")).otherwise(F.concat(F.lit("import json\nimportant = 2\n"), "text"))
    return docs.select("doc_id", F.array_join(S.local_imports(code), "|").alias("imports"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'm' || doc_id WHEN 1 THEN source WHEN 2 THEN 'u' || doc_id WHEN 3 THEN 'lib' || doc_id WHEN 4 THEN NULL ELSE 'h' || doc_id END AS module FROM documents")
def import_module(spark, d):
    docs = read(spark, d, "documents")
    said = ["import m{} , sys", "from {s}.b import c", "import {{ foo }} from './u{}';", 'import x from "../../lib{}/deep"', "import 'side-effect-{}'", "import h from './h{}.js'"]
    shapes = [F.replace(F.replace(F.lit(x.replace("{{", "{").replace("}}", "}")), F.lit("{}"), F.col("doc_id").cast("string")), F.lit("{s}"), F.col("source")) for x in said]
    statement = F.element_at(F.array(*shapes), (F.col("doc_id") % 6 + 1).cast("int"))
    language = F.element_at(F.array(*(F.lit(x) for x in ("python", "python", "javascript", "typescript", "javascript", "javascript"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select("doc_id", S.import_module(statement, language).alias("module"))


@query(
    f"SELECT doc_id, concat_ws(chr(10), '[File]: ' || {_PATH_SQL} || ':L1-L' || len(string_split(text, chr(10))) || ' (' || source || ')', '[Language]: ' || lang, '[Scope]: ' || source, '[Summary]: ' || nullif(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1], ''), '[Imports]: import a; import b', '', '[Code]:', "
    "CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || chr(10) || '... [truncated]' ELSE text END) AS enriched_text FROM documents"
)
def enrich_text(spark, d):
    f = _files(spark, d)
    cite = S.citation("file_path", F.lit(1), S.line_count("text"), "source")
    return f.select("doc_id", S.enriched_text(cite, "lang", "source", S.doc_summary("text"), F.array(F.lit("import a"), F.lit("import b")), "text").alias("enriched_text"))


@query(
    "WITH w AS (SELECT doc_id, list_transform(range(0, 16), lambda i: ('0x' || substr(sha256(text), 1 + 8 * (i % 8), 8))::BIGINT / 4294967296.0) AS v FROM documents) "
    "SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) * 1000000) AS BIGINT)), ',') AS vector FROM w"
)
def mock_embedding(spark, d):
    v = S.hash_embedding("text", 16)
    return read(spark, d, "documents").select("doc_id", F.array_join(F.transform(v, lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("vector"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS text, CASE WHEN p_size % 4 = 0 THEN -999 ELSE p_size END AS number, '[\"' || p_brand || '\",\"' || p_type || '\"]' AS items, p_size % 3 <> 0 AS same FROM part")
def metadata_codec(spark, d):
    p = read(spark, d, "part").withColumns({"t": F.when(F.col("p_size") % 3 != 0, F.col("p_name")), "n": F.when(F.col("p_size") % 4 != 0, F.col("p_size")), "l": F.array("p_brand", "p_type")})
    m = p.withColumn("m", S.flat_metadata("t", "n", "l")).withColumn("back", S.from_flat_metadata("m"))
    same = F.col("back.text").eqNullSafe(F.col("p_name")) & F.col("back.number").eqNullSafe(F.col("n")) & (F.col("back.items") == F.col("l"))
    return m.select("p_partkey", "m.text", "m.number", "m.items", same.alias("same"))


@query("SELECT p_partkey, '{\"p_partkey\":' || p_partkey || ',\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}' AS json FROM part")
def chunk_json(spark, d):
    return read(spark, d, "part").select("p_partkey", S.chunk_json("p_partkey", "p_brand", "p_size").alias("json"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def display_time(spark, d):
    return read(spark, d, "events").select("event_id", S.display_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("shown"))


# ---------------------------------------------------------------- vectors

_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def _near(spark, d, metric="cosine"):
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).withColumn("score", F.round(S.similarity("embedding", "q", metric), 6))


@query(f"SELECT e.vec_id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, vec_id LIMIT 8")
def vector_topk(spark, d):
    return _near(spark, d).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(8)


@query("SELECT e.vec_id, round(1 - list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, vec_id LIMIT 8")
def vector_topk_l2(spark, d):
    return _near(spark, d, "l2").select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(8)


@query(f"SELECT e.vec_id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = 3 ORDER BY score DESC, vec_id LIMIT 8")
def vector_topk_where(spark, d):
    held = store.ephemeral(spark, "vec_id long, label int, embedding array<double>", key="vec_id", deal_by="vec_id", buckets=8)
    held.upsert(read(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")))
    asked = held.get_by_id(0).first()  # one row
    return held.query(list(asked["embedding"]), 8, {"label": 3}, digits=6).select("vec_id", "score")


def _batch(spark, d):
    """Every vector whose id is divisible by 20 asks for its ten nearest among all."""
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.top_k(e.select("vec_id", "embedding"), q, 10, key="vec_id", digits=6)


_BATCH = f"(SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM {_BATCH} QUALIFY rank <= 10)"


@query(f"SELECT query_id, vec_id, score, rank FROM {_RANKED}")
def vector_topk_batch(spark, d):
    return _batch(spark, d).select("query_id", "vec_id", "score", "rank")


_TOKENS = "30 + (vec_id * 37) % 90"


def _results(spark, d):
    text = F.concat(F.lit("chunk "), F.repeat(F.lit("x"), (F.expr(_TOKENS) * 4 - 12).cast("int")))
    r = _batch(spark, d)
    return r.select("query_id", "rank", "score", F.lit("vector_search").alias("source"), F.concat(F.lit("f"), F.col("vec_id") % 7, F.lit(".py")).alias("file_path"), F.col("vec_id").alias("start_line"), F.concat(F.lit("f"), F.col("vec_id") % 7, F.lit(".py:L"), F.col("vec_id"), F.lit("-L"), F.col("vec_id") + 1).alias("citation"), text.alias("enriched_text"))


_FOLD = (
    f"WITH RECURSIVE r AS (SELECT *, (length('chunk ' || repeat('x', ({_TOKENS}) * 4 - 12)) + 3) // 4 + 6 AS cost FROM {_RANKED}), "
    "f AS (SELECT query_id, 1 AS rank, CASE WHEN cost <= 300 THEN 300 - cost ELSE 300 END AS rest, cost <= 300 AS taken, vec_id, score FROM r WHERE rank = 1 UNION ALL "
    "SELECT r.query_id, r.rank, CASE WHEN r.cost <= f.rest THEN f.rest - r.cost ELSE f.rest END, r.cost <= f.rest, r.vec_id, r.score FROM f JOIN r ON r.query_id = f.query_id AND r.rank = f.rank + 1)"
)


@query(f"{_FOLD} SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY 'f' || vec_id % 7 || '.py', vec_id) AS picked, count(*)::INT AS n_results FROM f WHERE taken GROUP BY query_id")
def context_budget(spark, d):
    c = retrieval.context(_results(spark, d), 300)
    return c.select("query_id", F.array_join(F.transform("chosen", lambda x: x["start_line"].cast("string")), ",").alias("picked"), "n_results")


@query(
    f"{_FOLD}, p AS (SELECT *, 'f' || vec_id % 7 || '.py' AS path, row_number() OVER w AS i, count(*) OVER (PARTITION BY query_id) AS n FROM f WHERE taken WINDOW w AS (PARTITION BY query_id ORDER BY 'f' || vec_id % 7 || '.py', vec_id)), "
    f"t AS (SELECT query_id, string_agg('--- [' || i || '/' || n || '] ' || path || ':L' || vec_id || '-L' || (vec_id + 1) || ' (score=' || printf('%.3f', score) || ', source=vector_search) ---' || chr(10) || 'chunk ' || repeat('x', ({_TOKENS}) * 4 - 12), chr(10) || chr(10) ORDER BY i) AS context_text FROM p GROUP BY query_id) "
    "SELECT query_id, context_text, greatest(1, (length(context_text) + 3) // 4) AS total_tokens FROM t"
)
def context_text(spark, d):
    return retrieval.context(_results(spark, d), 300).select("query_id", "context_text", "total_tokens")


@query(
    f"WITH r AS (SELECT * FROM {_RANKED}), l AS (SELECT vec_id, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings), "
    "e AS (SELECT vec_id AS a, nxt AS b FROM l WHERE nxt IS NOT NULL UNION SELECT nxt, vec_id FROM l WHERE nxt IS NOT NULL), "
    "x AS (SELECT r.query_id, e.b AS vec_id, r.rank, r.score FROM r JOIN e ON e.a = r.vec_id WHERE (r.query_id, e.b) NOT IN (SELECT (query_id, vec_id) FROM r)), "
    "n AS (SELECT query_id, vec_id, round(score * 0.7, 7) AS score, 'graph_expansion' AS source, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY rank) AS k FROM x) "
    "SELECT query_id, vec_id, score, 'vector_search' AS source FROM r UNION ALL SELECT query_id, vec_id, score, source FROM n WHERE k = 1"
)
def graph_expand(spark, d):
    e = read(spark, d, "embeddings")
    edges = e.select(F.col("vec_id").cast("string").alias("source"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).cast("string").alias("target"), F.lit("calls").alias("edge_type")).filter("target is not null")
    ranked = scratch.stored(_batch(spark, d).withColumn("node_id", F.col("vec_id").cast("string")).select("query_id", "node_id", "rank", "score"), f"{scratch.folder(spark)}/ranked")
    reach = graph.neighbors(edges, ranked.select(F.col("node_id").alias("seed")).distinct(), 1)
    more = graph.expand(ranked, reach, fixed.EXPANSION_DECAY).select("query_id", "node_id", F.round("score", 7).alias("score"), F.lit("graph_expansion").alias("source"))
    all_ = ranked.select("query_id", "node_id", "score", F.lit("vector_search").alias("source")).unionByName(more)
    return all_.select("query_id", F.col("node_id").cast("long").alias("vec_id"), "score", "source")


# ---------------------------------------------------------------- store and manifest


def _document_store(spark, d):
    held = store.ephemeral(spark, "doc_id long, source string, lang string, n_chars long", key="doc_id", deal_by="source", buckets=8)
    held.upsert(read(spark, d, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")))
    return held


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 17")
def get_by_id(spark, d):
    return _document_store(spark, d).get_by_id(17).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id FROM documents WHERE source = 'src3'")
def file_chunk_ids(spark, d):
    return _document_store(spark, d).file_chunk_ids("src3")


def _order_store(spark, d):
    held = store.ephemeral(spark, "o_orderkey long, o_custkey long, o_orderstatus string", key="o_orderkey", deal_by="o_orderkey", buckets=8)
    held.upsert(read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus"))
    return held


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey > 0")
def upsert(spark, d):
    held = _order_store(spark, d)
    changed = held.read().filter("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("new"))
    added = held.read().filter("o_orderstatus = 'P' and o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("new").alias("o_orderstatus"))
    held.upsert(changed.unionByName(added))
    return held.read().select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'")
def delete(spark, d):
    held = _order_store(spark, d)
    held.delete(read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("long").alias("o_orderkey")))
    return held.read().select("o_orderkey", "o_custkey")


_MANIFEST = "(SELECT CASE WHEN lang = 'fr' THEN 'gone/' ELSE 'src/' END || doc_id AS file_path, CASE WHEN lang = 'de' THEN 'x' ELSE sha256(text) END AS was FROM documents WHERE lang <> 'es')"


def _changes(spark, d):
    docs = read(spark, d, "documents").select("lang", F.concat(F.lit("src/"), "doc_id").alias("file_path"), F.sha2("text", 256).alias("sha256"))
    old = docs.filter("lang <> 'es'").select(F.when(F.col("lang") == "fr", F.replace("file_path", F.lit("src/"), F.lit("gone/"))).otherwise(F.col("file_path")).alias("file_path"), F.when(F.col("lang") == "de", "x").otherwise(F.col("sha256")).alias("sha256"))
    return incremental.diff(docs.select("file_path", "sha256"), old)


_DIFF = f"SELECT file_path, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'deleted' WHEN now = was THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT 'src/' || doc_id AS file_path, sha256(text) AS now FROM documents) FULL JOIN {_MANIFEST} USING (file_path)"


@query(_DIFF)
def incremental_diff(spark, d):
    return _changes(spark, d).select("file_path", "status")


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("new", "changed", "unchanged", "deleted")) + f" FROM ({_DIFF})")
def index_stats(spark, d):
    return incremental.counts(_changes(spark, d))


@query("SELECT count(*) AS n_files, sum(n)::BIGINT AS n_chunks, max(t) AS last_indexed FROM (SELECT user_id, count(*) AS n, max(ts) AS t FROM events GROUP BY user_id)")
def index_status(spark, d):
    m = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("indexed_at"))
    return incremental.status(m.select(F.when(F.col("n") % 2 == 0, F.col("n")).alias("chunk_count"), F.sequence(F.lit(1), F.col("n")).alias("chunk_ids"), "indexed_at"))


@query("SELECT d.doc_id FROM documents d WHERE d.lang = 'en' AND d.doc_id NOT IN (SELECT doc_id FROM labels)")
def needs_docgen(spark, d):
    return incremental.undescribed(read(spark, d, "documents").filter("lang = 'en'").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("SELECT source, count(*) AS n_results FROM documents GROUP BY source")
def source_summary(spark, d):
    return retrieval.source_counts(read(spark, d, "documents"))


# ---------------------------------------------------------------- graph

_CALLS_SQL = "SELECT 's' || l_suppkey AS source, l_orderkey, l_partkey, l_linenumber FROM lineitem"


def _calls(spark, d):
    line = read(spark, d, "lineitem")
    calls = line.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.col("l_orderkey").alias("file_path"), F.col("l_partkey").alias("call_name"), F.col("l_linenumber").alias("ordinal"))
    index = line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file_path"), F.col("l_partkey").alias("name"), F.concat(F.lit("p"), "l_partkey").alias("node_id")).distinct()
    return calls, index


@query(f"SELECT source, target, call_name FROM (SELECT c.source, 'p' || c.l_partkey AS target, c.l_partkey AS call_name, row_number() OVER (PARTITION BY c.source, c.l_partkey ORDER BY c.l_linenumber) AS k FROM ({_CALLS_SQL}) c JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') i USING (l_orderkey, l_partkey)) WHERE k = 1")
def call_resolve(spark, d):
    return graph.resolve_calls(*_calls(spark, d))


@query(f"SELECT DISTINCT source, 'external::' || l_partkey AS target, l_partkey AS call_name FROM ({_CALLS_SQL}) c WHERE NOT EXISTS (SELECT 1 FROM lineitem i WHERE i.l_returnflag = 'R' AND i.l_orderkey = c.l_orderkey AND i.l_partkey = c.l_partkey)")
def external_calls(spark, d):
    return graph.external_calls(*_calls(spark, d))


@query(
    "WITH f AS (SELECT n_name || '/' || r_name || '.py' AS target_file, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey), i AS (SELECT s_name AS source, n_name AS module FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT c_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) "
    "SELECT DISTINCT source, target_file, module FROM i JOIN f ON module = r_name OR module = n_name"
)
def import_resolve(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    places = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    files = places.select(F.concat("n_name", F.lit("/"), "r_name", F.lit(".py")).alias("file_path"))
    one = read(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("module"))
    two = read(spark, d, "customer").join(places, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_name").alias("source"), F.col("r_name").alias("module"))
    return graph.resolve_imports(one.unionByName(two), files)


_EDGES = "(SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, CASE WHEN l_partkey % 3 = 0 THEN 'imports' ELSE 'calls' END AS edge_type FROM lineitem)"


def _edges(spark, d):
    line = read(spark, d, "lineitem")
    return line.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.when(F.col("l_partkey") % 3 == 0, "imports").otherwise("calls").alias("edge_type")).distinct()


@query(f"SELECT target AS node_id FROM {_EDGES} WHERE source = 's1' AND edge_type = 'calls'")
def callees(spark, d):
    return graph.callees(_edges(spark, d), "s1")


@query(f"SELECT source AS node_id FROM {_EDGES} WHERE target = 'p1' AND edge_type = 'calls'")
def callers(spark, d):
    return graph.callers(_edges(spark, d), "p1")


@query(f"SELECT * FROM {_EDGES} WHERE source = 's1' UNION ALL SELECT * FROM {_EDGES} WHERE target = 's1'")
def edges_of(spark, d):
    return graph.edges_of(_edges(spark, d), "s1")


@query(f"SELECT edge_type, count(*) AS n_edges FROM {_EDGES} GROUP BY edge_type")
def edge_counts(spark, d):
    return graph.edge_counts(_edges(spark, d))


_WAYS = f"w AS (SELECT source AS a, target AS b FROM {_EDGES} WHERE edge_type = 'calls' UNION SELECT target, source FROM {_EDGES} WHERE edge_type = 'calls'), h1 AS (SELECT DISTINCT a AS seed, b AS node_id FROM w WHERE a IN ('p1', 'p2', 's9'))"


def _seeds(spark):
    return spark.createDataFrame([("p1",), ("p2",), ("s9",), ("nobody",)], "seed string")


@query(f"WITH {_WAYS} SELECT seed, node_id, 1 AS depth FROM h1")
def neighbors_depth1(spark, d):
    return graph.neighbors(_edges(spark, d), _seeds(spark), 1)


@query(f"WITH {_WAYS}, h2 AS (SELECT DISTINCT seed, b AS node_id FROM h1 JOIN w ON a = node_id) SELECT seed, node_id, 1 AS depth FROM h1 UNION ALL SELECT seed, node_id, 2 FROM h2 WHERE node_id <> seed AND (seed, node_id) NOT IN (SELECT (seed, node_id) FROM h1)")
def neighbors_depth2(spark, d):
    return graph.neighbors(_edges(spark, d), _seeds(spark), 2)


@query(
    "WITH e AS (SELECT r_name AS source, n_name AS target FROM nation JOIN region ON r_regionkey = n_regionkey), n AS (SELECT r_name AS node_id FROM region UNION SELECT n_name FROM nation) "
    "SELECT node_id, coalesce((SELECT string_agg(DISTINCT target, ', ' ORDER BY target) FROM e WHERE source = node_id), '(none)') AS calls, coalesce((SELECT string_agg(DISTINCT source, ', ' ORDER BY source) FROM e WHERE target = node_id), '(none)') AS called_by FROM n"
)
def print_summary(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    edges = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"), F.lit("calls").alias("edge_type"))
    nodes = region.select(F.col("r_name").alias("node_id")).union(nation.select("n_name")).distinct().withColumn("node_type", F.lit("function_definition"))
    return graph.summary(nodes, edges)


# ---------------------------------------------------------------- retrieval, answers, evaluation


@query("SELECT user_id, event_type, event_id, value AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def dedup_best(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", F.col("value").alias("score"))
    return retrieval.dedup_best(e, ["user_id", "event_type"], "event_id")


_QUESTION = "How does src3 handle the token of anshe and `those er`?"
_KEYWORDS = ["src3", "handle", "token", "anshe", "er", "those er"]
_SCORE = " + ".join(f"5 * contains(lower(source), '{k}')::INT + 3 * contains(lower({_PATH_SQL}), '{k}')::INT + 2 * contains(lower(text), '{k}')::INT + 2.5 * contains(lower(s), '{k}')::INT" for k in _KEYWORDS)


@query(f"SELECT doc_id, CAST({_SCORE} + CASE WHEN source = 'src3' THEN 10 ELSE 0 END AS DOUBLE) AS score FROM (SELECT *, coalesce(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1], '') AS s FROM documents)")
def rerank_lexical(spark, d):
    r = _files(spark, d).select("doc_id", F.col("source").alias("scope"), F.col("file_path").alias("file"), F.col("text").alias("code"), S.doc_summary("text").alias("summary"), F.lit(_QUESTION).alias("question"))
    return retrieval.rerank_lexical(r).select("doc_id", "score")


@query(
    "WITH w AS (SELECT conv_id, turn, list_concat(list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda x: length(x) > 1 AND NOT list_contains([" + _list(fixed.STOP_WORDS) + "], x)), list_transform(regexp_extract_all(text, '[`\"'']([^`\"'']+)[`\"'']', 1), lambda x: lower(x))) AS l FROM conversations WHERE role = 'user') "
    "SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS keywords FROM w"
)
def keywords(spark, d):
    return read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.array_join(S.keywords("text"), ",").alias("keywords"))


_Q = "lower(trim(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\?+$', ''), ' ' || chr(9) || chr(10) || chr(13)))"
_TYPE = (
    "CASE "
    + " ".join(f"WHEN {' OR '.join(f'starts_with(q, {chr(39)}{s.replace(chr(39), chr(39) * 2)}{chr(39)})' for s in starts)} THEN '{kind}'" for kind, starts in fixed.QUESTION_STARTS)
    + " "
    + " ".join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind}'" for kind, words in fixed.QUESTION_WORDS)
    + " ELSE 'general' END"
)


@query(f"SELECT conv_id, turn, {_TYPE} AS question_type FROM (SELECT *, {_Q} AS q FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'How does ' WHEN 2 THEN 'WHAT IS ' WHEN 4 THEN 'list ' ELSE '' END || text AS text FROM conversations))")
def question_type(spark, d):
    c = read(spark, d, "conversations").withColumn("text", F.concat(F.when(F.col("turn") % 5 == 0, "How does ").when(F.col("turn") % 5 == 2, "WHAT IS ").when(F.col("turn") % 5 == 4, "list ").otherwise(""), "text"))
    return c.select("conv_id", "turn", S.question_type("text").alias("question_type"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def citations_distinct(spark, d):
    said = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("said"))
    return said.select("conv_id", F.array_join(S.distinct_citations(F.transform("said", lambda x: x["role"])), ",").alias("roles"))


@query("SELECT c_nationkey, c_custkey, c_acctbal AS score FROM (SELECT *, max(c_acctbal) OVER (PARTITION BY c_nationkey, c_mktsegment) AS m FROM customer) WHERE c_acctbal > 0 OR m <= 0")
def relevant_only(spark, d):
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("query_id"), F.col("c_acctbal").alias("score"))
    return retrieval.relevant_only(c).drop("query_id")


_EVAL = "SELECT doc_id, CASE WHEN lang = 'es' THEN 1.0 ELSE (source = 'src3' OR lang = 'fr')::INT::DOUBLE END AS retrieval_recall, (contains(lower(text), 'the')::INT + contains(lower(text), 'anshe')::INT + contains(lower(text), 'der')::INT) / 3.0 AS keyword_recall FROM documents"


def _evaluated(spark, d):
    docs = read(spark, d, "documents")
    expected = F.when(F.col("lang") == "es", F.array().cast("array<string>")).when(F.col("lang") == "fr", F.array(F.lit("a/x.py"), F.lit("y.py"))).otherwise(F.array(F.lit("b/src3.py")))
    cited = F.array(F.concat(F.lit("deep/"), "source", F.lit(".py:L1-L2 (f)")), F.lit("z/y.py:L3-L4"))
    return docs.select("doc_id", S.retrieval_recall(expected, cited).alias("retrieval_recall"), S.keyword_recall(F.array(F.lit("THE"), F.lit("anshe"), F.lit("Der")), "text").alias("keyword_recall"))


@query(_EVAL.replace(") / 3.0", ") / 3.0::DOUBLE"))
def recall_per_row(spark, d):
    return _evaluated(spark, d)


@query(f"SELECT count(*) AS n, round(avg(retrieval_recall), 9) AS mean_retrieval_recall, round(avg(keyword_recall), 9) AS mean_keyword_recall FROM ({_EVAL})")
def eval_summary(spark, d):
    return _evaluated(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("retrieval_recall"), 9).alias("mean_retrieval_recall"), F.round(F.avg("keyword_recall"), 9).alias("mean_keyword_recall"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS docstring FROM documents WHERE NOT regexp_matches(text, '\"{3}|''{3}')")
def docstring_in_text(spark, d):
    docs = read(spark, d, "documents").filter(~F.col("text").contains('"""') & ~F.col("text").contains("'''"))
    quote = F.when(F.col("doc_id") % 3 == 0, '"""').when(F.col("doc_id") % 3 == 2, "").otherwise("'''")
    return docs.select("doc_id", S.docstring_in_text(F.concat(F.lit("def f():\n    "), quote, "text", quote, F.lit("\n    return 1\n"))).alias("docstring"))


# ---------------------------------------------------------------- code; SQL has no parser, so these have none

CODE = [
    ("shop/cart.py", "python", 'import math\nfrom shop import prices\n\n\nclass Cart:\n    """Lines of one order."""\n\n    def __init__(self):\n        self.lines = []\n\n    def add(self, item, n=1):\n        """Put n of an item into the cart."""\n        self.lines.append((item, check(n)))\n\n    def total(self):\n        return math.fsum(line_price(i, n) for i, n in self.lines)\n\n\ndef check(n):\n    if n < 1:\n        raise ValueError("none")\n    return n\n\n\ndef line_price(item, n):\n    def rounded(x):\n        return round(x, 2)\n\n    return rounded(prices.of(item) * n)\n'),
    ("shop/prices.py", "python", 'PRICES = {}\n\n\ndef of(item):\n    """Price of an item."""\n    return PRICES.get(item, 0.0)\n'),
    ("web/view.js", "javascript", "import { send } from './bus';\n\n/**\n * Shows a cart.\n */\nexport function show(cart) {\n  return cart.lines.map(l => row(l)).join('');\n}\n\nfunction row(line) {\n  return `<li>${line.name}</li>`;\n}\n\nclass View {\n  constructor(el) { this.el = el; }\n  draw(cart) { this.el.innerHTML = show(cart); send('drawn'); }\n}\n"),
    ("web/bus.ts", "typescript", "export const send = (name: string): void => { deliver(name); };\n\nfunction deliver(name: string): void {\n  console.log(name);\n}\n"),
]


def _code_files(spark):
    return spark.createDataFrame([(p, lang, bytearray(text.encode())) for p, lang, text in CODE], "file_path string, language string, content binary")


def _code(spark):
    from ..operators.parsing import parse_files

    return parse_files(_code_files(spark))


@query()
def chunk_python(spark, d):
    return _code(spark).filter("language = 'python'").drop("calls", "nested", "error")


@query()
def chunk_js(spark, d):
    return _code(spark).filter("language <> 'python'").drop("calls", "nested", "error")


@query()
def call_graph_code(spark, d):
    return graph.build(_code(spark), add_external=True)[1]


@query()
def ask_end_to_end(spark, d):
    """Contexts for two questions over the fixture sources: enrich, embed, nearest chunks, neighbours, selection."""
    chunks = graph.with_node_id(_code(spark)).withColumn("citation", S.citation("file_path", "start_line", "end_line", "qualified_name"))
    text = S.enriched_text("citation", "language", "qualified_name", S.doc_summary("docstring"), "imports", "raw_code")
    chunks = chunks.withColumn("enriched_text", text).withColumn("embedding", S.hash_embedding("enriched_text", 64)).select("chunk_id", "node_id", "file_path", "start_line", "citation", "enriched_text", "embedding")
    asked = spark.createDataFrame([(1, "How does the cart compute its total?"), (2, "Where is a message delivered?")], "query_id int, question string")
    found = retrieval.top_k(chunks, asked.select("query_id", S.hash_embedding("question", 64).alias("query_vector")), 3).withColumn("source", F.lit("vector_search"))
    _, edges = graph.build(_code(spark))
    reach = graph.neighbors(edges, found.select(F.col("node_id").alias("seed")).distinct(), 1)
    more = graph.expand(found.select("query_id", "node_id", "rank", "score"), reach, fixed.EXPANSION_DECAY).join(chunks.drop("embedding"), "node_id").withColumns({"rank": F.lit(1 << 20), "source": F.lit("graph_expansion")})
    return retrieval.context(retrieval.dedup_best(found.unionByName(more.select(*found.columns)), ["query_id", "chunk_id"]), 2000).drop("chosen")


@query()
def answers_offline(spark, d):
    """The offline answer and its keyword recall for each context of ``ask_end_to_end``."""
    import pandas as pd

    from .answers import synthesize

    def answer(batches):
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], "answer": [synthesize(q, c) for q, c in zip(b["question"], b["context_text"], strict=True)]})

    asked = spark.createDataFrame([(1, "How does the cart compute its total?"), (2, "Where is a message delivered?")], "query_id int, question string")
    told = ask_end_to_end(spark, d).join(asked, "query_id").select("query_id", "question", "context_text").mapInPandas(answer, "query_id int, answer string")
    return told.withColumn("keyword_recall", S.keyword_recall(F.array(F.lit("file"), F.lit("code")), "answer"))
