"""Call and import graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas, scratch
from ..functions import scalars as S


def with_node_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("qualified_name", S.qualified_name("class_name", "function_name")).withColumn("node_id", S.node_id("file_path", "qualified_name"))


def nodes_of(chunks: DataFrame) -> DataFrame:
    """One row for each node; the slices of a definition and definitions of one name share it. Attributes are those of the first chunk."""
    first = with_node_id(chunks).groupBy("node_id").agg(F.min_by(F.struct("chunk_id", "file_path", "qualified_name", "language", "node_type", "start_line", "end_line"), F.struct("start_line", "chunk_id")).alias("x"))
    return first.select("node_id", "x.*")


def name_index(chunks: DataFrame) -> DataFrame:
    """file_path, name, node_id: a node under its qualified and its bare name."""
    return with_node_id(chunks).select("file_path", F.explode(F.array_distinct(F.array_compact(F.array("qualified_name", "function_name")))).alias("name"), "node_id").distinct()


def resolve_calls(calls: DataFrame, index: DataFrame) -> DataFrame:
    """Edges from calls (source, file_path, call_name, ordinal) to nodes of the same file and name: no self edges, one for each pair, the first call's name stays."""
    hits = calls.join(index.select("file_path", F.col("name").alias("call_name"), F.col("node_id").alias("target")), ["file_path", "call_name"]).filter("source <> target")
    return hits.groupBy("source", "target").agg(F.min_by("call_name", F.struct("ordinal", "call_name")).alias("call_name"))


def external_calls(calls: DataFrame, index: DataFrame) -> DataFrame:
    """Edges to ``external::name`` for calls that name nothing in their file."""
    miss = calls.join(index.select("file_path", F.col("name").alias("call_name")).distinct(), ["file_path", "call_name"], "left_anti")
    return miss.select("source", F.concat(F.lit("external::"), "call_name").alias("target"), "call_name").distinct()


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target_file, module) for imports (source, module): files (file_path) whose stem is the module or whose first folder it is. Both are equal joins."""
    by = files.select("file_path", F.explode(F.array_distinct(F.array(S.file_stem("file_path"), F.split("file_path", "/")[0]))).alias("module")).distinct()
    return imports.select("source", "module").distinct().join(by, "module").select("source", F.col("file_path").alias("target_file"), "module")


def build(chunks: DataFrame, add_external: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chunks that carry ``calls`` and ``imports``. A pair that calls is not joined by an import as well."""
    known = with_node_id(chunks)
    calls = known.select(F.col("node_id").alias("source"), "file_path", F.posexplode("calls").alias("ordinal", "call_name"))
    index = name_index(chunks)
    resolved = resolve_calls(calls, index).select("source", "target", F.lit("calls").alias("edge_type"), "call_name", F.lit(True).alias("is_resolved"))
    statements = known.select(F.col("node_id").alias("source"), "language", F.explode("imports").alias("statement"))
    modules = statements.select("source", S.import_module("statement", "language").alias("module")).filter("module is not null")
    files = known.select("file_path").distinct()
    members = known.select(F.col("file_path").alias("target_file"), F.col("node_id").alias("target")).distinct()
    imported = resolve_imports(modules, files).join(members, "target_file").filter("source <> target").groupBy("source", "target").agg(F.min("module").alias("call_name"))
    imported = imported.join(resolved, ["source", "target"], "left_anti").select("source", "target", F.lit("imports").alias("edge_type"), "call_name", F.lit(True).alias("is_resolved"))
    nodes, edges = nodes_of(chunks), resolved.unionByName(imported)
    if add_external:
        outside = external_calls(calls, index)
        edges = edges.unionByName(outside.select("source", "target", F.lit("calls").alias("edge_type"), "call_name", F.lit(False).alias("is_resolved")))
        names = outside.select(F.col("target").alias("node_id"), F.lit("").alias("chunk_id"), F.lit("").alias("file_path"), F.col("call_name").alias("qualified_name"), F.lit(None).cast("string").alias("language"), F.lit("external").alias("node_type"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
        nodes = nodes.unionByName(names.distinct())
    return nodes, edges


def callees(edges: DataFrame, node, types: list[str] | None = None) -> DataFrame:
    return edges.filter((F.col("source") == node) & F.col("edge_type").isin(types or ["calls"])).select(F.col("target").alias("node_id")).distinct()


def callers(edges: DataFrame, node, types: list[str] | None = None) -> DataFrame:
    return edges.filter((F.col("target") == node) & F.col("edge_type").isin(types or ["calls"])).select(F.col("source").alias("node_id")).distinct()


def edges_of(edges: DataFrame, node) -> DataFrame:
    """All edges at a node, both ways; a loop is there twice."""
    return edges.filter(F.col("source") == node).unionAll(edges.filter(F.col("target") == node))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n_edges"))


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """(seed, node_id, depth): nodes within ``depth`` steps of each seed either way, without the seed itself.

    Seeds go together, a round for each step. A round joins the frontier with
    the edges and takes away what was seen; it is stored, so that lineage
    doesn't grow.
    """
    spark = edges.sparkSession
    work = scratch.folder(spark)
    used = edges.filter(F.col("edge_type").isin(types or ["calls"]))
    ways = used.select(F.col("source").alias("node_id"), F.col("target").alias("next")).unionByName(used.select(F.col("target").alias("node_id"), F.col("source").alias("next"))).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for step in range(1, depth + 1):
        reached = frontier.join(ways, "node_id").select("seed", F.col("next").alias("node_id")).distinct()
        frontier = scratch.stored(reached.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti").withColumn("depth", F.lit(step)), f"{work}/{step}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def in_order(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """What ``neighbors`` found with the nodes' columns, in the order of seed, file and line; nodes that stand for no chunk are left out."""
    return reach.join(nodes, "node_id").orderBy("seed", "file_path", "start_line", "node_id")


def expand(ranked: DataFrame, reach: DataFrame, decay: float, per_hop: bool = False) -> DataFrame:
    """(query_id, node_id, score): unseen neighbours of ranked results (query_id, node_id, rank, score), each from its best-ranked seed, whose score it has times ``decay`` (for every hop if per_hop)."""
    pairs = ranked.select("query_id", F.col("node_id").alias("seed"), "rank", "score").join(reach, "seed").join(ranked.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    factor = F.pow(F.lit(decay), F.col("depth")) if per_hop else F.lit(decay)
    return pairs.groupBy("query_id", "node_id").agg(F.min_by(F.col("score") * factor, F.struct("rank", "depth")).alias("score"))


def summary(nodes: DataFrame, edges: DataFrame, file_path: str | None = None) -> DataFrame:
    """node_id, calls, called_by: neighbours' names, sorted and joined, or (none); external nodes are left out, and with ``file_path`` the nodes of other files."""
    inside = edges.filter("edge_type = 'calls'").join(nodes.filter("node_type <> 'external'").select(F.col("node_id").alias("target")), "target")
    text = lambda c: F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ", "), F.lit("")), F.lit("(none)"))
    out = inside.groupBy(F.col("source").alias("node_id")).agg(text("target").alias("calls"))
    back = inside.groupBy(F.col("target").alias("node_id")).agg(text("source").alias("called_by"))
    shown = nodes.filter(F.col("file_path") == file_path) if file_path is not None else nodes
    return shown.filter("node_type <> 'external'").select("node_id").join(out, "node_id", "left").join(back, "node_id", "left").fillna("(none)").orderBy("node_id")


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as JSON lines: nodes and links, each with all its fields."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def read_json(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as ``write_json`` left them."""
    return spark.read.schema(schemas.NODES).json(f"{path}/nodes"), spark.read.schema(schemas.EDGES).json(f"{path}/links")
