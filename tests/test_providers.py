"""Embedders, rerankers, stores by name, the HTTP API, and bounds that must not drop anything."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.config import Settings
from codequarry.functions import embedders
from codequarry.functions import scalars as S
from codequarry.operators import graph, reranking, retrieval
from codequarry.plans.engine import Engine
from codequarry.sources import store


def lengths():
    class Lengths:  # local, so that it is pickled whole
        name = "lengths"

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    return Lengths()


def test_embedders(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, t string")
    got = {r["id"]: r["v"] for r in texts.select("id", embedders.column_of(lengths(), 1)(F.col("t")).alias("v")).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    asked = []
    remote = embedders.RemoteModel("m", "k", "http://x/v1/", send=lambda url, headers, body: asked.append((url, headers, body)) or {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert remote.embed(["a", "b"]) == [[1.0], [2.0]] and asked[0][0] == "http://x/v1/embeddings" and asked[0][2] == {"model": "m", "input": ["a", "b"]}
    for bad in (("voyage",), ("openai",)):
        with pytest.raises(ValueError):
            embedders.embedder(*bad)
    v = texts.select(embedders.embedder("mock", dim=20)(F.col("t")).alias("v")).filter("v is not null").first()["v"]
    assert len(v) == 20 and abs(sum(x * x for x in v) - 1) < 1e-12 and v[:4] == v[8:12]


def test_rerankers(spark):
    rows = spark.createDataFrame([("q", "long text", 0.1), ("q", "x", 0.9)], "question string, enriched_text string, score double")
    got = reranking.rerank_by_model(rows, "m", lambda name: lambda pairs: [len(t) for _, t in pairs]).collect()
    assert {r["enriched_text"]: r["score"] for r in got} == {"long text": 9.0, "x": 1.0}
    assert reranking.reranker(False) is None and reranking.reranker(True) is retrieval.rerank_lexical


def test_stores_by_name(spark):
    held = store.open_store("ephemeral", spark, "", "chunk_id string, file_path string, embedding array<double>", buckets=2)
    held.upsert(spark.createDataFrame([("a", "f", [1.0, 0.0]), ("b", "f", [0.0, 1.0])], held.schema))
    assert held.count() == 2 and held.query([1.0, 0.1], 1).first()["chunk_id"] == "a"
    with pytest.raises(ValueError):
        store.open_store("chroma", spark, "", "chunk_id string")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_top_k(spark, monkeypatch, metric):
    """Against all scores; ties, other lengths, nulls and zero vectors; one block and several."""
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(f"k{k:03}", v.tolist(), k) for k, v in enumerate(x)] + [("n1", None, 0), ("n2", [1.0], 0), ("n3", [None, 1.0, 1.0, 1.0], 0), ("n4", [float("nan")] * 4, 0)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, other int")
    asked = [(q, x[q].tolist()) for q in range(0, 300, 30)] + [(1000, None), (1001, [0.0] * 4)]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    want = {}
    for q, v in asked:
        if v is None or (metric == "cosine" and not any(v)):
            continue
        v = np.array(v)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = x @ v / (np.linalg.norm(x, axis=1) * np.linalg.norm(v)) if metric == "cosine" else 1 - ((x - v) ** 2).sum(1)
        found = sorted((-round(float(s), 9), f"k{k:03}") for k, s in enumerate(score) if s == s)[:7]
        want[q] = [(name, -s) for s, name in found]
    for block in (32 << 20, 64):
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", block)
        got = {}
        for r in retrieval.top_k(df, queries, 7, metric=metric, digits=9).orderBy("query_id", "rank").collect():
            assert r["other"] == int(r["chunk_id"][1:])
            got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
        assert {q: [n for n, _ in v] for q, v in got.items()} == {q: [n for n, _ in v] for q, v in want.items()}
        assert all(abs(a[1] - b[1]) < 1e-8 for q in want for a, b in zip(got[q], want[q], strict=True))
    assert retrieval.top_k(df, queries.limit(0), 3).collect() == [] and retrieval.top_k(df.limit(0), queries, 3).collect() == []


def test_long_blanks_are_stripped_in_time(spark):
    text = " " * 1_000_000
    rows = spark.createDataFrame([(f"{text}\n a{text}b \n\x1c ", f"{text}x{text}")], "a string, b string")
    r = rows.select(S.doc_summary("a").alias("a"), S.strip("b").alias("b"), F.length(S.strip(F.concat("a", F.lit("c")))).alias("n")).first()
    assert r["a"] == f"a{text}b" and r["b"] == "x"
    assert S.WHITE_SPACE == "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def test_neighbours_in_order(spark):
    nodes = spark.createDataFrame([("a", "z.py", 1, "function_definition"), ("b", "y.py", 9, "function_definition"), ("c", "y.py", 2, "function_definition"), ("external::x", "", 0, "external")], "node_id string, file_path string, start_line int, node_type string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("c", "a", "calls"), ("a", "gone", "calls")], "source string, target string, edge_type string")
    reach = graph.neighbors(edges, spark.createDataFrame([("a",)], "seed string"), 1)
    assert [r["node_id"] for r in graph.in_order(reach, nodes).collect()] == ["c", "b"]
    assert [(r["node_id"], r["calls"]) for r in graph.summary(nodes, edges, "y.py").collect()] == [("b", "(none)"), ("c", "a")]


def test_template_literals_and_long_types():
    from codequarry.operators.parsing import parse_javascript, parse_typescript

    p = parse_javascript("function row(l) { return `<li>${name(l, {a: `${deep(1)}`})} and ${x}</li>`; }\nfunction b() { return `}${`; }")
    assert p.definitions[0].calls == ["name", "deep"] and p.parse_errors
    types = " | ".join(f"Type{k}" for k in range(200))
    p = parse_typescript(f"const f = (a: string): {types} => {{ go(a); }};\nfunction g<{', '.join(f'T{k} extends Foo<number>' for k in range(300))}>(x: T1): void {{ run(x); }}\n")
    assert [(d.name, d.calls) for d in p.definitions] == [(None, ["go"]), ("g", ["run"])] and p.definitions[0].text.startswith("(a: string)")


def test_server(spark, tmp_path):
    from codequarry.server import server

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text('def greet(name):\n    """Greets."""\n    return name\n')
    engine = Engine(spark, Settings(store_path=str(tmp_path / "s"), store_buckets=2, llm_provider="offline"))
    running = server(engine, port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{running.server_address[1]}/api/"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode() if body is not None else None)) as reply:
                return reply.status, json.load(reply)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("status")[1]["indexed"] is False and call("ask", {"question": "What?"})[0] == 400 and call("nothing")[0] == 404 and call("index", {})[0] == 422 and call("index/progress/x")[0] == 404
    code, job = call("index", {"repo": str(tmp_path / "src")})
    assert code == 202
    for _ in range(600):
        state = call(f"index/progress/{job['job_id']}")[1]
        if state["status"] in ("done", "error"):
            break
        threading.Event().wait(0.2)
    assert state["status"] == "done" and state["stats"]["chunks_indexed"] == 1
    assert call("status")[1]["graph_present"] is True
    code, told = call("ask", {"question": "What does greet do?", "provider": "openai"})
    assert code == 200 and told["offline_mode"] and told["citations"] == ["a.py:L1-L3 (greet)"] and "Greets." in told["answer"]
    assert call("ask", {"question": "x" * 3000})[0] == 422
    running.shutdown()
