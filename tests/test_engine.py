import json

import pytest

from codequarry.config import Settings
from codequarry.plans import answers
from codequarry.plans.engine import Engine, read_qa, report

PY = '''"""Module."""
import os
from helpers import tool


def greet(name):
    """Say hello to someone.

    More.
    """
    return shout(name)


def shout(text):
    return tool(text).upper()


class Box:
    """Holds things."""

    def put(self, thing):
        import json
        greet(thing)
        self.things.append(thing)

    def get(self):
        return self.put(None)
'''
HELPERS = "def tool(x):\n    return x\n"
JS = """/** Doubles. */
function twice(x) {
  return add(x, x);
}
const add = (a, b) => a + b;
class Bus extends Base {
  constructor() { super(); this.m = new Map(); }
  /**
   * Sends.
   */
  async send(e) { twice(1); this.log(`${e} {`); }
}
import { z } from './lib/z';
"""


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "app.py").write_text(PY)
    (root / "helpers.py").write_text(HELPERS)
    (root / "pkg" / "__init__.py").write_text("def inside():\n    pass\n")
    (root / "pkg" / "bus.js").write_text(JS)
    (root / "node_modules" / "x" / "index.js").write_text("function no() {}\n")
    (root / "package-lock.json").write_text("{}")
    (root / "big.py").write_text("x = 1\n" * 200_000)
    (root / "pic.png").write_bytes(b"\x89PNG")
    (root / ".gitignore").write_text("ignored_*.py\n!ignored_not.py\nsub/\n")
    (root / "ignored_file.py").write_text("def hidden(): pass\n")
    (root / "ignored_not.py").write_text("def shown(): pass\n")
    (root / "pkg" / "ignored_deep.py").write_text("def deep(): pass\n")
    (root / "sub").mkdir()
    (root / "sub" / "a.py").write_text("def sub(): pass\n")
    return root


def engine_for(spark, tmp_path, **more):
    return Engine(spark, Settings(store_path=str(tmp_path / "store"), embedding_dim=32, store_buckets=4, **more))


def test_scan(spark, tree):
    from codequarry.sources.files import scan_counts, scan_files

    found = {r["relative_path"]: r["language"] for r in scan_files(spark, str(tree)).collect()}
    assert found == {"app.py": "python", "helpers.py": "python", "pkg/__init__.py": "python", "pkg/bus.js": "javascript", "ignored_not.py": "python"}
    assert set(r["relative_path"] for r in scan_files(spark, str(tree), ["JavaScript"]).collect()) == {"pkg/bus.js"}
    flat = {r["relative_path"] for r in scan_files(spark, str(tree), cascade=False).collect()}
    assert "pkg/ignored_deep.py" in flat and "ignored_file.py" not in flat
    c = scan_counts(spark, str(tree)).first()
    assert c["yielded"] == 5 and c["visited"] == c["skipped"] + 5


def test_index_ask_update(spark, tree, tmp_path):
    e = engine_for(spark, tmp_path)
    assert not e.status()["indexed"]
    stats = e.index(str(tree))
    assert (stats.files_processed, stats.files_skipped, stats.files_failed) == (5, 0, 0)
    assert e.status()["chunks"] == stats.chunks_indexed == e.store.count()
    names = {(r["class_name"], r["function_name"]) for r in e.store.read().collect()}
    assert {("Box", "put"), (None, "greet"), ("Bus", "send"), (None, "twice"), (None, "inside")} <= names
    _, edges = e.graph_tables()
    pairs = {(r["source"], r["target"], r["edge_type"]) for r in edges.collect()}
    assert ("app.py::greet", "app.py::shout", "calls") in pairs and ("app.py::Box.put", "app.py::greet", "calls") in pairs
    assert ("app.py::shout", "helpers.py::tool", "imports") in pairs
    assert ("pkg/bus.js::Bus.send", "pkg/bus.js::twice", "calls") in pairs

    a = e.ask("How does greet work?")
    assert a.citations and "greet" in a.answer and a.provider == "offline" and a.formatted().count("Sources:") == 1
    again = e.index(str(tree))
    assert (again.files_processed, again.files_skipped, again.chunks_indexed) == (0, 5, 0)

    (tree / "helpers.py").write_text("def other(x):\n    return x\n")
    (tree / "pkg" / "bus.js").unlink()
    third = e.index(str(tree))
    assert (third.files_processed, third.files_skipped, third.files_deleted) == (1, 3, 1)
    left = {r["function_name"] for r in e.store.read().collect()}
    assert "other" in left and "tool" not in left and "twice" not in left
    full = e.index(str(tree), incremental_run=False)
    assert full.files_processed == 4 and e.store.count() == full.chunks_indexed
    with pytest.raises(ValueError):
        e.ask("")
    with pytest.raises(ValueError):
        e.index("no/such/path")
    job = e.submit_index(str(tree))
    while e.progress(job)["status"] in ("started", "running"):
        pass
    assert e.progress(job)["status"] == "done"


def test_summaries_are_kept(spark, tree, tmp_path):
    from pyspark.sql import functions as F

    for told, want in (("made up", "made up"), ("other", "made up")):
        e = Engine(spark, Settings(store_path=str(tmp_path / "store"), embedding_dim=8, store_buckets=2), docgen=lambda df, told=told: F.lit(told))
        e.index(str(tree), incremental_run=False)
        got = {r["function_name"]: r["summary"] for r in e.store.read().collect()}
        assert got["shout"] == want and got["greet"] == "Say hello to someone."
        assert e.store.get_by_id(e.store.read().first()["chunk_id"]).filter("enriched_text like '%[Summary]: %'").count() == 1


def test_evaluate(spark, tree, tmp_path):
    e = engine_for(spark, tmp_path, top_k=20)
    e.index(str(tree))
    qa = tmp_path / "qa.json"
    qa.write_text(json.dumps([{"id": "a", "question": "What does greet do?", "expected_chunks": ["app.py"], "expected_keywords": ["greet"]}, {"id": "b", "question": "Where is twice?", "expected_chunks": ["pkg/bus.js:L1"]}]))
    rows, summary = e.evaluate(read_qa(spark, str(qa)))
    s = summary.first()
    assert s["n"] == 2 and s["n_errors"] == 0 and s["mean_retrieval_recall"] == 1.0 and s["mean_keyword_recall"] == 1.0
    assert "# Evaluation report" in report(rows, summary)


def test_answers():
    assert answers.generate("q", "", [], answers.OfflineClient()).citations == []

    class Broken:
        provider, model = "x", "y"

        def chat(self, *a, **k):
            raise OSError("down")

    a = answers.generate("q", "c", ["f:L1", "f:L1"], Broken())
    assert a.answer == "Error generating answer: down" and a.citations == ["f:L1", "f:L1"]
    sent = {}
    c = answers.HttpClient("anthropic", "m", "k", send=lambda url, headers, body: sent.update(url=url, **body) or {"content": [{"text": "hi "}], "usage": {"input_tokens": 3, "output_tokens": 2}})
    b = answers.generate("q", "c", ["f:L1", "f:L1"], c)
    assert b.answer == "hi" and b.citations == ["f:L1"] and b.usage.total_tokens == 5 and sent["url"].endswith("/messages")
    c = answers.HttpClient("openai", "m", "k", send=lambda *a: {"choices": [{"message": {"content": "yo"}}]})
    assert answers.generate("q", "c", ["f"], c).answer == "yo"
    with pytest.raises(ValueError):
        answers.client("openai")
    with pytest.raises(ValueError):
        answers.client("voyage")
    text = "--- [1/2] a.py:L1-L2 (f) (score=0.5, source=vector_search) ---\n[File]: a.py:L1-L2 (f)\n[Language]: python\n[Scope]: f\n\n[Code]:\ndef f():\n    return 1\n\n--- [2/2] b.py:L1-L2 (g) (score=0.4, source=vector_search) ---\n[File]: b.py:L1-L2 (g)\n[Scope]: g\n[Summary]: Does g.\n\n[Code]:\ndef g(): f()"
    blocks = answers.parse_blocks(text)
    assert [b["scope"] for b in blocks] == ["f", "g"] and blocks[1]["summary"] == "Does g." and blocks[0]["code"] == "def f():\n    return 1"
    out = answers.synthesize("How does f work?", text)
    assert out.startswith("How it works can be followed in f.\n") and "| f | a.py:L1-L2 (f) |  | def f(): |" in out and "def f():\n    return 1" in out
    every = answers.synthesize("zzz?", text)
    assert every.startswith("The question touches g, f.") or every.startswith("The question touches f, g.")
    assert "| g | b.py:L1-L2 (g) |  | Does g. |" in every and "Among these, g calls f." in every


def test_stream(spark, tmp_path):
    from codequarry.streaming.incremental import index_stream

    e = engine_for(spark, tmp_path)
    schema = "file_path string, language string, content binary, version long"
    rows = [("a.py", "python", bytearray(b"def f():\n    pass\n"), 1), ("a.py", "python", bytearray(b"def g():\n    pass\n"), 2), ("b.py", "python", bytearray(HELPERS.encode()), 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    versions = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    index_stream(e, versions, str(tmp_path / "check")).awaitTermination()
    assert {r["function_name"] for r in e.store.read().collect()} == {"g", "tool"}
    spark.createDataFrame([("b.py", "python", None, 3)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    index_stream(e, versions, str(tmp_path / "check")).awaitTermination()
    assert {r["function_name"] for r in e.store.read().collect()} == {"g"} and e.status()["files"] == 1


def test_cli(spark, tree, tmp_path, monkeypatch):
    from codequarry.cli import main

    monkeypatch.setenv("CODEQUARRY_STORE_PATH", str(tmp_path / "s"))
    monkeypatch.setenv("CODEQUARRY_STORE_BUCKETS", "4")
    said = []
    assert main(["ask", "What?"], spark, said.append) == 1
    assert main(["index", str(tmp_path / "nowhere")], spark, said.append) == 1
    assert main(["index", str(tree)], spark, said.append) == 0
    assert main(["ask", "What does greet do?", "--no-graph"], spark, said.append) == 0
    assert main(["status"], spark, said.append) == 0 and "files         5" in said[-1]
