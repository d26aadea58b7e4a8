import random

import pytest
from pyspark.sql import functions as F

from codequarry import config
from codequarry.functions import scalars as S
from codequarry.operators import graph, retrieval
from codequarry.operators.parsing import EXTRACTORS, chunk_rows, clean_python_docstring, count_tokens, parse_files, parse_javascript, parse_python, parse_typescript, split_lines
from codequarry.sources.files import ignore_regex, is_ignored
from codequarry.sources.repo import resolve
from codequarry.sources.store import ChunkStore


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_splitter_properties():
    rng = random.Random(4)
    for _ in range(300):
        lines = ["x" * rng.choice([0, 3, 40, 400, 4000]) for _ in range(rng.randrange(1, 60))]
        parts = split_lines("\n".join(lines), 512, rng.choice([0, 8, 64]))
        starts = [a for _, a in parts]
        assert starts == sorted(set(starts)) and starts[0] == 0
        covered = set()
        for text, a in parts:
            n = text.count("\n") + 1
            assert text == "\n".join(lines[a : a + n])
            assert n == 1 or sum(count_tokens(x + "\n") for x in lines[a : a + n]) <= 512
            covered |= set(range(a, a + n))
        assert covered == set(range(len(lines)))
    assert len(split_lines("x" * 10_004, 50, 8)) == 1
    parts = split_lines("\n".join(f"line number {k}" for k in range(80)), 50, 15)
    for (a, x), (_, y) in zip(parts, parts[1:]):
        tail = a.split("\n")[y - x :]
        assert sum(count_tokens(t + "\n") for t in tail) >= 15


def test_python_parsing():
    source = '@dec\nasync def a(x):\n    r"""raw"""\n    def inner():\n        return b(c(x)).d()\n    return inner\n\nclass K:\n    \'one\'\n    if True:\n        def m(self):\n            """Doc\n            two"""\n'
    p = parse_python(source)
    got = [(d.node_type, d.name, d.start_line, d.end_line, d.class_name, d.nested) for d in p.definitions]
    assert got == [("function_definition", "a", 1, 6, None, False), ("function_definition", "inner", 4, 5, None, True), ("class_definition", "K", 8, 13, None, False), ("function_definition", "m", 11, 13, "K", False)]
    assert p.definitions[0].docstring == 'r"""raw"""' and p.definitions[2].docstring == "one" and p.definitions[1].calls == ["d", "b", "c"]
    assert clean_python_docstring('"""A\n   b"""') == "A\n   b"
    broken = parse_python("def foo(\n    # unclosed\n")
    assert broken.parse_errors and [d.name for d in broken.definitions] == ["foo"]
    assert chunk_rows("a.rs", "rust", b"fn main() {}") == [] and chunk_rows("a.py", "python", b"") == []
    assert {r["function_name"] for r in chunk_rows("a.py", "python", source.encode(), include_nested=False)} == {"a", "K", "m"}
    long = "def f():\n" + "".join(f"    v{k} = {k}\n" for k in range(200))
    rows = chunk_rows("a.py", "python", long.encode(), 60, 10)
    assert len(rows) >= 2 and [r["split_index"] for r in rows] == list(range(len(rows))) and {r["total_splits"] for r in rows} == {len(rows)} and len({r["chunk_id"] for r in rows}) == len(rows)


def test_javascript_parsing():
    source = """/** one */
export function* gen(a) { yield call(a); }
const o = { short() { return 1; }, f: function () {}, g: async (x) => { await go(x); } };
class A { static #p = 1; get v() { return `a${ {b: 1}.b }`; } 'quoted'(x) { if (x) { y(); } } }
/**
 * Two.
 * lines
 */
async function last(q) { const r = /[/{]\\//.test(q) ? q / 2 / 3 : new Map(); return x => x.map(z => z + 1); }
"""
    p = parse_javascript(source)
    got = [(d.node_type, d.name, d.class_name) for d in p.definitions]
    assert not p.parse_errors
    assert got == [
        ("generator_function_declaration", "gen", None), ("method_definition", "short", None), ("function_expression", None, None), ("arrow_function", None, None), ("class_definition", "A", None),
        ("method_definition", "v", "A"), ("method_definition", "quoted", "A"), ("function_declaration", "last", None), ("arrow_function", "x", None), ("arrow_function", "z", None),
    ]
    assert p.definitions[7].docstring == "Two.\nlines" and p.definitions[0].docstring == "/** one */" and p.definitions[7].calls == ["test", "Map", "map"]
    ts = parse_typescript("class T { private go(a: number): Map<string, number> { return this.run(a); } }\nexport const f = (a: string): string => a.trim();\nimport type { X } from './x'\n")
    assert [(d.node_type, d.name) for d in ts.definitions] == [("class_definition", "T"), ("method_definition", "go"), ("arrow_function", None)] and ts.imports == ["import type { X } from './x'"]
    assert parse_javascript("function f( {").parse_errors


def test_parse_files_isolates_failures(spark, monkeypatch):
    rows = [("a.py", "python", bytearray(b"def a(): pass\n")), ("n.py", "python", None), ("x.rs", "rust", bytearray(b"fn x() {}"))]
    got = parse_files(spark.createDataFrame(rows, "file_path string, language string, content binary")).collect()
    assert [r["function_name"] for r in got] == ["a"] and got[0]["split_index"] is None and got[0]["error"] is None
    assert set(EXTRACTORS) >= {"python", "javascript", "js", "typescript", "tsx"}


def test_scores_are_written_by_their_binary_value(spark):
    import random

    rng = random.Random(3)
    said = [0.4165, 0.5105, 0.0625, 0.1875, -0.0625, 0.0005, 0.9995, 0.99951, 1.0, -0.0, -0.0001, 5e-324, 123456.0005, 4503599627370495.5, 9007199254740993.0, *(round(rng.uniform(-2, 2), 4) for _ in range(3000)), *(rng.randrange(-(10**7), 10**7) / 16 for _ in range(500)), *(rng.gauss(0, 1) for _ in range(500))]
    rows = spark.createDataFrame([(x,) for x in said], "x double")
    assert [r["t"] for r in rows.select(S.three_decimals("x").alias("t")).collect()] == [f"{x:.3f}" for x in said]
    assert one(spark, S.block_header(F.lit(1), F.lit(2), F.lit("f"), F.lit(0.4165), F.lit("s"))) == "--- [1/2] f (score=0.416, source=s) ---"


def test_docstrings_that_end_with_a_quote(spark):
    for text in ('the "end"', "the 'end'", '"', '""', "''", 'a ""', '"a', ""):
        for quote in ('"""', "'''"):
            assert one(spark, S.docstring_in_text(F.lit(f"def f():\n    {quote}{text}{quote}\n    return 1\n"))) == text, (text, quote)
    assert one(spark, S.docstring_in_text(F.lit('def f():\n    """a""""b"\n    x = """c"""\n'))) == "a"
    assert one(spark, S.docstring_in_text(F.lit('"""one""""'))) == 'one"' and one(spark, S.docstring_in_text(F.lit('"""open'))) is None


def test_gitignore():
    def rules(text, base=""):
        return [("-" if p[1] else "+") + ("d" if p[2] else "a") + p[0] for p in (ignore_regex(x, base) for x in text.split("\n")) if p]

    r = rules("# c\n\n*.log\n!keep.log\n/top.py\nbuild/\ndocs/**/x.md\na/**\n[ab]?.py\n")
    assert is_ignored("deep/x.log", False, r) and not is_ignored("deep/keep.log", False, r) and is_ignored("top.py", False, r) and not is_ignored("d/top.py", False, r)
    assert is_ignored("d/build", True, r) and not is_ignored("d/build", False, r) and is_ignored("docs/a/b/x.md", False, r) and is_ignored("a/b/c", False, r) and is_ignored("q/a1.py", False, r)
    assert is_ignored("sub/z.txt", False, rules("/z.txt", "sub")) and not is_ignored("z.txt", False, rules("/z.txt", "sub"))


def test_scalars(spark):
    assert one(spark, S.chunk_id(F.lit("sample.py"), F.lit("function_definition"), F.lit(20), F.lit("greet"))) == "949c9dc4ac3978a5"
    assert one(spark, S.count_tokens(F.lit(""))) == 1 and one(spark, S.line_count(F.lit("a\n\nb\n"))) == 4
    assert one(spark, S.strip(F.lit("\t\u00a0 a b\n\u2003"))) == "a b"
    assert one(spark, S.docstring_in_text(F.lit('x """ doc """ y'))) == "doc"
    assert one(spark, S.extension(F.lit("a/.gitignore"))) == "" and one(spark, S.extension(F.lit("a/b.tar.GZ"))) == ".gz"
    v = one(spark, S.hash_embedding(F.lit("x"), 12))
    assert len(v) == 12 and abs(sum(x * x for x in v) - 1) < 1e-12 and v[0] == v[8]
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, S.user_prompt(F.lit(""), F.lit("q"))) == "## Code Context\n\n(no code context available)\n\n---\n\n## Question\n\nq\n"
    for q, kind in (("How does x work?", "how"), ("what's up", "what"), ("Compare a and b", "compare"), ("the purpose of x", "purpose"), ("fix it", "debug"), ("hello", "general")):
        assert one(spark, S.question_type(F.lit(q))) == kind


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "imports"), ("x", "x", "calls")], "source string, target string, edge_type string")
    reach = lambda depth, types=None: {(r["node_id"], r["depth"]) for r in graph.neighbors(edges, spark.createDataFrame([("a",)], "seed string"), depth, types).collect()}
    assert reach(0) == set() and reach(1) == {("b", 1)} and reach(3) == {("b", 1), ("c", 2)} and reach(5, ["calls", "imports"]) == {("b", 1), ("c", 2), ("d", 3)}
    assert graph.edges_of(edges, "x").count() == 2 and graph.callers(edges, "b").count() == 1
    ranked = spark.createDataFrame([(1, "a", 1, 0.9), (1, "c", 2, 0.5)], "query_id int, node_id string, rank int, score double")
    near = graph.neighbors(edges, ranked.select(F.col("node_id").alias("seed")), 2)
    got = {(r["node_id"], round(r["score"], 6)) for r in graph.expand(ranked, near, 0.7).collect()}
    assert got == {("b", 0.63)}


def test_external_nodes(spark, tmp_path):
    rows = parse_files(spark.createDataFrame([("a.py", "python", bytearray(b"def f():\n    print(g())\n\ndef g():\n    f()\n"))], "file_path string, language string, content binary"))
    nodes, edges = graph.build(rows, add_external=True)
    assert {(r["source"], r["target"], r["is_resolved"]) for r in edges.collect()} == {("a.py::f", "a.py::g", True), ("a.py::g", "a.py::f", True), ("a.py::f", "external::print", False)}
    assert nodes.filter("node_type = 'external'").count() == 1
    graph.write_json(nodes, edges, str(tmp_path / "g"))
    again = graph.read_json(spark, str(tmp_path / "g"))
    for df, back in zip((nodes, edges), again):
        assert sorted(map(repr, df.collect())) == sorted(repr(r) for r in back.select(*df.columns).collect())


def test_select_within(spark):
    def pick(costs, budget):
        items = F.array(*(F.struct(F.lit(c).alias("tokens"), F.lit(k).alias("k")) for k, c in enumerate(costs)))
        return [x["k"] for x in one(spark, retrieval.select_within(items, budget, 0))]

    assert pick([40, 80, 30], 75) == [0, 2] and pick([100, 200], 50) == [0] and pick([10], 10) == [0]


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), "chunk_id string, file_path string, embedding array<double>", buckets=3)
    assert store.count() == 0 and store.query([1.0], 3).count() == 0
    rows = spark.createDataFrame([("1", "a", [1.0, 0.0]), ("2", "a", [0.0, 1.0]), ("3", "b", [1.0, 1.0])], "chunk_id string, file_path string, embedding array<double>")
    store.upsert(rows), store.upsert(rows)
    assert store.count() == 3 and [r["chunk_id"] for r in store.query([1.0, 0.1], 2).collect()] == ["1", "3"]
    assert [r["chunk_id"] for r in store.query([1.0, 0.1], 5, {"file_path": "b"}).collect()] == ["3"]
    store.upsert(spark.createDataFrame([("3", "b", [9.0, 9.0])], rows.schema))
    assert store.get_by_id("3").first()["embedding"] == [9.0, 9.0] and {r["chunk_id"] for r in store.file_chunk_ids("a").collect()} == {"1", "2"}
    store.delete(spark.createDataFrame([("b",)], "file_path string"), by="file_path")
    assert store.count() == 2
    store.upsert(rows.limit(0)), store.clear()
    assert store.count() == 0


def test_config_and_source(tmp_path):
    s = config.load(environ={"CODEQUARRY_TOP_K": "3", "CODEQUARRY_LANGUAGES": "Python, Go", "CODEQUARRY_LOG_LEVEL": "debug", "CODEQUARRY_RERANKING_ENABLED": "true"}, env_file=str(tmp_path / "none"))
    assert (s.top_k, s.languages, s.log_level, s.reranking_enabled) == (3, ["python", "go"], "DEBUG", True)
    keys = config.load(environ={"OPENAI_API_KEY": "k", "CODEQUARRY_LLM_PROVIDER": "openai"}, env_file=str(tmp_path / "none"))
    assert keys.api_key() == "k" and keys.api_key("ollama") == ""
    for bad in ({"top_k": 0}, {"log_level": "loud"}, {"metric": "dot"}):
        with pytest.raises(ValueError):
            config.Settings(**bad)

    class Done:
        returncode, stderr = 1, b"no"

    with pytest.raises(RuntimeError):
        resolve("https://github.com/o/r.git", str(tmp_path), run=lambda *a, **k: Done)
    with pytest.raises(ValueError):
        resolve("nothing here")
    (tmp_path / "o__r").mkdir()
    assert resolve("https://github.com/o/r", str(tmp_path), run=lambda *a, **k: Done).name == "o__r"


def test_extractor_by_name():
    import pytest
    from codequarry.operators.parsing import extractor, parse_python

    assert extractor("Python") is parse_python
    with pytest.raises(ValueError, match="no parser for 'cobol'"):
        extractor("cobol")
