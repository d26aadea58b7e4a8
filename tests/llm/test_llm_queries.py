"""The registered queries and the pipeline on the smallest tables."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from codequarry.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(repr([r[c] for c in want.columns]) for r in got.collect()) == sorted(repr(list(r)) for r in want.fetchall())


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_pipeline(spark):
    """Each stage against what its operator alone decides."""
    from codequarry.llm.minhash import near_duplicates
    from codequarry.llm.wumanber import contamination

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    one = corpus_pipeline.language_id(spark, docs, SF).cache()
    assert set(ids(one)) <= set(ids(docs)) and one.count() > 0.9 * docs.count()
    two = corpus_pipeline.near_dedup(spark, one, SF).cache()
    assert ids(two) == ids(near_duplicates(one, width=5).filter("kept"))
    three = corpus_pipeline.decontamination(spark, two, SF).cache()
    assert ids(three) == ids(contamination(two, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("not contaminated"))
    four = corpus_pipeline.mixing(spark, three, SF).cache()
    assert set(ids(four)) == set(ids(three)) and all(df.columns == docs.columns for df in (one, two, three, four))
    last = corpus_pipeline.token_output(spark, four, SF).collect()
    assert sorted(r["doc_id"] for r in last) == ids(four)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in last)


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).orderBy("doc_id").collect()] == [None, 1]


def documents():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def test_token_queries(spark):
    """op2 and op3 against the library."""
    import zlib

    import numpy as np
    from codequarry.llm.tokens import tokenizer_path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    ids = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t, _, _ in documents()]
    start, want = 0, []
    for d, x in ids:
        want.append((d, start, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())))
        start += len(x) + 1
    got = QUERIES["op3_repair_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    n = np.array([len(x) for _, x in ids])
    for r in QUERIES["op2_token_counts"](spark, SF).collect():
        assert (r["n_docs"], r["docs_from"], r["truncated_total"]) == ((n == r["n_tokens"]).sum(), (n >= r["n_tokens"]).sum(), np.minimum(n, r["n_tokens"]).sum())


def test_quality_query(spark):
    """op1: host, path and document rates by hand from the classifier's probabilities."""
    import numpy as np

    got = {r["doc_id"]: r for r in QUERIES["op1_hierarchical_quality"](spark, SF).collect()}
    rows = [(d, s or "", lang or "", got[d]["classifier"]) for d, _, lang, s in documents()]
    assert len(got) == len(rows)

    def sums(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + r[3])
        return out

    def strength(groups, prior):
        n = sum(g[0] for g in groups.values())
        between = sum(g[0] * (g[1] / g[0] - prior[k]) ** 2 for k, g in groups.items())
        chance = sum(prior[k] * (1 - prior[k]) for k in groups)
        within = sum(g[0] * prior[k] * (1 - prior[k]) for k, g in groups.items())
        return float(np.clip(within / n / max((between - chance) / n, 1e-9) - 1, 1.0, 1e6))

    hosts, paths = sums(lambda r: r[1]), sums(lambda r: r[1:3])
    base = sum(r[3] for r in rows) / len(rows)
    a = strength(hosts, dict.fromkeys(hosts, base))
    shrunk = {h: (s + a * base) / (n + a) for h, (n, s) in hosts.items()}
    b = strength(paths, {k: shrunk[k[0]] for k in paths})
    for d, host, path, p in rows:
        rate = (hosts[host][1] - p + a * base) / (hosts[host][0] - 1 + a)
        inner = (paths[host, path][1] - p + b * rate) / (paths[host, path][0] - 1 + b)
        odds = np.log(p / (1 - p)) + np.log(inner / (1 - inner)) - np.log(base / (1 - base))
        r = got[d]
        assert abs(r["host_rate"] - rate) < 1e-9 and abs(r["path_rate"] - inner) < 1e-9 and abs(r["quality"] - 1 / (1 + np.exp(-odds))) < 1e-6 and r["keep"] == (r["quality"] >= 0.5)


def test_language_query(spark):
    """op7: sizes by compressors made anew for each text."""
    import zlib

    import zstandard as z
    from codequarry.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    content = langid.labelled_sample(docs.filter(langid.fold_of() != 0))
    assert all(len(c) <= langid.DICTIONARY_BYTES for _, c in content.values())
    p = z.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=3, strategy=z.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
    got = {r["doc_id"]: r for r in QUERIES["op7_compression_langid"](spark, SF).collect()}
    assert set(got) == {d for d, *_ in documents()}
    for d, text, _, _ in documents():
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        raw = text.encode()
        size = {lang: sum(len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p).compress(raw[k : k + 8192])) for k in range(0, len(raw), 8192)) for lang, (_, c) in content.items()}
        best = sorted(size, key=lambda lang: (size[lang], -content[lang][0], lang))
        lead = size[best[1]] - size[best[0]]
        assert r["lang_pred"] == best[0] and abs(r["score"] - 1 / (1 + 2.0 ** -min(64, 8 * lead))) < 1e-12


def test_other_queries(spark):
    """op5, op8 and op9 over whole tables: the mixture's rows, true distances, candidates by the library's regular expressions."""
    import re

    import numpy as np

    mixed = QUERIES["op5_temperature_mixing"](spark, SF).collect()
    assert {r["doc_id"] for r in mixed} == {d for d, *_ in documents()} and [(r["block"], r["key"]) for r in mixed] == sorted((r["block"], r["key"]) for r in mixed)
    assert abs(sum({r["source"]: r["weight"] for r in mixed if r["weight"] is not None}.values()) - 1) < 1e-9
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    near = QUERIES["op8_adaptive_dimension_scan"](spark, SF).collect()
    assert {r["query_id"] for r in near} == {v for v in x if v % 100 == 0}
    assert all(abs(r["score"] - np.sqrt(((x[r["query_id"]] - x[r["vec_id"]]) ** 2).sum())) < 1e-9 for r in near)
    said = {(d, m.start(1)) for d, t, _, _ in documents() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
    found = {(r["doc_id"], r["start"]): r["is_secret"] for r in QUERIES["op9_secret_forest"](spark, SF).collect()}
    assert said <= {k for k, v in found.items() if v}
