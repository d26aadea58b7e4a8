"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor
kept, and returns the columns of ``documents``; the last describes the token
files that it wrote. Columns beyond those of ``documents`` are dropped, an
empty table stays empty, and texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import scratch, sized_join, stored
from codequarry.llm.langid import classify, labelled_sample
from codequarry.llm.minhash import near_duplicates
from codequarry.llm.mixing import mix
from codequarry.llm.repair import token_files
from codequarry.llm.wumanber import find_benchmark

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; lang becomes the language found.

    Rejected are null and empty texts, texts without a letter, ties between two
    languages and leads of less than ``langid.MIN_MARGIN``. Languages are
    learned from the rows with both a lang and a text; without any, all is
    rejected. Repeated rows are judged alike, a null id like any other.
    """
    docs = docs.select(*COLUMNS)
    told = classify(docs, labelled_sample(docs)).filter("not lang_rejected")
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows without an id are kept. Of rows with the same id in one group, and of
    those alike in id and text, the first text in sort order stays. A null or
    empty text is like no other; of rows that repeat one under one id the first
    stays. Groups of any size, and ties between their members, are decided by
    the smallest id.
    """
    groups = near_duplicates(docs, width=5, percent=80, by_row=True)
    row = ["doc_id", "text_hash"]
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    gone = stored(groups.filter("not kept").select(*row).distinct().withColumn("_gone", F.lit(True)), f"{scratch(spark)}/gone")
    kept = sized_join(docs, gone, row, salt=F.col("text_hash")).filter("_gone is null").select(*COLUMNS, "text_hash")
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    where = groups.filter("kept").join(again, "doc_id", "left_semi").groupBy(*row).agg(F.min("component").alias("component"))
    repeated = kept.join(again, "doc_id", "left_semi").join(where, row).groupBy("doc_id", "component").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts hold none and stay, as do all documents where the
    benchmark is empty. Each row is judged for itself, so rows that repeat an
    id, or have none, need no rule of their own.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_benchmark(docs.select(*COLUMNS), benchmark, carry=COLUMNS)
    return found.filter(F.size("hit_spans") == 0).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources to their weights: every document once or more, a row for each reading.

    Shares go by the tokenizer's exact counts of all whole texts. A null
    source is a source of its own. Null and empty texts have no tokens and are
    read once. Rows alike in id and text are read equally often.
    """
    return mix(docs.select(*COLUMNS), with_tokens=False).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, described by document as read back: a row for each row of docs.

    A null text is empty and has the end id only. Rows without an id come
    first; rows that repeat one stand in the order of a hash of their texts.
    """
    return token_files(docs)


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token files", token_output),
]

#: Compression, min-hashing and tokenizers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored as Parquet and read again by the next."""
    folder = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
