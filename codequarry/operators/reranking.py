"""Second opinions on results: by keywords, or by a model that reads question and text together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval

CROSS_ENCODER = "cross-encoder/ms-marco-MiniLM-L-6-v2"
_MODELS: dict[str, object] = {}


def load_cross_encoder(name: str):
    """The scoring function of a sentence-transformers cross-encoder, loaded once in each worker."""
    if name not in _MODELS:
        from sentence_transformers import CrossEncoder

        _MODELS[name] = CrossEncoder(name)
    return lambda pairs: _MODELS[name].predict(pairs)


def rerank_by_model(results: DataFrame, name: str = CROSS_ENCODER, load: Callable[[str], Callable] = load_cross_encoder) -> DataFrame:
    """Results (question, enriched_text, ...) with the model's relevance of the text to the question as their score."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load(name)
        for questions, texts in parts:
            yield pd.Series([float(x) for x in score(list(zip(questions.fillna(""), texts.fillna(""), strict=True)))], dtype="float64")

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    told: Column = F.pandas_udf(run, "double")("question", "enriched_text")
    return results.withColumn("score", told)


def reranker(enabled: bool, model: str = "") -> Callable[[DataFrame], DataFrame] | None:
    """None if not enabled; by keywords without a model (or with ``lexical``); else by that cross-encoder."""
    if not enabled:
        return None
    return retrieval.rerank_lexical if model in ("", "lexical") else lambda results: rerank_by_model(results, model)
