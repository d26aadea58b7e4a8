"""Embedding models: a contract, the kinds there are, and how one becomes a column.

The hash embedder is a column expression and needs no Python. A model runs in
Arrow batches on the executors, which load it once for each worker.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: Texts that go to a local model, or to a service, at once.
LOCAL_BATCH, REMOTE_BATCH = 64, 512


class Embedder(Protocol):
    """Turns texts into vectors, all of one length. It is pickled to the executors, so models are loaded on first use."""

    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LocalModel:
    """A sentence-transformers model. The package is asked for when the first text comes."""

    def __init__(self, name: str = "all-MiniLM-L6-v2") -> None:
        self.name, self._model = name, None

    def __getstate__(self) -> dict:
        return {"name": self.name, "_model": None}

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.name)
        return self._model.encode(texts, batch_size=LOCAL_BATCH, normalize_embeddings=True, show_progress_bar=False).tolist()


class RemoteModel:
    """An embeddings endpoint in the shape that OpenAI-compatible servers have. ``send`` (url, headers, body) replaces the request in tests."""

    def __init__(self, name: str = "text-embedding-3-small", api_key: str = "", base_url: str = "https://api.openai.com/v1", send: Callable[[str, dict, dict], dict] | None = None) -> None:
        self.name, self.api_key, self.base_url, self.send = name, api_key, base_url.rstrip("/"), send

    def embed(self, texts: list[str]) -> list[list[float]]:
        got = (self.send or _post)(f"{self.base_url}/embeddings", {"authorization": f"Bearer {self.api_key}"}, {"model": self.name, "input": texts})
        return [row["embedding"] for row in sorted(got["data"], key=lambda row: row["index"])]


def _post(url: str, headers: dict, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=120) as reply:
        return json.load(reply)


def column_of(model: Embedder, batch: int = REMOTE_BATCH) -> Callable[[Column], Column]:
    """The function from a text column to a vector column. A null text is embedded as an empty one; no batch is larger than ``batch`` texts."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            asked = texts.fillna("").tolist()
            vectors = [v for at in range(0, len(asked), batch) for v in model.embed(asked[at : at + batch])]
            if len(vectors) != len(asked):
                raise ValueError(f"{model.name} gave {len(vectors)} vectors for {len(asked)} texts")
            yield pd.Series(vectors, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")


def embedder(provider: str, model: str = "", api_key: str = "", dim: int = 128) -> Callable[[Column], Column]:
    """The column function of a provider: hash (also mock), local (also sentence_transformers), openai. ValueError for others or where a key is missing."""
    kind = provider.lower().replace("-", "_")
    if kind in ("hash", "mock"):
        return lambda text: S.hash_embedding(text, dim)
    if kind in ("local", "sentence_transformers"):
        return column_of(LocalModel(*([model] if model else [])), LOCAL_BATCH)
    if kind == "openai":
        if not api_key:
            raise ValueError("openai needs an API key")
        return column_of(RemoteModel(*([model] if model else []), api_key=api_key))
    raise ValueError(f"unknown embedding provider {provider!r}; there are hash, local and openai")
