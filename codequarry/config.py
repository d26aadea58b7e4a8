"""Settings from the environment or a ``.env`` file, validated."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

PREFIX = "CODEQUARRY_"
LEVELS = ("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG")


@dataclass
class Settings:
    embedding_provider: str = "hash"
    embedding_model: str = ""
    embedding_dim: int = 128
    llm_provider: str = "offline"
    llm_model: str = "synthesizer"
    metric: str = "cosine"
    #: Both must be folders that all executors see, where there are several machines.
    store_path: str = ".codequarry/index"
    clone_root: str = "_repos"
    store_kind: str = "parquet"
    store_buckets: int = 64
    chunk_max_tokens: int = 512
    chunk_overlap_tokens: int = 64
    languages: list[str] = field(default_factory=lambda: ["python", "javascript", "typescript"])
    top_k: int = 8
    graph_expansion_depth: int = 1
    context_token_budget: int = 8000
    reranking_enabled: bool = False
    reranker_model: str = "lexical"
    log_level: str = "INFO"
    log_file: str = ""
    openai_api_key: str = ""
    anthropic_api_key: str = ""
    ollama_base_url: str = "http://localhost:11434"

    def __post_init__(self) -> None:
        if isinstance(self.languages, str):
            self.languages = [x.strip().lower() for x in self.languages.split(",") if x.strip()]
        self.log_level = self.log_level.upper()
        if self.log_level not in LEVELS:
            raise ValueError(f"log_level must be one of {LEVELS}")
        for name, least in (("chunk_max_tokens", 1), ("chunk_overlap_tokens", 0), ("top_k", 1), ("graph_expansion_depth", 0), ("context_token_budget", 1), ("embedding_dim", 1), ("store_buckets", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.metric not in ("cosine", "l2"):
            raise ValueError("metric must be cosine or l2")


    def api_key(self, provider: str | None = None) -> str:
        """The key of a provider; empty for those that need none."""
        return {"openai": self.openai_api_key, "anthropic": self.anthropic_api_key}.get(provider or self.llm_provider, "")


#: Settings whose variables are the ones other tools use, too, and have no prefix.
SHARED = ("openai_api_key", "anthropic_api_key", "ollama_base_url")


def load(env_file: str = ".env", environ: dict[str, str] | None = None) -> Settings:
    """Settings with the values of the environment, and below them those of the file, under the prefix."""
    found: dict[str, str] = {}
    if Path(env_file).is_file():
        for line in Path(env_file).read_text().splitlines():
            name, sign, value = line.partition("=")
            if sign and not line.lstrip().startswith("#"):
                found[name.strip().upper()] = value.strip().strip("\"'")
    found |= {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    given = {}
    for f in fields(Settings):
        if (raw := found.get(("" if f.name in SHARED else PREFIX) + f.name.upper())) is not None:
            kind = type(getattr(Settings, f.name, ""))
            given[f.name] = raw if f.name == "languages" else raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
    return Settings(**given)
