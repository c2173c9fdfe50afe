"""Parameters of a run: defaults, then a mapping, then the environment, then overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

PREFIX, NESTED = "TESSERA_", "__"


@dataclass(frozen=True)
class SyncConfig:
    interval_minutes: int = 10
    max_attachment_mb: int = 50
    fetch_batch_size: int = 50
    max_messages_per_run: int = 0
    max_attempts: int = 3
    full_scan_hours: float = 24
    body_budget_kb: int = 2048
    exclude_folders: tuple[str, ...] = ()

    def __post_init__(self):
        if self.interval_minutes < 1 or self.fetch_batch_size < 1:
            raise ValueError("interval and batch size must be positive")


@dataclass(frozen=True)
class CleanConfig:
    strip_signature: bool = True
    strip_quoted_history: bool = False
    strip_legal: bool = True
    noise_tail_ratio: float = 0.3

    def __post_init__(self):
        if not 0.05 <= self.noise_tail_ratio <= 1:
            raise ValueError("the tail is a share from 0.05 to 1")


@dataclass(frozen=True)
class EmbeddingConfig:
    backend: str = "auto"
    dimension: int = 512
    chunk_size: int = 400
    chunk_overlap: int = 80

    def __post_init__(self):
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunks must be larger than their overlap")


@dataclass(frozen=True)
class SearchConfig:
    rrf_k: int = 60
    keyword_weight: float = 1.0
    vector_weight: float = 1.0
    candidate_multiplier: int = 5
    default_limit: int = 20
    snippet_length: int = 200
    min_score: float = 0.0
    score_margin: float = 0.0


@dataclass(frozen=True)
class Config:
    sync: SyncConfig = field(default_factory=SyncConfig)
    clean: CleanConfig = field(default_factory=CleanConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    search: SearchConfig = field(default_factory=SearchConfig)


def coerced(raw: str) -> Any:
    """true, false, numbers and comma-separated lists of an environment variable; else the text."""
    low = raw.strip().lower()
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            continue
    return tuple(x.strip() for x in raw.split(",")) if "," in raw else raw


def merged(base: dict, over: dict) -> dict:
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def environment(env: dict[str, str] | None = None) -> dict:
    out: dict = {}
    for name, raw in (os.environ if env is None else env).items():
        if name.startswith(PREFIX):
            at = out
            *path, last = name[len(PREFIX) :].lower().split(NESTED)
            for p in path:
                at = at.setdefault(p, {})
            at[last] = coerced(raw)
    return out


def _filled(own, values: dict):
    known = {f.name for f in fields(own)}
    return replace(own, **{k: _filled(getattr(own, k), v) if is_dataclass(getattr(own, k)) else tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def from_yaml(path: str) -> dict:
    """A mapping from a YAML file; a file that is not there is empty."""
    if not os.path.exists(path):
        return {}
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading a YAML file takes PyYAML") from e
    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    if not isinstance(own, dict):
        raise ValueError(f"{path} holds no mapping")
    return own


def load(mapping: dict | None = None, env: dict[str, str] | None = None, overrides: dict | None = None) -> Config:
    return _filled(Config(), merged(merged(mapping or {}, environment(env)), overrides or {}))
