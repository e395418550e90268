"""Parameters of a run: arguments over TIDEMARK_* environment over a TOML file over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    epsilon: float = 1e-6
    min_alias_len: int = 4
    fuzzy_threshold: float = 85.0
    fuzzy_max_words: int = 3
    sample_target: int = 500_000
    semantic_top: int = 500
    semantic_top_per_entity: int = 50
    accept_threshold: float = 0.5
    text_limit: int = 512
    immediate_start: int = 0
    immediate_end: int = 7
    longterm_end: int = 730
    min_decay_days: int = 5
    similarity_sample: int = 10_000
    min_cluster_size: int = 15
    window_days: int = 30
    window_sample: int = 2000
    per_entity_cap: int = 1000
    year_min: int = 2013
    year_max: int = 2025
    hdi_prob: float = 0.89
    n_samples: int = 2000
    n_tune: int = 1000
    n_chains: int = 4

    @classmethod
    def load(cls, toml: str | Path | None = None, **arguments) -> Settings:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found: dict = {}
        if toml is not None:
            with open(toml, "rb") as f:
                found |= {k: v for k, v in tomllib.load(f).items() if k in kinds}
        found |= {k: v for k in kinds if (v := os.environ.get(f"TIDEMARK_{k.upper()}")) is not None}
        found |= arguments
        return replace(cls(), **{k: kinds[k](v) for k, v in found.items()})
