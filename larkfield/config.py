"""Settings with a check of each value; whatever is missing or invalid takes its default, unknown keys are dropped."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

LANGUAGES = ("ruby", "python", "ts", "js", "prose")


@dataclass(frozen=True)
class Config:
    enabled: bool = True
    index_dir: str = field(default_factory=lambda: os.path.join(os.path.expanduser("~"), ".cache", "larkfield"))
    languages: tuple[str, ...] = ("ruby", "python", "ts", "js")
    max_locate_results: int = 10
    index_batch_size: int = 50
    index_idle_ms: int = 25
    cochange_window_days: int = 180
    cochange_max_commits: int = 4_000
    cochange_max_files_per_commit: int = 50
    max_file_bytes: int = 1_048_576
    keyword_stoplist: tuple[str, ...] = ()
    keyword_min_length: int = 3
    telemetry: bool = False
    telemetry_store_queries: bool = True
    telemetry_turn_cap: int = 10
    telemetry_retention_days: int = 30
    persona: bool = True
    prompt_nudge: bool = True
    strong_hit_directive: bool = True
    grep_block: bool = True


def merge_config(given: Mapping[str, Any]) -> Config:
    made: dict[str, Any] = {}
    for f in fields(Config):
        value = given.get(f.name)
        if f.name == "languages":
            ok = isinstance(value, (list, tuple))
            value = tuple(v for v in value if v in LANGUAGES) if ok else None
        elif f.name == "keyword_stoplist":
            ok = isinstance(value, (list, tuple))
            value = tuple(str(v).lower() for v in value) if ok else None
        elif f.type == "bool":
            ok = isinstance(value, bool)
        elif f.type == "int":
            ok = isinstance(value, int) and not isinstance(value, bool) and value >= (0 if f.name == "index_idle_ms" else 1)
        else:
            ok = isinstance(value, str)
        if ok:
            made[f.name] = value
    return Config(**made)


def load_config(path: str, key: str = "larkfield") -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return merge_config(found.get(key) or {})
    except (OSError, ValueError, AttributeError):
        return Config()
