"""Settings of a run, with defaults from the environment, read when a run begins."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

PREFIX = "FIELDSPARK_"


@dataclass(frozen=True)
class Config:
    model: str = "rules"
    max_concurrency: int = 4  # calls at once in a task
    max_workers: int = 10  # partitions in which calls run, at least; more if spark.sql.shuffle.partitions asks for more
    max_retries: int = 5
    timeout_secs: float = 120.0
    max_validation_rounds: int = 2
    pricing: str = ""
    multipass: bool = False
    passes: int = 3
    strategy: str = "union"
    fail_threshold: int | None = None  # passes of a document that may fail; None: all but one
    provenance: bool = False
    chunking: bool = True
    field_chunking: bool = True  # wide schemas are asked for in groups of fields
    adaptive: bool = True
    missing_threshold: float | None = None  # None: by complexity
    completeness_retry: bool = False
    completeness_threshold: float = 0.7
    fail_fast: bool = False

    def __post_init__(self):
        for name in ("max_concurrency", "max_workers", "passes"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def but(self, **changes: object) -> Config:
        """This one with the changes that aren't None."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def load(environ: Mapping[str, str] = os.environ) -> Config:
    """Defaults, changed by FIELDSPARK_<NAME> variables."""
    found: dict[str, object] = {}
    for f in fields(Config):
        if (text := environ.get(PREFIX + f.name.upper())) is not None:
            found[f.name] = text.lower() in ("1", "true", "yes") if f.type == "bool" else int(text) if f.type == "int" else float(text) if "float" in f.type else int(text) if "int" in f.type else text
    return Config(**found)
