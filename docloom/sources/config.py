"""Settings of the pipelines: defaults, loading from JSON or YAML, and limits that can't be weakened without a reason."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

MB = 1 << 20


@dataclass(frozen=True)
class Chunking:
    size_tokens: int = 512
    overlap_tokens: int = 50
    respect_headings: bool = True
    respect_tables: bool = True

    def __post_init__(self) -> None:
        if self.size_tokens < 1 or not 0 <= self.overlap_tokens < self.size_tokens:
            raise ValueError("chunks need a size of 1 at least and an overlap below it")


@dataclass(frozen=True)
class Limits:
    """What a file may be at most. override_reason must say why a limit is weaker than its default."""

    max_file_mb: int = 500
    max_pages: int = 5000
    max_expansion: int = 100
    max_depth: int = 100
    max_keys: int = 500_000
    reject_javascript: bool = True
    timeout_s: int = 300
    override_reason: str | None = None

    def __post_init__(self) -> None:
        weaker = [f.name for f in fields(self) if f.name != "override_reason" and self._weaker(f.name, f.default)]
        if weaker and not (self.override_reason or "").strip():
            raise ValueError(f"{', '.join(weaker)}: weaker than the default without override_reason")

    def _weaker(self, name: str, default: Any) -> bool:
        value = getattr(self, name)
        return (default and not value) if isinstance(default, bool) else value > default


@dataclass(frozen=True)
class Sheets:
    high_confidence: int = 4
    medium_confidence: int = 3
    merged_ratio: float = 0.05
    numeric_ratio: float = 0.3
    consistency: float = 0.7
    min_rows: int = 5
    sentence_rows: int = 5000
    sample_rows: int = 3
    max_rows: int = 100_000
    gap: int = 2
    window: int = 5
    heavy: float = 0.6


@dataclass(frozen=True)
class Forms:
    accept: float = 0.8
    page_min: float = 0.6
    extra_page: float = 0.02
    floor: float = 0.5
    grid: tuple[int, int] = (20, 16)
    field_min: float = 0.5
    overall_min: float = 0.3
    vlm_below: float = 0.4
    vlm_budget: int = 10
    widget_iou: float = 0.5
    fields_per_chunk: int = 20
    redact: tuple[str, ...] = ()


@dataclass(frozen=True)
class Backends:
    timeout_s: float = 30.0
    retries: int = 2
    backoff_s: float = 1.0
    batch: int = 64
    dimension: int = 768


@dataclass(frozen=True)
class Config:
    parser_version: str = "1"
    tenant_id: str | None = None
    chunking: Chunking = field(default_factory=Chunking)
    limits: Limits = field(default_factory=Limits)
    sheets: Sheets = field(default_factory=Sheets)
    forms: Forms = field(default_factory=Forms)
    backends: Backends = field(default_factory=Backends)


def from_dict(data: dict[str, Any], base: Config | None = None) -> Config:
    """A configuration with the given values over the defaults; unknown names are errors."""
    config, changes = base or Config(), {}
    for name, value in data.items():
        if name not in {f.name for f in fields(Config)}:
            raise ValueError(f"unknown setting {name!r}")
        part = getattr(config, name)
        if isinstance(value, dict):
            unknown = set(value) - {f.name for f in fields(part)}
            if unknown:
                raise ValueError(f"unknown settings {sorted(unknown)} in {name}")
            value = replace(part, **{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
        changes[name] = value
    return replace(config, **changes)


def load(path: str) -> Config:
    """From a .json, .yaml or .yml file; an empty file gives the defaults."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text) if text.strip() else {}
    elif path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text) or {}
    else:
        raise ValueError(f"neither JSON nor YAML: {path}")
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    return from_dict(data)
