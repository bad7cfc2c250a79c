"""Settings: typed, range-checked, secrets never shown; read from the environment and ``.env`` files."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from quire.functions.mermaid import ALLOWED

_SECRETS = ("agent_api_key", "database_url")
_RANGES = {
    "render_dpi": (72, 400),
    "coverage_threshold": (0, 100),
    "coverage_floor": (0.0, 1.0),
    "coverage_floor_min_tokens": (1, 10_000),
    "max_page_retries": (0, 10),
    "rolling_context_pages": (0, 50),
    "native_text_min_words": (1, 10_000),
    "diagram_min_confidence": (0, 100),
    "max_mb": (1, 10_000),
    "max_pages": (1, 100_000),
    "ocr_timeout": (1, 3600),
    "agent_timeout": (1, 3600),
}
_CHOICES = {"diagram_fallback": ("image", "table", "both"), "thinking_transcribe": ("low", "high"), "thinking_diagram": ("low", "high"), "log_level": ("DEBUG", "INFO", "WARNING", "ERROR")}


@dataclass(frozen=True)
class Settings:
    agent_model: str = "agent"
    ocr_model: str = "ocr"
    agent_api_key: str = field(default="", repr=False)
    database_url: str = field(default="", repr=False)
    render_dpi: int = 200
    coverage_threshold: int = 95
    coverage_floor: float = 0.8
    coverage_floor_min_tokens: int = 30
    max_page_retries: int = 2
    rolling_context_pages: int = 3
    native_text_first: bool = True
    native_text_min_words: int = 20
    ocr_enabled: bool = True
    toc_enabled: bool = True
    fig_details: bool = True
    diagram_to_mermaid: bool = True
    diagram_min_confidence: int = 80
    diagram_verify: bool = True
    diagram_fallback: str = "both"
    diagram_keep_image: bool = True
    diagram_types: tuple[str, ...] = ALLOWED
    thinking_transcribe: str = "low"
    thinking_diagram: str = "high"
    max_mb: int = 500
    max_pages: int = 1000
    ocr_timeout: int = 120
    agent_timeout: int = 300
    log_level: str = "INFO"

    def __post_init__(self):
        for name, (low, high) in _RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        for name, among in _CHOICES.items():
            if getattr(self, name) not in among:
                raise ValueError(f"{name} must be one of {among}")
        if unknown := set(self.diagram_types) - set(ALLOWED):
            raise ValueError(f"unknown diagram types: {sorted(unknown)}")

    def shown(self) -> dict:
        """All settings, secrets masked."""
        return {k: ("***" if v else "") if k in _SECRETS else v for k, v in asdict(self).items()}


def _cast(name: str, kind: type, text: str):
    if kind is bool:
        if text.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
            raise ValueError(f"{name} must be a boolean")
        return text.lower() in ("1", "true", "yes", "on")
    if kind is tuple:
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return kind(text)


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Settings:
    """Names in upper case; the environment goes before the file."""
    values: dict[str, str] = {}
    if path and Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, mark, value = line.strip().partition("=")
            if mark and not key.startswith("#"):
                values[key.strip()] = value.strip().strip("'\"")
    values |= os.environ if environ is None else environ
    own = {f.name: _cast(f.name, type(f.default), values[f.name.upper()]) for f in fields(Settings) if f.name.upper() in values}
    return Settings(**own)


def options(text: str | None) -> dict:
    """A job's options from JSON: an object, or nothing."""
    try:
        own = json.loads(text or "{}")
    except json.JSONDecodeError as e:
        raise ValueError(f"options are no JSON: {e}") from e
    if not isinstance(own, dict):
        raise ValueError("options must be a JSON object")
    return own


def overridden(settings: Settings, changes: dict) -> Settings:
    """A job's options: known names with a value of the same type replace the setting, others are ignored; values are checked."""
    known = {f.name for f in fields(Settings)} - set(_SECRETS)
    return replace(settings, **{k: v for k, v in changes.items() if k in known and type(v) is type(getattr(settings, k))})
