"""Fingerprint of a job's configuration."""

from __future__ import annotations

import hashlib
import json

# The inputs of a fingerprint, with their defaults.
DEFAULTS = {
    "prompts": {"transcribe": "v1", "verify": "v1", "diagram": "v1", "diagram_verify": "v1"},
    "agent_model": "agent",
    "ocr_model": "ocr",
    "render_dpi": 200,
    "rolling_context_pages": 3,
    "coverage_threshold": 95,
    "coverage_floor": 0.8,
    "max_page_retries": 2,
    "thinking_transcribe": "low",
    "thinking_diagram": "high",
    "native_text_first": True,
    "native_text_min_words": 20,
    "ocr_enabled": True,
    "toc_enabled": True,
    "fig_details": True,
    "diagram_to_mermaid": True,
    "diagram_min_confidence": 80,
    "diagram_verify": True,
    "diagram_fallback": "both",
    "diagram_keep_image": True,
}


def canonical(options: dict) -> str:
    """JSON with sorted keys and without spaces: equal options give equal text."""
    return json.dumps(options, sort_keys=True, separators=(",", ":"))


def fingerprint(**changed) -> str:
    """SHA-256 of the defaults with some options changed; unknown names are errors."""
    if unknown := set(changed) - set(DEFAULTS):
        raise TypeError(f"unknown options: {sorted(unknown)}")
    return hashlib.sha256(canonical(DEFAULTS | changed).encode()).hexdigest()


def options_rows() -> list[dict]:
    """The defaults, and the defaults with each simple option changed alone."""
    change = lambda v: not v if isinstance(v, bool) else v + 1 if isinstance(v, (int, float)) else f"{v}2"
    return [DEFAULTS] + [DEFAULTS | {k: change(v)} for k, v in DEFAULTS.items() if not isinstance(v, dict)]
