"""Calls to models: retried where that can help, and never raising out of a task.

An exception that left a Python worker would make Spark run the task, and all its calls, again. So a call ends as an ``Outcome``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

ATTEMPTS, BASE, LONGEST = 3, 1.0, 120.0


class CallFailed(Exception):
    """A failure that an adapter has classified: kind is status, timeout, connect, protocol or other."""

    def __init__(self, kind: str, status: int | None = None, retry_after: str | None = None, message: str = ""):
        super().__init__(message or f"{kind} {status or ''}".strip())
        self.kind, self.status, self.retry_after = kind, status, retry_after


@dataclass
class Outcome:
    """``paused``: a sustained outage; the job should pause, not fail. ``kind``: of the last failure."""

    value: Any = None
    error: str | None = None
    paused: bool = False
    kind: str | None = None


def delay(failure: Exception, attempt: int, base: float = BASE) -> float | None:
    """Seconds to wait after the attempt (counted from 1), or None if another can't help."""
    backoff = base * 2.0 ** (attempt - 1)
    if isinstance(failure, TimeoutError):
        return backoff
    if not isinstance(failure, CallFailed):
        return None
    if failure.kind != "status":
        return backoff if failure.kind in ("timeout", "connect", "protocol") else None
    if failure.status == 429:
        try:
            return min(float(failure.retry_after), LONGEST)
        except (TypeError, ValueError):
            return backoff
    return backoff if (failure.status or 0) >= 500 else None


def resilient(call: Callable[[], Any], attempts: int = ATTEMPTS, base: float = BASE, sleep: Callable[[float], None] = time.sleep, name: str = "model call") -> Outcome:
    if attempts < 1:
        raise ValueError("attempts must be >= 1")
    for n in range(1, attempts + 1):
        try:
            return Outcome(call())
        except Exception as e:  # noqa: BLE001  errors are data here
            kind = "timeout" if isinstance(e, TimeoutError) else getattr(e, "kind", "other")
            wait = delay(e, n, base)
            if wait is None:
                return Outcome(error=f"{type(e).__name__}: {e}", kind=kind)
            if n == attempts:
                return Outcome(error=f"{name} failed after {attempts} attempts: {e}", paused=True, kind=kind)
            sleep(wait)
    raise AssertionError("unreachable")


def resolve_model(name: str, offered: list[str]) -> str:
    """The name as it is offered: exactly, else without its ``:cloud`` suffix."""
    for candidate in (name, name.removesuffix(":cloud")):
        if candidate in offered:
            return candidate
    raise ValueError(f"model {name!r} is not offered")
