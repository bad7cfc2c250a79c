"""Structured logs, stage timers, and progress of streams."""

from __future__ import annotations

import contextvars
import json
import logging
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql.streaming.listener import StreamingQueryListener

from quire.plans.resilience import resolve_model
from quire.sources import workspace
from quire.sources.settings import Settings

_context: contextvars.ContextVar[dict] = contextvars.ContextVar("quire", default={})


class JsonFormatter(logging.Formatter):
    """One JSON object a line, with the job, stage and page at hand."""

    def format(self, record: logging.LogRecord) -> str:
        own = {"level": record.levelname, "logger": record.name, "message": record.getMessage()} | _context.get()
        if hasattr(record, "duration_ms"):
            own["duration_ms"] = record.duration_ms
        return json.dumps(own, default=str)


def configure(level: str = "INFO", as_json: bool = False) -> logging.Logger:
    logger = logging.getLogger("quire")
    logger.handlers.clear()
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter() if as_json else logging.Formatter("%(levelname)s %(name)s %(message)s"))
    logger.addHandler(handler)
    logger.setLevel(level)
    return logger


@contextmanager
def stage(name: str, **more):
    """Names the stage in all logs inside, and logs how long it took."""
    token, began = _context.set(_context.get() | {"stage": name} | more), time.perf_counter()
    try:
        yield
    finally:
        logging.getLogger("quire").info("stage %s done", name, extra={"duration_ms": round((time.perf_counter() - began) * 1000, 1)})
        _context.reset(token)


class Progress(StreamingQueryListener):
    """Logs each trigger's rows and rates."""

    def onQueryStarted(self, event):
        logging.getLogger("quire").info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event):
        p = event.progress
        logging.getLogger("quire").info("stream %s: %s rows, %.1f a second", p.name or p.id, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        logging.getLogger("quire").info("stream %s ended", event.id)


def health_checks(settings: Settings, path: str, *, version: Callable[[], str], local_models: Callable[[], list[str]], remote_models: Callable[[], list[str]], ask_database: Callable[[], object]) -> dict[str, Callable[[], str]]:
    """The checks for ``workspace.probe``: recognition service and its model, transcription model and key, database, disk. What reaches a service is injected."""

    def has(wanted: str, listed: Callable[[], list[str]]) -> str:
        return f"model present: {resolve_model(wanted, listed())}"

    def remote() -> str:
        if not settings.agent_api_key:
            raise PermissionError("no key")
        return has(settings.agent_model, remote_models)

    def database() -> str:
        ask_database()
        return "database responding"

    return {"recognition": lambda: f"version {version()}", "local_models": lambda: has(settings.ocr_model, local_models), "agent": remote, "database": database, "disk": lambda: workspace.disk_probe(path)}
