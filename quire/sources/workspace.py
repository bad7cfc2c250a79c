"""Files on the driver: workspaces, output folders, deliverables, listings, probes."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Callable
from pathlib import Path

MARKER, LISTED, LEAST_DISK = ".delete-later", 500, 500 << 20


class UnsafePath(ValueError):
    """A path that would leave its folder."""


def docname(name: str) -> str:
    """A name that is one path segment."""
    if not name or name in (".", "..") or "/" in name or "\\" in name or Path(name).name != name:
        raise ValueError(f"invalid docname: {name!r}")
    return name


class Workspace:
    """Folders of jobs below one root."""

    def __init__(self, root: str | Path):
        self.root = Path(root).resolve()
        self.root.mkdir(parents=True, exist_ok=True)

    def job(self, job_id: str, *parts: str) -> Path:
        for p in (job_id, *parts):
            if not p or p in (".", "..") or "/" in p or "\\" in p or "\x00" in p:
                raise UnsafePath(f"unsafe segment: {p!r}")
        path = self.root.joinpath(job_id, *parts).resolve()
        if self.root not in path.parents:
            raise UnsafePath(f"outside of the workspace: {path}")
        path.mkdir(parents=True, exist_ok=True)
        return path

    def clean(self, job_id: str, attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> bool:
        """Removes a job's folder; if that keeps failing, marks it to be removed later."""
        path = self.job(job_id)
        for n in range(attempts):
            try:
                shutil.rmtree(path)
                return True
            except OSError:
                wait(0.5 * 2**n)
        (path / MARKER).touch()
        return False

    def clean_marked(self) -> int:
        """Removes what was marked; returns how many folders went."""
        gone = 0
        for marker in self.root.glob(f"*/{MARKER}"):
            try:
                shutil.rmtree(marker.parent)
                gone += 1
            except OSError:
                continue
        return gone


def output_dir(path: str) -> Path:
    """An absolute, writable folder, made if it isn't there."""
    own = Path(path)
    if not own.is_absolute():
        raise ValueError("output directory must be absolute")
    if own.exists() and not own.is_dir():
        raise ValueError("output path is not a directory")
    own.mkdir(parents=True, exist_ok=True)
    if not os.access(own, os.W_OK):
        raise ValueError("output directory is not writable")
    return own


def write_deliverable(out: str | Path, name: str, markdown: str, assets: str | Path, report: str) -> dict[str, Path]:
    """``<name>.md`` with links into ``<name>/assets``, which is made anew, and ``<name>/conversion-report.md``. The markdown is written as it is but for its links."""
    out, name = Path(out), docname(name)
    held = out / name / "assets"
    if held.exists():
        shutil.rmtree(held)
    held.mkdir(parents=True)
    if Path(assets).is_dir():
        for item in sorted(Path(assets).iterdir()):
            if item.is_file():
                shutil.copy2(item, held / item.name)
    document, account = out / f"{name}.md", out / name / "conversion-report.md"
    document.write_text(markdown.replace("(assets/", f"({name}/assets/"), encoding="utf-8")
    account.write_text(report, encoding="utf-8")
    return {"document": document, "assets": held, "report": account}


def artifact(recorded: str | None, *conventional: str | Path) -> Path | None:
    """The first candidate that exists."""
    return next((Path(p) for p in (recorded, *conventional) if p and Path(p).is_file()), None)


def folders(path: str, limit: int = LISTED) -> list[str]:
    """Names of the folders in a folder, sorted."""
    own = Path(path)
    if not own.is_absolute():
        raise ValueError("path must be absolute")
    with os.scandir(own) as entries:
        return sorted(e.name for e in entries if e.is_dir())[:limit]


def probe(checks: dict[str, Callable[[], str]]) -> list[dict]:
    """Runs health checks; a check that raises is not ok, and its message never shows more than the kind of error."""
    out = []
    for name, check in checks.items():
        try:
            out.append({"name": name, "ok": True, "detail": check()})
        except Exception as e:  # noqa: BLE001  a probe must not raise
            out.append({"name": name, "ok": False, "detail": type(e).__name__})
    return out


def disk_probe(path: str, least: int = LEAST_DISK) -> str:
    free = shutil.disk_usage(path).free
    if free < least:
        raise OSError("too little disk space")
    return f"{free >> 20} MiB free"
