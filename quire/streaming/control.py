"""Control of running jobs: status, pause, resume, cancel; honoured between waves of pages."""

from __future__ import annotations

import threading

from quire.operators.store import FINAL_JOBS, TRANSITIONS


class IllegalTransition(RuntimeError):
    """A step that the status map doesn't allow."""


class Control:
    """One job's control, held by the driver."""

    def __init__(self, status: str = "queued"):
        self.status = status
        self.cancel_requested = False
        self._going = threading.Event()
        self._going.set()
        self._left: str | None = None

    def transition(self, to: str) -> None:
        if to not in TRANSITIONS.get(self.status, ()):
            raise IllegalTransition(f"{self.status} -> {to} forbidden")
        self.status = to

    def pause(self) -> None:
        left = self.status
        self.transition("paused")
        self._left = left
        self._going.clear()

    def resume(self, to: str | None = None) -> None:
        """Back to the stage that was paused, or to another."""
        if self.status != "paused":
            raise IllegalTransition(f"resume requires paused, in {self.status}")
        self.transition(to or self._left or "transcribing")
        self._left = None
        self._going.set()

    def cancel(self) -> None:
        """From every status that isn't final; a paused job is let go."""
        if self.status in FINAL_JOBS:
            raise IllegalTransition(f"cannot cancel terminal {self.status}")
        self.status, self.cancel_requested = "cancelled", True
        self._going.set()

    @property
    def paused(self) -> bool:
        return not self._going.is_set()

    def wait(self, timeout: float | None = None) -> bool:
        """Returns once the job isn't paused."""
        return self._going.wait(timeout)


class Admission:
    """One running job at a time."""

    def __init__(self):
        self._lock, self._running = threading.Lock(), None

    def admit(self, job_id: str) -> bool:
        with self._lock:
            if self._running is not None:
                return False
            self._running = job_id
            return True

    def release(self, job_id: str) -> None:
        with self._lock:
            if self._running == job_id:
                self._running = None
