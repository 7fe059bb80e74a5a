"""One-shot completion handles for Spark jobs that run beside the caller."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Status:
    """Success, or the error that ended the job."""

    error: BaseException | None = None

    @property
    def is_ok(self) -> bool:
        return self.error is None

    @property
    def is_error(self) -> bool:
        return self.error is not None


class Job:
    """Done once: the status is stored before waiters are released, and later marks change nothing."""

    def __init__(self):
        self._done, self._lock = threading.Event(), threading.Lock()
        self._status, self.result = Status(), None

    def _mark(self, status: Status, result: Any = None) -> bool:
        with self._lock:
            if self._done.is_set():
                return False
            self._status, self.result = status, result
            self._done.set()
            return True

    def mark_ok(self, result: Any = None) -> bool:
        return self._mark(Status(), result)

    def mark_error(self, error: BaseException) -> bool:
        return self._mark(Status(error))

    def wait(self, timeout: float | None = None) -> bool:
        return self._done.wait(timeout)

    @property
    def is_done(self) -> bool:
        return self._done.is_set()

    @property
    def status(self) -> Status:
        """OK until the job is done."""
        return self._status


def submit(work: Callable[[], Any]) -> Job:
    """Run ``work`` in a thread that inherits the caller's Spark job properties."""
    job = Job()

    def run() -> None:
        try:
            job.mark_ok(work())
        except BaseException as error:  # the status carries it
            job.mark_error(error)

    session = SparkSession.getActiveSession()
    threading.Thread(target=inheritable_thread_target(session)(run) if session else run, daemon=True).start()
    return job
