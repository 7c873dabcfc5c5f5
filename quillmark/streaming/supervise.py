"""Keeping a watch alive: bounded restarts with growing pauses, and its state as data."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

from quillmark.vocabulary import BACKOFF_MS, MAX_RESTARTS


def pause_ms(attempt: int) -> int | None:
    """Milliseconds before the n-th restart, from 1; None once there are to be no more."""
    return BACKOFF_MS * attempt if 1 <= attempt <= MAX_RESTARTS else None


class Supervisor:
    """Runs what ``start`` returns; a query that fails is started again, one that is stopped is not.

    ``state`` is one of ``SUPERVISOR_STATES``: indexing until a first batch has been
    finished, then serving. The count of restarts goes back to none by ``start``, and once
    a query has run for ``healthy`` seconds.
    """

    def __init__(self, start: Callable[[], StreamingQuery], sleep: Callable[[float], None] = time.sleep, healthy: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self._start, self._sleep, self._healthy, self._clock = start, sleep, healthy, clock
        self.query: StreamingQuery | None = None
        self.restarts, self.error, self._since = 0, None, 0.0

    def start(self) -> None:
        self.restarts, self.error = 0, None
        self.query, self._since = self._start(), self._clock()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
        self.query, self.error = None, None

    @property
    def state(self) -> str:
        if self.query is None:
            return "error" if self.error else "stopped"
        if not self.query.isActive:
            return "error" if self.query.exception() is not None else "stopped"
        return "serving" if self.query.lastProgress else "indexing"

    def tend(self) -> str:
        """Restarts a failed query, or gives it up; returns the state. To be called from time to time."""
        if self.query is not None and self.restarts and self._clock() - self._since >= self._healthy:
            self.restarts = 0
        if self.query is not None and not self.query.isActive:
            failure = self.query.exception()
            if failure is None:
                self.query = None
                return self.state
            self.error, pause = str(failure), pause_ms(self.restarts + 1)
            self.query = None
            if pause is not None:
                self.restarts += 1
                self._sleep(pause / 1000)
                self.query, self._since = self._start(), self._clock()
        return self.state

    def status(self) -> dict:
        return {"state": self.state, "restarts": self.restarts, "error": self.error, "progress": self.query.lastProgress if self.query is not None else None}
