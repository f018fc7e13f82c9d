"""Compactions on a thread of their own: scheduled after flushes, waited for by writes that stall, drained on close."""

from __future__ import annotations

import threading
from collections.abc import Callable


class Worker:
    """Runs ``work`` until it has nothing more to do, whenever it is scheduled. The first error stops it for good and is raised to
    every later caller; what was scheduled before ``close`` is finished first."""

    def __init__(self, work: Callable[[], bool]):
        self.work = work
        self.changed = threading.Condition()
        self.scheduled = self.closing = False
        self.rounds, self.useful = 0, False
        self.error: Exception | None = None
        self.thread = threading.Thread(target=self._run, name="keyloom-compaction", daemon=True)
        self.thread.start()

    def schedule(self) -> None:
        with self.changed:
            self.scheduled = True
            self.changed.notify_all()

    def check(self) -> None:
        if self.error:
            raise self.error

    def wait_turn(self) -> bool:
        """Wait for one more round of work; whether it found something to do."""
        with self.changed:
            before = self.rounds
            self.scheduled = True
            self.changed.notify_all()
            self.changed.wait_for(lambda: self.rounds > before or self.error or self.closing and not self.thread.is_alive())
        self.check()
        return self.useful

    def close(self) -> None:
        with self.changed:
            self.closing = True
            self.changed.notify_all()
        self.thread.join()
        self.check()

    def _run(self) -> None:
        while True:
            with self.changed:
                self.changed.wait_for(lambda: self.scheduled or self.closing)
                if not self.scheduled:
                    return
                self.scheduled = False
            more = True
            while more and not self.error:
                try:
                    more = self.work()
                except Exception as e:  # noqa: BLE001 - kept for the writers
                    self.error = e
                with self.changed:
                    self.rounds, self.useful = self.rounds + 1, more
                    self.changed.notify_all()
            if self.error:
                return
