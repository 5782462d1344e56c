"""What a Python worker keeps from one task to the next, and forgets when no task comes."""

from __future__ import annotations

import threading
from collections.abc import Callable, Hashable

from sigwright.runtime import release_memory

#: Seconds for which an idle worker keeps it.
IDLE_SECONDS = 3.0


class Kept:
    """One object a worker process: what it has learnt in a task serves the next."""

    def __init__(self):
        self._held: dict[Hashable, object] = {}
        self._timer: threading.Timer | None = None
        self._turn = threading.Lock()

    def get(self, key: Hashable, make: Callable[[], object]) -> object:
        with self._turn:
            if self._timer:
                self._timer.cancel()
                self._timer = None
            if key not in self._held:
                self._held.clear()
                self._held[key] = make()
            return self._held[key]

    def rest(self) -> None:
        """To be called when a task is done with the object."""

        def forget() -> None:
            with self._turn:
                if self._timer is not timer:  # a task came after the timer went off
                    return
                self._timer = None
                self._held.clear()
            release_memory()

        timer = threading.Timer(IDLE_SECONDS, forget)
        timer.daemon = True
        with self._turn:
            if self._timer:
                self._timer.cancel()
            self._timer = timer
        timer.start()
