"""How many calls a task has under way: a window that follows what the service refuses."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

TOO_MANY = 429


class Window:
    """At most `most` calls at a time, fewer where the service answers that there are too many.

    The window opens at one call. Until the first refusal each reply opens it by one (it doubles with every round of calls),
    afterwards a whole window of replies does. A refusal halves it, once for all calls that were under way together, and no call
    starts for as long as the error's `retry_after` says, or `pause` seconds where it says nothing. Other errors leave it alone.

    Against a service that takes n calls at a time the window moves between n / 2 and n + 1, so about one call in n * 3 / 8 is
    refused; a window of one call is never closed, its waits are those of the retries.
    """

    def __init__(self, most: int, pause: float = 0.0, clock=time.monotonic):
        if most < 1:
            raise ValueError("a window needs at least one call")
        self.most, self.pause, self.clock = most, pause, clock
        self.size, self.under_way, self.refused = 1.0, 0, 0
        self._closed_until = float("-inf")
        self._changed = threading.Condition()

    def call(self, fn: Callable, *args):
        """fn(*args) as soon as the window lets it start."""
        begun = self._enter()
        try:
            result = fn(*args)
        except Exception as error:
            self._leave(begun, refusal=error if getattr(error, "status", None) == TOO_MANY else None, reply=False)
            raise
        self._leave(begun, refusal=None, reply=True)
        return result

    def _enter(self) -> int:
        with self._changed:
            while True:
                wait = self._closed_until - self.clock()
                if wait > 0:
                    self._changed.wait(wait)
                elif self.under_way >= int(self.size):
                    self._changed.wait()
                else:
                    self.under_way += 1
                    return self.refused

    def _leave(self, begun: int, refusal: Exception | None, reply: bool) -> None:
        with self._changed:
            self.under_way -= 1
            if reply:
                self.size = min(self.size + (1.0 if self.refused == 0 else 1.0 / self.size), float(self.most))
            elif refusal is not None:
                if begun == self.refused:  # the first refusal among the calls that were under way with it
                    self.size, self.refused = max(self.size / 2, 1.0), self.refused + 1
                after = getattr(refusal, "retry_after", None)
                self._closed_until = max(self._closed_until, self.clock() + (self.pause if after is None else float(after)))
            self._changed.notify_all()
