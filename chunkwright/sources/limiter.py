"""A first-come-first-served budget of bytes in flight."""

from __future__ import annotations

import threading
from collections import deque
from math import isfinite

from chunkwright.sources.hooks import Handler, fire


class ByteLimiter:
    """Costs above the capacity count as the whole of it, so a large chunk passes alone; costs that aren't positive are free."""

    def __init__(self, capacity: float, in_flight: Handler | None = None):
        self.capacity = max(1, capacity)
        self.available = self.capacity
        self._changed = threading.Condition()
        self._queue: deque[object] = deque()
        self._in_flight = in_flight

    def _cost(self, cost: float) -> float:
        return min(cost, self.capacity) if isfinite(cost) and cost > 0 else 0

    def acquire(self, cost: float) -> None:
        cost = self._cost(cost)
        if not cost:
            return
        ticket = object()
        with self._changed:
            self._queue.append(ticket)
            self._changed.wait_for(lambda: self._queue[0] is ticket and self.available >= cost)
            self._queue.popleft()
            self.available -= cost
            used = self.capacity - self.available
            self._changed.notify_all()
        fire(self._in_flight, lambda: used)

    def release(self, cost: float) -> None:
        with self._changed:
            self.available = min(self.capacity, self.available + self._cost(cost))
            used = self.capacity - self.available
            self._changed.notify_all()
        fire(self._in_flight, lambda: used)
