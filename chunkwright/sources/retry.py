"""Retries with full jitter. Spark's own task retries start a whole task anew; this layer is for single requests."""

from __future__ import annotations

import random
import socket
import time
from collections.abc import Callable
from typing import TypeVar

from chunkwright.errors import RetryExhaustedError
from chunkwright.sources.hooks import Hooks, fire

# What is worth another attempt, and how long to wait
RETRYABLE_STATUS = frozenset({429, 500, 502, 503, 504})
RETRYABLE_NAMES = frozenset({"ThrottlingException", "SlowDown", "TimeoutError"})
BASE_DELAY_MS, CAP_DELAY_MS = 100, 10_000
MAX_RETRIES, TIMEOUT_MS = 3, 30_000

R = TypeVar("R")


def status_of(error: BaseException) -> int | None:
    for name in ("status", "code"):
        value = getattr(error, name, None)
        if isinstance(value, int) and not isinstance(value, bool):
            return value
    return None


def is_retryable(error: BaseException | None) -> bool:
    """Throttling, passing server errors, timeouts and broken connections, themselves or as a cause."""
    depth = 0
    while error is not None and depth < 4:
        if status_of(error) in RETRYABLE_STATUS or type(error).__name__ in RETRYABLE_NAMES:
            return True
        if isinstance(error, ConnectionResetError | ConnectionRefusedError | ConnectionAbortedError | BrokenPipeError | TimeoutError):
            return True
        if isinstance(error, socket.gaierror) and error.errno == socket.EAI_AGAIN:
            return True
        reason = getattr(error, "reason", None)
        error = error.__cause__ or (reason if isinstance(reason, BaseException) else None)
        depth += 1
    return False


def full_jitter_ms(attempt: int, base: float = BASE_DELAY_MS, cap: float = CAP_DELAY_MS) -> float:
    return random.uniform(0, min(cap, base * 2**attempt))


def with_retries(operation: Callable[[], R], retries: int = MAX_RETRIES, hooks: Hooks | None = None, base: float = BASE_DELAY_MS, cap: float = CAP_DELAY_MS) -> R:
    """Errors that aren't retryable pass unchanged; the others end in RetryExhaustedError."""
    for attempt in range(retries + 1):
        try:
            return operation()
        except Exception as error:
            if not is_retryable(error):
                raise
            if attempt == retries:
                raise RetryExhaustedError(retries + 1, error) from error
            seen = error
            fire(hooks and hooks.retry, lambda: {"attempt": attempt + 1, "status": status_of(seen), "error": str(seen)})  # noqa: B023
            time.sleep(full_jitter_ms(attempt, base, cap) / 1000)
    raise AssertionError("unreachable")
