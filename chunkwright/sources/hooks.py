"""Observability: handlers for what happens during a read. Their errors never reach the reader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

Handler = Callable[[Any], None]


@dataclass
class Hooks:
    """Each handler gets a dict (in_flight: a number of bytes)."""

    cache_hit: Handler | None = None  # tier, key
    cache_miss: Handler | None = None  # tier, key
    store_fetch: Handler | None = None  # key, bytes, latency_ms
    retry: Handler | None = None  # attempt, status, error
    chunk_decoded: Handler | None = None  # bytes, codec, decode_ms
    in_flight: Handler | None = None
    missing_chunk: Handler | None = None  # key


def fire(handler: Handler | None, make: Callable[[], Any]) -> None:
    """Call a handler; without one, nothing is even built."""
    if handler is None:
        return
    try:
        handler(make())
    except Exception:  # a handler must never break a read
        return
