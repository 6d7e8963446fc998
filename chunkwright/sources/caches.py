"""Caches: decoded chunks in memory, raw chunks on a local disk, metadata in a shared key-value store."""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
import threading
import time
from abc import ABC, abstractmethod
from collections import OrderedDict
from collections.abc import Callable

from chunkwright.errors import StoreError
from chunkwright.sources.hooks import Hooks, fire

#: What a cached empty value means for metadata: the key is known to be absent.
ABSENT = b""


class Cache(ABC):
    """Adapters for shared caches implement this."""

    @abstractmethod
    def get(self, key: str) -> bytes | None: ...

    @abstractmethod
    def set(self, key: str, value: bytes, ttl_ms: float | None = None) -> None: ...

    def has(self, key: str) -> bool:
        return self.get(key) is not None


def scope_key(store_id: str, key: str) -> str:
    return f"{store_id}:{key}"


class MemoryCache:
    """Least recently used values go when the bytes exceed the limit; the newest always stays."""

    def __init__(self, max_bytes: int, on_evict: Callable[[str], None] | None = None):
        if max_bytes <= 0:
            raise ValueError("max_bytes must be above 0")
        self.max_bytes, self.total_bytes = max_bytes, 0
        self._entries: OrderedDict[str, bytes] = OrderedDict()
        self._on_evict = on_evict
        self._lock = threading.RLock()

    @staticmethod
    def _cost(key: str, value: bytes) -> int:
        return len(value) or len(key) + 16

    def get(self, key: str) -> bytes | None:
        with self._lock:
            if key not in self._entries:
                return None
            self._entries.move_to_end(key)
            return self._entries[key]

    def set(self, key: str, value: bytes) -> None:
        with self._lock:
            self.delete(key)
            self._entries[key] = value
            self.total_bytes += self._cost(key, value)
            while self.total_bytes > self.max_bytes and len(self._entries) > 1:
                old, dropped = self._entries.popitem(last=False)
                self.total_bytes -= self._cost(old, dropped)
                if self._on_evict:
                    self._on_evict(old)

    def delete(self, key: str) -> None:
        with self._lock:
            if key in self._entries:
                self.total_bytes -= self._cost(key, self._entries.pop(key))

    def clear(self) -> None:
        with self._lock:
            self._entries.clear()
            self.total_bytes = 0

    def __len__(self) -> int:
        return len(self._entries)


class InMemoryCache(Cache):
    """A MemoryCache whose values can expire."""

    def __init__(self, max_bytes: int):
        self._expiry: dict[str, float] = {}
        self._lru = MemoryCache(max_bytes, lambda key: self._expiry.pop(key, None))

    def get(self, key: str) -> bytes | None:
        if key in self._expiry and time.monotonic() * 1000 >= self._expiry[key]:
            self._lru.delete(key)
            del self._expiry[key]
        return self._lru.get(key)

    def set(self, key: str, value: bytes, ttl_ms: float | None = None) -> None:
        self._expiry.pop(key, None)
        if ttl_ms is not None:
            self._expiry[key] = time.monotonic() * 1000 + ttl_ms
        self._lru.set(key, value)


class RedisCache(Cache):
    """Any client with get, set(px=) and exists; a URL needs the redis package, imported at first use."""

    def __init__(self, client_or_url: object, **options: object):
        self._client = None if isinstance(client_or_url, str) else client_or_url
        self._url, self._options = client_or_url, options

    def _connected(self):
        if self._client is None:
            try:
                import redis
            except ImportError as error:
                raise StoreError("a cache URL needs the redis package") from error
            self._client = redis.Redis.from_url(self._url, **self._options)
        return self._client

    def get(self, key: str) -> bytes | None:
        value = self._connected().get(key)
        return None if value is None else bytes(value)

    def set(self, key: str, value: bytes, ttl_ms: float | None = None) -> None:
        client = self._connected()
        if ttl_ms is None:
            client.set(key, value)
        else:
            client.set(key, value, px=int(ttl_ms))

    def has(self, key: str) -> bool:
        return bool(self._connected().exists(key))


class DiskCache:
    """Raw chunks in a folder of one machine: a cache only, each executor's own. Oldest-written files go first; write failures are ignored."""

    def __init__(self, folder: str, store_id: str, ttl_ms: float | None = None, max_bytes: float | None = None):
        if max_bytes is not None and not max_bytes > 0:
            raise ValueError("max_bytes must be above 0")
        self.folder = os.path.join(folder, hashlib.sha256(store_id.encode()).hexdigest()[:16])
        self.ttl_ms, self.max_bytes = ttl_ms, max_bytes

    def path_for(self, key: str) -> str:
        return os.path.join(self.folder, key)

    def get(self, key: str) -> bytes | None:
        try:
            if self.ttl_ms is not None and (time.time() - os.stat(self.path_for(key)).st_mtime) * 1000 >= self.ttl_ms:
                return None
            with open(self.path_for(key), "rb") as source:
                return source.read()
        except OSError:
            return None

    def set(self, key: str, value: bytes) -> None:
        path = self.path_for(key)
        fresh = f"{path}.tmp.{os.getpid()}.{threading.get_ident()}"
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(fresh, "wb") as out:
                out.write(value)
            os.replace(fresh, path)
        except OSError:
            with contextlib.suppress(OSError):
                os.unlink(fresh)
        if self.max_bytes is not None:
            self._evict()

    def _evict(self) -> None:
        files = []
        for top, _, names in os.walk(self.folder):
            for name in names:
                with contextlib.suppress(OSError):
                    if ".tmp." not in name:
                        state = os.stat(path := os.path.join(top, name))
                        files.append((state.st_mtime_ns, state.st_size, path))
        total = sum(size for _, size, _ in files)
        for _, size, path in sorted(files):
            if total <= self.max_bytes:
                break
            with contextlib.suppress(OSError):
                os.unlink(path)
                total -= size

    def clear(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class MetadataContext:
    """A shared cache for metadata documents, and the name of the store they belong to."""

    def __init__(self, cache: Cache, store_id: str, hooks: Hooks | None = None):
        self.cache, self.store_id, self.hooks = cache, store_id, hooks


def read_metadata(store, key: str, context: MetadataContext | None = None) -> bytes | None:
    """Cache, then store, then cache again; absence is remembered too, and a failing cache is passed by."""
    if context is None:
        return store.get(key)
    scoped, hooks = scope_key(context.store_id, key), context.hooks
    cached = None
    with contextlib.suppress(Exception):
        cached = context.cache.get(scoped)
    if cached is not None:
        fire(hooks and hooks.cache_hit, lambda: {"tier": "shared", "key": key})
        return cached if len(cached) else None
    fire(hooks and hooks.cache_miss, lambda: {"tier": "shared", "key": key})
    value = store.get(key)
    with contextlib.suppress(Exception):
        context.cache.set(scoped, ABSENT if value is None else value)
    return value
