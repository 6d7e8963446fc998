"""Stores: keys to bytes. ``None`` means that a key is absent; any other failure raises.

A store goes to the executors by pickling, so it holds its settings and opens
its connections where it is used.
"""

from __future__ import annotations

import http.client
import os
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import warnings
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs

from chunkwright.errors import ArrayError, StoreError, UnsupportedOperationError
from chunkwright.functions.metadata import ARRAY_DOC, ATTRS_DOC, CONSOLIDATED_DOC, GROUP_DOC, Reference, parse_manifest
from chunkwright.sources.caches import DiskCache
from chunkwright.sources.hooks import Hooks, fire
from chunkwright.sources.retry import MAX_RETRIES, TIMEOUT_MS, with_retries


#: Requests to one host at a time.
MAX_CONNECTIONS = 50


@dataclass(frozen=True)
class Head:
    """A key's version: what is known of etag, last_modified (seconds) and size."""

    etag: str | None
    last_modified: float | None
    size: int | None


class Store(ABC):
    """Users' stores implement get, has and list; get_range and head are optional."""

    hooks: Hooks | None = None

    @abstractmethod
    def get(self, key: str) -> bytes | None: ...

    @abstractmethod
    def has(self, key: str) -> bool: ...

    @abstractmethod
    def list(self, prefix: str) -> Iterator[str]: ...

    def get_range(self, key: str, offset: int, length: int) -> bytes | None:
        raise UnsupportedOperationError(f"{type(self).__name__} can't read ranges")

    def head(self, key: str) -> Head | None:
        raise UnsupportedOperationError(f"{type(self).__name__} knows no versions")

    @property
    def ranged(self) -> bool:
        return type(self).get_range is not Store.get_range

    def _timed(self, key: str, read) -> bytes | None:
        began = time.perf_counter()
        data = read()
        if data is not None:
            fire(self.hooks and self.hooks.store_fetch, lambda: {"key": key, "bytes": len(data), "latency_ms": (time.perf_counter() - began) * 1000})
        return data


def _checked(data: bytes, length: int, key: str) -> bytes:
    if len(data) != length:
        raise StoreError(f"{key}: {len(data)} bytes where {length} were asked for")
    return data


class MemoryStore(Store):
    """Keys in a dict; for tests and small examples."""

    def __init__(self, data: dict[str, bytes]):
        self.data = data

    def get(self, key: str) -> bytes | None:
        return self.data.get(key)

    def has(self, key: str) -> bool:
        return key in self.data

    def list(self, prefix: str) -> Iterator[str]:
        return iter([k for k in self.data if k.startswith(prefix)])


class FileSystemStore(Store):
    """A folder. ``list`` has one level, relative keys below the prefix; a missing folder is empty."""

    def __init__(self, path: str, hooks: Hooks | None = None):
        self.path, self.hooks = path.removeprefix("file://").rstrip("/") or "/", hooks

    def _place(self, key: str) -> str:
        return os.path.join(self.path, key)

    def get(self, key: str) -> bytes | None:
        def read() -> bytes | None:
            try:
                with open(self._place(key), "rb") as source:
                    return source.read()
            except (FileNotFoundError, NotADirectoryError):
                return None

        return self._timed(key, read)

    def has(self, key: str) -> bool:
        return os.path.exists(self._place(key))

    def list(self, prefix: str) -> Iterator[str]:
        try:
            names = sorted(os.listdir(self._place(prefix)))
        except (FileNotFoundError, NotADirectoryError):
            return
        start = prefix if not prefix or prefix.endswith("/") else f"{prefix}/"
        for name in names:
            yield f"{start}{name}"

    def get_range(self, key: str, offset: int, length: int) -> bytes | None:
        def read() -> bytes | None:
            try:
                with open(self._place(key), "rb") as source:
                    source.seek(offset)
                    return _checked(source.read(length), length, key)
            except (FileNotFoundError, NotADirectoryError):
                return None

        return self._timed(key, read)

    def head(self, key: str) -> Head | None:
        try:
            state = os.stat(self._place(key))
        except (FileNotFoundError, NotADirectoryError):
            return None
        return Head(None, state.st_mtime, state.st_size)


class ArrowStore(Store):
    """A folder of any file system that Arrow reads (file, s3, gs, hdfs), by its URI."""

    def __init__(self, uri: str, hooks: Hooks | None = None):
        self.uri, self.hooks = uri.rstrip("/"), hooks
        self._opened: tuple[pafs.FileSystem, str] | None = None

    def _connect(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_opened": None}

    def _place(self, key: str) -> tuple[pafs.FileSystem, str]:
        if self._opened is None:
            self._opened = self._connect()
        filesystem, base = self._opened
        return filesystem, f"{base}/{key}".rstrip("/")

    def _read(self, key: str, offset: int | None, length: int | None) -> bytes | None:
        filesystem, path = self._place(key)
        try:
            with filesystem.open_input_file(path) as source:
                return source.read() if offset is None else _checked(source.read_at(length, offset), length, key)
        except FileNotFoundError:
            return None

    def get(self, key: str) -> bytes | None:
        return self._timed(key, lambda: with_retries(lambda: self._read(key, None, None), hooks=self.hooks))

    def get_range(self, key: str, offset: int, length: int) -> bytes | None:
        return self._timed(key, lambda: with_retries(lambda: self._read(key, offset, length), hooks=self.hooks))

    def head(self, key: str) -> Head | None:
        filesystem, path = self._place(key)
        info = filesystem.get_file_info(path)
        return None if info.type == pafs.FileType.NotFound else Head(None, info.mtime_ns and info.mtime_ns / 1e9, info.size)

    def has(self, key: str) -> bool:
        return self.head(key) is not None

    def list(self, prefix: str) -> Iterator[str]:
        filesystem, path = self._place(prefix)
        base = self._place("")[1]
        for info in filesystem.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True)):
            if info.type == pafs.FileType.File:
                yield info.path[len(base) :].lstrip("/")


class S3Store(ArrowStore):
    """A bucket and prefix; with an endpoint, keys are addressed by path.

    Arrow keeps the connections open. ``max_connections`` raises the number of threads that it reads with in this process.
    """

    def __init__(
        self,
        bucket: str,
        prefix: str = "",
        region: str | None = None,
        endpoint: str | None = None,
        anonymous: bool = False,
        connect_timeout_ms: int = 3000,
        request_timeout_ms: int = TIMEOUT_MS,
        max_retries: int = MAX_RETRIES,
        warm_on_create: bool = False,
        hooks: Hooks | None = None,
        max_connections: int = MAX_CONNECTIONS,
    ):
        super().__init__(f"s3://{bucket}/{prefix}", hooks)
        self.bucket, self.prefix, self.region, self.endpoint, self.anonymous = bucket, prefix.strip("/"), region, endpoint, anonymous
        self.connect_timeout_ms, self.request_timeout_ms, self.max_retries = connect_timeout_ms, request_timeout_ms, max_retries
        self.max_connections = max_connections
        if warm_on_create:
            threading.Thread(target=self.prewarm, daemon=True).start()

    def _connect(self) -> tuple[pafs.FileSystem, str]:
        pa.set_io_thread_count(max(pa.io_thread_count(), self.max_connections))
        scheme, _, host = (self.endpoint or "").rpartition("://")
        options = {"region": self.region, "endpoint_override": host or None, "scheme": scheme or None, "anonymous": self.anonymous, "connect_timeout": self.connect_timeout_ms / 1000, "request_timeout": self.request_timeout_ms / 1000}
        filesystem = pafs.S3FileSystem(force_virtual_addressing=False, **{k: v for k, v in options.items() if v is not None})
        return filesystem, f"{self.bucket}/{self.prefix}".rstrip("/")

    def prewarm(self) -> None:
        """Open a connection before it is needed; failures don't matter."""
        try:
            self.head(CONSOLIDATED_DOC)
        except Exception:  # best effort
            return


class _Connections:
    """Connections to one host: at most so many at a time, and those that the server leaves open are used again."""

    def __init__(self, url: str, timeout_s: float, most: int, keep_alive: bool):
        self.parts, self.timeout_s, self.keep_alive = urllib.parse.urlsplit(url), timeout_s, keep_alive
        self._idle: deque[http.client.HTTPConnection] = deque()
        self._slots = threading.BoundedSemaphore(most)

    def _fresh(self) -> http.client.HTTPConnection:
        kind = http.client.HTTPSConnection if self.parts.scheme == "https" else http.client.HTTPConnection
        return kind(self.parts.netloc, timeout=self.timeout_s)

    def send(self, method: str, target: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        with self._slots:
            try:
                connection, used = self._idle.pop(), True
            except IndexError:
                connection, used = self._fresh(), False
            while True:
                try:
                    connection.request(method, target, headers=headers)
                    answer = connection.getresponse()
                    found = answer.status, dict(answer.headers), answer.read()
                    break
                except BaseException as error:
                    connection.close()
                    if not used or not isinstance(error, http.client.RemoteDisconnected | ConnectionResetError | BrokenPipeError):
                        raise
                    connection, used = self._fresh(), False  # the server had closed it meanwhile
            if self.keep_alive and not answer.will_close:
                self._idle.append(connection)
            else:
                connection.close()
            return found


class HttpStore(Store):
    """Keys below a base URL. It can't list; ``has`` is false where a request fails.

    Up to ``max_connections`` requests run at a time, over connections that stay open unless ``keep_alive`` is off.
    """

    def __init__(
        self,
        url: str,
        timeout_ms: float = TIMEOUT_MS,
        headers: dict[str, str] | None = None,
        max_retries: int = MAX_RETRIES,
        hooks: Hooks | None = None,
        base_delay_ms: float = 100,
        max_connections: int = MAX_CONNECTIONS,
        keep_alive: bool = True,
    ):
        self.base_url, self.timeout_ms, self.headers = url.rstrip("/"), timeout_ms, headers or {}
        self.max_retries, self.hooks, self.base_delay_ms = max_retries, hooks, base_delay_ms
        self.max_connections, self.keep_alive = max_connections, keep_alive
        self._connections: _Connections | None = None
        self._guard = threading.Lock()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_connections": None, "_guard": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _guard=threading.Lock())

    def _pool(self) -> _Connections:
        with self._guard:
            if self._connections is None:
                self._connections = _Connections(self.base_url, self.timeout_ms / 1000, self.max_connections, self.keep_alive)
            return self._connections

    def _answer(self, url: str, method: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        parts = urllib.parse.urlsplit(url)
        if urllib.request.getproxies().get(parts.scheme) and not urllib.request.proxy_bypass(parts.netloc):
            status = 300  # proxies are the library's business
        else:
            status, fields, body = self._pool().send(method, urllib.parse.urlunsplit(("", "", parts.path, parts.query, "")), headers)
        if 300 <= status < 400:  # so are redirects
            with urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers), timeout=self.timeout_ms / 1000) as answer:
                return answer.status, dict(answer.headers), answer.read()
        if status >= 400:
            raise urllib.error.HTTPError(url, status, http.client.responses.get(status, ""), None, None)
        return status, fields, body

    def _request(self, key: str, method: str = "GET", extra: dict[str, str] | None = None):
        url = f"{self.base_url}/{urllib.parse.quote(key)}"

        def send():
            try:
                return self._answer(url, method, {**self.headers, **(extra or {})})
            except urllib.error.HTTPError as error:
                if error.code == 404:
                    return None
                raise

        try:
            return with_retries(send, self.max_retries, self.hooks, base=self.base_delay_ms)
        except ArrayError:
            raise
        except Exception as error:
            raise StoreError(f"{method} {url}: {error}") from error

    def get(self, key: str) -> bytes | None:
        def read() -> bytes | None:
            answer = self._request(key)
            return None if answer is None else answer[2]

        return self._timed(key, read)

    def get_range(self, key: str, offset: int, length: int) -> bytes | None:
        def read() -> bytes | None:
            answer = self._request(key, extra={"Range": f"bytes={offset}-{offset + length - 1}"})
            if answer is None:
                return None
            status, _, body = answer
            if status == 200:  # the server sent all of it
                body = body[offset : offset + length]
            return _checked(body, length, key)

        return self._timed(key, read)

    def has(self, key: str) -> bool:
        try:
            return self._request(key, "HEAD") is not None
        except StoreError:
            return False

    def head(self, key: str) -> Head | None:
        answer = self._request(key, "HEAD")
        if answer is None:
            return None
        fields = {k.lower(): v for k, v in answer[1].items()}
        size = fields.get("content-length")
        return Head(fields.get("etag"), None, int(size) if size else None)

    def list(self, prefix: str) -> Iterator[str]:
        raise UnsupportedOperationError("an HTTP store can't list keys; consolidated metadata can")


class ReferenceStore(Store):
    """Virtual keys: inline text, whole files, or byte ranges of other files."""

    def __init__(self, spec: str | bytes | dict, decode_base64: bool = False):
        self.refs: dict[str, Reference] = parse_manifest(spec) if isinstance(spec, str | bytes) else dict(spec["refs"])
        self.decode_base64 = decode_base64
        self._stores: dict[str, Store] = {}

    @classmethod
    def from_file(cls, path: str) -> ReferenceStore:
        with open(path.removeprefix("file://"), encoding="utf-8") as source:
            return cls(source.read())

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_stores": {}}

    def __len__(self) -> int:
        return len(self.refs)

    def _target(self, url: str) -> tuple[Store, str]:
        parts = urllib.parse.urlsplit(url)
        if parts.scheme in ("http", "https"):
            root, key = f"{parts.scheme}://{parts.netloc}", parts.path.lstrip("/")
        elif parts.scheme and parts.scheme != "file":
            root, key = f"{parts.scheme}://{parts.netloc}", parts.path.lstrip("/")
        else:
            root, _, key = url.removeprefix("file://").rpartition("/")
            root = root or ("/" if url.startswith("/") else ".")
        if root not in self._stores:
            self._stores[root] = open_store(root)
        return self._stores[root], key

    def get(self, key: str) -> bytes | None:
        ref = self.refs.get(key)
        if ref is None:
            return None
        if isinstance(ref, str):
            if self.decode_base64 and ref.startswith("base64:"):
                import base64

                return base64.b64decode(ref[7:])
            return ref.encode()
        store, target = self._target(ref[0])
        if len(ref) == 1:
            return store.get(target)
        offset, length = int(ref[1]), int(ref[2])
        if store.ranged:
            return store.get_range(target, offset, length)
        data = store.get(target)
        return None if data is None else data[offset : offset + length]

    def has(self, key: str) -> bool:
        return key in self.refs

    def list(self, prefix: str) -> Iterator[str]:
        return iter([k for k in self.refs if k.startswith(prefix)])


_METADATA = (ARRAY_DOC, ATTRS_DOC, GROUP_DOC, CONSOLIDATED_DOC)


class CachedStore(Store):
    """Raw chunks of another store on a local disk. Metadata and ranges pass by; concurrent reads of a key become one."""

    def __init__(self, inner: Store, cache_dir: str, ttl: float | None = None, store_id: str | None = None, skip_local: bool = False, max_bytes: float | None = None, hooks: Hooks | None = None):
        if max_bytes is None and not skip_local:
            warnings.warn(f"the disk cache in {cache_dir} has no max_bytes and can fill the disk", stacklevel=2)
        self.inner, self.skip_local, self.hooks = inner, skip_local, hooks
        # Without a name of its own, a store must not find what another process's store left.
        self.store_id = store_id or derive_store_id(inner) or f"store-{uuid.uuid4().hex}"
        self.cache = DiskCache(cache_dir, self.store_id, None if ttl is None else ttl * 1000, max_bytes)
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_locks": {}, "_guard": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _guard=threading.Lock())

    def get(self, key: str) -> bytes | None:
        if self.skip_local or key.endswith(_METADATA):
            return self.inner.get(key)
        with self._guard:
            lock = self._locks.setdefault(key, threading.Lock())
        with lock:
            cached = self.cache.get(key)
            if cached is not None:
                fire(self.hooks and self.hooks.cache_hit, lambda: {"tier": "disk", "key": key})
                return cached
            fire(self.hooks and self.hooks.cache_miss, lambda: {"tier": "disk", "key": key})
            data = self.inner.get(key)
            if data is not None:
                self.cache.set(key, data)
        with self._guard:
            self._locks.pop(key, None)
        return data

    def get_range(self, key: str, offset: int, length: int) -> bytes | None:
        if self.inner.ranged:
            return self.inner.get_range(key, offset, length)
        data = self.get(key)
        return None if data is None else data[offset : offset + length]

    def head(self, key: str) -> Head | None:
        return self.inner.head(key)

    def has(self, key: str) -> bool:
        return self.inner.has(key)

    def list(self, prefix: str) -> Iterator[str]:
        return self.inner.list(prefix)

    def clear_cache(self) -> None:
        self.cache.clear()


def derive_store_id(store: object, depth: int = 0) -> str | None:
    """A name that is the same in every process, or None."""
    if isinstance(bucket := getattr(store, "bucket", None), str):
        endpoint = getattr(store, "endpoint", None)
        return f"s3://{bucket}/{getattr(store, 'prefix', '') or ''}" + (f"?endpoint={endpoint}" if isinstance(endpoint, str) else "")
    if isinstance(url := getattr(store, "base_url", None), str):
        return url
    inner = getattr(store, "inner", None)
    return derive_store_id(inner, depth + 1) if inner is not None and depth < 4 else None


def open_store(uri: str, **options: object) -> Store:
    """The store of a URI: http(s), s3, reference+PATH (a manifest), any scheme that Arrow reads, or a local folder."""
    if uri.startswith(("http://", "https://")):
        return HttpStore(uri, **options)
    if uri.startswith("s3://"):
        bucket, _, prefix = uri[5:].partition("/")
        return S3Store(bucket, prefix, **options)
    if uri.startswith("reference+"):
        return ReferenceStore.from_file(uri.removeprefix("reference+"))
    if "://" in uri and not uri.startswith("file://"):
        return ArrowStore(uri, **options)
    return FileSystemStore(uri, **options)


