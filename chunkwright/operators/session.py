"""Opened datasets that are used again and again: handles, decoded chunks and coordinates are kept."""

from __future__ import annotations

import contextlib
import threading
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.operators.array import Array, Group, OpenOptions, open_group
from chunkwright.sources.caches import Cache, MemoryCache
from chunkwright.sources.hooks import Hooks
from chunkwright.sources.reader import ReadOptions
from chunkwright.sources.stores import CachedStore, Store

COORDINATE_PREFIX = "coord:"


@dataclass
class RegistryOptions:
    max_datasets: int = 32
    chunk_memory_cache_bytes: int = 0
    metadata_cache: Cache | None = None
    coordinate_cache: Cache | None = None
    disk_cache_dir: str | None = None
    disk_cache_bytes: float | None = None
    disk_ttl: float | None = None
    hooks: Hooks | None = None


class Dataset:
    def __init__(self, name: str, group: Group, options: RegistryOptions):
        self.name, self.group, self.options = name, group, options
        size = options.chunk_memory_cache_bytes
        self.memory_cache = MemoryCache(size) if size > 0 else None
        self._decoded: dict[tuple[str, str], np.ndarray] = {}
        self._arrays: dict[str, Array] = {}
        self._locks: dict[tuple[str, str], threading.Lock] = {}
        self._guard = threading.Lock()

    def get_array(self, name: str) -> Array:
        return self.group.get_array(name)

    def read(self, name: str, selection: Sequence | None = None, **options: object) -> DataFrame:
        """A selection as rows; with a chunk cache, Python workers keep decoded chunks between tasks. The registry's hooks go with it."""
        if self.options.chunk_memory_cache_bytes > 0:
            options.setdefault("memory_cache_bytes", self.options.chunk_memory_cache_bytes)
        if self.options.hooks is not None:
            options.setdefault("hooks", self.options.hooks)
        return self._array(name).get(selection, **options)

    def _array(self, name: str) -> Array:
        """One handle for each array, so that what is cached of it is found again."""
        with self._guard:
            if name not in self._arrays:
                self._arrays[name] = self.get_array(name)
            return self._arrays[name]

    def to_numpy(self, name: str, selection: Sequence | None = None, options: ReadOptions | None = None) -> np.ndarray:
        options = options or ReadOptions()
        return self.get_array(name).to_numpy(selection, replace(options, memory_cache=self.memory_cache, cache_scope=self.name, hooks=options.hooks or self.options.hooks))

    def decoded_array(self, name: str, cache_key: str | None = None, ttl_ms: float | None = None, options: ReadOptions | None = None) -> np.ndarray:
        """A whole small array as doubles: from this handle, else from the shared cache, else from the store. One reader at a time reads a given array."""
        at = (name, cache_key or "")
        with self._guard:
            lock = self._locks.setdefault(at, threading.Lock())
        with lock:
            if at in self._decoded:
                return self._decoded[at]
            shared = self.options.coordinate_cache if cache_key else None
            key = f"{COORDINATE_PREFIX}{cache_key}:{name}"
            if shared is not None:
                with contextlib.suppress(Exception):
                    if (kept := shared.get(key)) is not None and len(kept) >= 8:
                        self._decoded[at] = np.frombuffer(bytes(kept)[: len(kept) // 8 * 8], dtype="<f8")
                        return self._decoded[at]
            values = self._decoded[at] = self.to_numpy(name, None, options).ravel().astype("<f8")
            if shared is not None:
                with contextlib.suppress(Exception):
                    shared.set(key, values.tobytes(), ttl_ms)
            return values

    def decoded_df(self, name: str) -> DataFrame:
        """``decoded_array`` as rows, read by Spark."""
        found = self.read(name)
        return found.withColumn("value", F.col("value").cast("double"))


class DatasetRegistry:
    """The most recently used datasets; opens of one name at a time become one."""

    def __init__(self, spark: SparkSession, options: RegistryOptions | None = None):
        self.spark, self.options = spark, options or RegistryOptions()
        if self.options.max_datasets <= 0:
            raise ValueError("max_datasets must be above 0")
        self._entries: OrderedDict[str, Dataset] = OrderedDict()
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def __len__(self) -> int:
        return len(self._entries)

    def clear(self) -> None:
        with self._guard:
            self._entries.clear()

    def _known(self, name: str) -> Dataset | None:
        with self._guard:
            if name in self._entries:
                self._entries.move_to_end(name)
            return self._entries.get(name)

    def open(self, name: str, make_store: Callable[[], Store]) -> Dataset:
        """``make_store`` is called only where the dataset isn't open."""
        with self._guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            found = self._known(name)
            if found is None:
                found = self._build(name, make_store())
                with self._guard:
                    self._entries[name] = found
                    while len(self._entries) > self.options.max_datasets:
                        self._entries.popitem(last=False)
            return found

    def _build(self, name: str, store: Store) -> Dataset:
        o = self.options
        if o.disk_cache_dir:
            store = CachedStore(store, o.disk_cache_dir, ttl=o.disk_ttl, store_id=name, max_bytes=o.disk_cache_bytes, hooks=o.hooks)
        return Dataset(name, open_group(self.spark, store, "", OpenOptions(o.metadata_cache, name, o.hooks)), o)
