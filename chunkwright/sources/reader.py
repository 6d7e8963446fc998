"""Reading chunks: fetch, decode, cut to the selection. Used alike by Spark tasks and local reads."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from math import isfinite, prod
from warnings import warn

import numpy as np
import pyarrow as pa

from chunkwright.errors import CodecError, MissingChunkError
from chunkwright.functions import indexing
from chunkwright.functions.codecs import codec_registry
from chunkwright.functions.dtypes import fill_scalar, native, to_arrow
from chunkwright.functions.indexing import Box
from chunkwright.functions.metadata import ArrayMeta
from chunkwright.sources.caches import MemoryCache
from chunkwright.sources.hooks import Hooks, fire
from chunkwright.sources.limiter import ByteLimiter
from chunkwright.sources.stores import Store

#: Rows of one Arrow batch.
BATCH_ROWS = 1 << 17


@dataclass
class Handle:
    """One array in a store: all a task needs to read it."""

    store: Store
    path: str
    meta: ArrayMeta
    codecs: dict = field(default_factory=dict)  # registrations that executors lack
    #: Names what is cached of this array. It is fixed when the array is opened and travels with it, so no two stores
    #: share cached chunks, and an array opened again sees what its store holds by then.
    scope: str = field(default_factory=lambda: uuid.uuid4().hex)

    def key(self, coordinate: Sequence[int]) -> str:
        name = indexing.chunk_key(coordinate, self.meta.separator)
        return f"{self.path}/{name}" if self.path else name

    def decoder(self):
        for name, factory in self.codecs.items():
            codec_registry.register(name, factory)
        return codec_registry.get(self.meta.compressor) if self.meta.compressor else None


@dataclass
class ReadOptions:
    strict: bool = False
    byte_range: bool = True
    concurrency: int = 50
    memory_cache: MemoryCache | None = None
    cache_scope: str = ""
    max_in_flight_bytes: float = 256 << 20
    large_read_warning_bytes: float = 512 << 20
    hooks: Hooks | None = None


def peak_bytes(meta: ArrayMeta) -> int:
    """What decoding one chunk takes at its worst: packed and plain bytes, and a copy to swap."""
    kind = meta.element()
    size = prod(meta.chunks) * kind.size
    return size * (2 if meta.compressor else 1) + (size if kind.big_endian else 0)


@dataclass
class Chunk:
    """The cells of a selection in one chunk: where they begin, their values, and how they were got."""

    start: tuple[int, ...]
    values: np.ndarray
    key: str
    missing: bool
    fetched: int  # bytes from the store
    offset: int | None  # of a byte range
    decode_ms: float
    cached: bool


def read_chunk(handle: Handle, coordinate: Sequence[int], box: Box, options: ReadOptions, decode=None) -> Chunk:
    meta, kind, hooks = handle.meta, handle.meta.element(), options.hooks
    part = indexing.inside(coordinate, meta.chunks, box)
    data_part = [(max(a, lo), min(b, hi)) for (a, b), (lo, hi) in zip(part, indexing.within_shape(coordinate, meta.chunks, meta.shape), strict=True)]
    start = tuple(i * c + a for i, c, (a, _) in zip(coordinate, meta.chunks, part, strict=True))
    shape = tuple(b - a for a, b in part)
    key = handle.key(coordinate)
    scoped = f"{options.cache_scope}:{key}"
    decoded, fetched, offset, took, cached = None, 0, None, 0.0, False

    if options.memory_cache is not None:
        decoded = options.memory_cache.get(scoped)
        cached = decoded is not None
        fire(hooks and (hooks.cache_hit if cached else hooks.cache_miss), lambda: {"tier": "memory", "key": key})
    span = None
    if decoded is None and options.byte_range and meta.compressor is None and meta.order == "C" and handle.store.ranged and options.memory_cache is None:
        span = indexing.byte_span(part, meta.chunks, kind.size)
    if span is not None:
        offset = span[0]
        raw = handle.store.get_range(key, *span)
    elif decoded is None:
        raw = handle.store.get(key)
    else:
        raw = b""
    if raw is None:
        fire(hooks and hooks.missing_chunk, lambda: {"key": key})
        if options.strict:
            raise MissingChunkError(key)
        return Chunk(start, np.full(shape, fill_scalar(meta.fill_value, kind)), key, True, 0, None, 0.0, False)
    fetched = len(raw)
    if decoded is None:
        began = time.perf_counter()
        decoded = decode(raw) if decode else raw
        took = (time.perf_counter() - began) * 1000
        fire(hooks and hooks.chunk_decoded, lambda: {"bytes": len(decoded), "codec": (meta.compressor or {}).get("id"), "decode_ms": took})
        if options.memory_cache is not None:
            options.memory_cache.set(scoped, decoded)
    if span is not None:
        stored = np.frombuffer(decoded, dtype=kind.stored).reshape(shape)
        cells = tuple(slice(lo - a, max(lo, hi) - a) for (lo, hi), (a, _) in zip(data_part, part, strict=True))
    else:
        if len(decoded) < prod(meta.chunks) * kind.size:
            raise CodecError(f"{key}: {len(decoded)} bytes for a chunk of {prod(meta.chunks) * kind.size}")
        stored = np.frombuffer(decoded, dtype=kind.stored, count=prod(meta.chunks)).reshape(meta.chunks, order=meta.order)
        cells = tuple(slice(lo, max(lo, hi)) for lo, hi in data_part)
    values = native(stored[cells])
    if values.shape != shape:  # what lies beyond the array's shape is fill, never padding
        whole = np.full(shape, fill_scalar(meta.fill_value, kind))
        whole[tuple(slice(lo - a, lo - a + n) for (lo, _), (a, _), n in zip(data_part, part, values.shape, strict=True))] = values
        values = whole
    return Chunk(start, values, key, False, fetched, offset, took, cached)


def cell_batches(chunk: Chunk, kinds: list, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (i0, ..., values) in C order, in batches of bounded size: slabs of the first dimensions."""
    shape = chunk.values.shape
    total = prod(shape)
    for low in range(0, total, BATCH_ROWS):
        high = min(total, low + BATCH_ROWS)
        rest, index = np.arange(low, high, dtype=np.int64), []
        for n, first in zip(reversed(shape), reversed(chunk.start), strict=True):
            rest, i = np.divmod(rest, n)
            index.append(i + first)
        arrays = [pa.array(i) for i in reversed(index)]
        arrays += [to_arrow(np.ascontiguousarray(c).ravel()[low:high], kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def prefetched[K, V](work: Callable[[K], V], keys: Iterable[K], window: int) -> Iterator[V]:
    """``work`` of each key, in order, with at most ``window`` results begun and not yet taken."""
    if window <= 1:
        yield from map(work, keys)
        return
    pool, begun = ThreadPoolExecutor(window), deque()
    try:
        for key in keys:
            begun.append(pool.submit(work, key))
            if len(begun) >= window:
                yield begun.popleft().result()
        while begun:
            yield begun.popleft().result()
    finally:
        pool.shutdown(wait=True, cancel_futures=True)


def warn_of_size(handles: Iterable[Handle], box: Box, bytes_allowed: float) -> None:
    """Warn if a selection's decoded cells exceed the bytes; an infinite number means never."""
    size = sum(indexing.volume(box) * h.meta.element().size for h in handles)
    if isfinite(bytes_allowed) and size > bytes_allowed:
        warn(f"a selection of {size} bytes is above the {bytes_allowed:g} at which to warn", stacklevel=4)


def read_array(handle: Handle, selection=None, options: ReadOptions | None = None, limiter: ByteLimiter | None = None) -> np.ndarray:
    """A selection as one dense array in this process: for coordinates and other small arrays.

    Chunks are fetched by threads, under a budget of bytes; the first error stops the rest.
    """
    options = options or ReadOptions()
    meta, kind = handle.meta, handle.meta.element()
    box = indexing.normalize(selection, meta.shape)
    size = indexing.volume(box) * kind.size
    if isfinite(options.large_read_warning_bytes) and size > options.large_read_warning_bytes:
        warn(f"reading {size} bytes of {handle.path or 'the root array'} into one process", stacklevel=2)
    out = np.full([b - a for a, b in box], fill_scalar(meta.fill_value, kind))
    if not out.size:
        return out
    limiter = limiter or ByteLimiter(options.max_in_flight_bytes, options.hooks and options.hooks.in_flight)
    decode, cost = handle.decoder(), peak_bytes(meta)

    def one(coordinate: tuple[int, ...]) -> None:
        limiter.acquire(cost)
        try:
            chunk = read_chunk(handle, coordinate, box, options, decode)
            out[tuple(slice(s - a, s - a + n) for s, (a, _), n in zip(chunk.start, box, chunk.values.shape, strict=True))] = chunk.values
        finally:
            limiter.release(cost)

    waiting = indexing.coordinates(indexing.chunk_box(box, meta.chunks))
    with ThreadPoolExecutor(max(1, options.concurrency)) as pool:
        running = set()
        for coordinate in waiting:
            running.add(pool.submit(one, coordinate))
            if len(running) >= 2 * options.concurrency:
                done, running = wait(running, return_when=FIRST_EXCEPTION)
                if any(f.exception() for f in done):
                    break
                running -= done
        else:
            done = set()
        errors = [f.exception() for f in {*done, *running} if f.exception()]
    if errors:
        raise errors[0]
    return out
