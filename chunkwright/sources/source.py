"""The Spark data source ``chunked``: an array, or several of one shape, as rows.

Options: ``handles`` (pickled, set by ``Array``) or ``path`` and ``array``;
``selection`` (JSON); ``layout``: cells (i0.., values), chunks (key,
chunk_coord, nbytes, raw) or events (what was fetched); ``strict``;
``bounds``: fill or error; ``byte_range``: auto or off; ``max_partition_bytes``;
``min_partitions``; ``pushdown``: on or off; ``cache_dir``; ``cache_bytes``; ``memory_cache_bytes``; ``variables`` (JSON);
``concurrency``: chunks that a task has in flight, under ``max_in_flight_bytes``; ``hooks``: pickled, called in the executors' Python workers.

A task fetches and decodes chunks ahead of the one it emits, as many as both limits
allow, so the latency of a remote store is paid once for each window and not for each chunk.

Partitions are runs of the selection's chunk grid, numbered, never listed: the
driver plans a grid of any size with the same few numbers.  Comparisons of index
columns with literals are pushed down and shrink the box before planning, and lists of
values skip the chunks that hold none; Spark
still applies them afterwards, as one side of a chunk may not meet them.
"""

from __future__ import annotations

import base64
import json
import time
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import prod

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from chunkwright.errors import MetadataError, SliceError
from chunkwright.functions import indexing
from chunkwright.functions.codecs import codec_registry
from chunkwright.functions.indexing import Box
from chunkwright.runtime import ship
from chunkwright.sources.caches import MemoryCache
from chunkwright.sources.hooks import Hooks
from chunkwright.sources.limiter import ByteLimiter
from chunkwright.sources.reader import Chunk, Handle, ReadOptions, cell_batches, peak_bytes, prefetched, read_chunk
from chunkwright.sources.stores import CachedStore, open_store

FORMAT = "chunked"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Decoded bytes of a partition.
MAX_PARTITION_BYTES = 64 << 20
#: Chunks that a task has in flight, and what decoding them may take at its worst.
CONCURRENCY, IN_FLIGHT_BYTES = 50, 64 << 20

_EVENTS = "key string, chunk_coord array<bigint>, missing boolean, cached boolean, fetched_bytes bigint, range_offset bigint, cells bigint, decode_ms double, fetch_ms double"
_CHUNKS = "key string, chunk_coord array<bigint>, nbytes bigint, raw binary"

#: Decoded chunks that a Python worker keeps between tasks, if asked to.
_WORKER_CACHE: dict[int, MemoryCache] = {}


def pack(what: dict[str, Handle] | Hooks) -> str:
    return base64.b64encode(cloudpickle.dumps(what)).decode()


def unpack(text: str):
    return cloudpickle.loads(base64.b64decode(text))


@dataclass
class ChunkRun(InputPartition):
    """Chunks first..last (excluded) of the selection's chunk grid, counted in C order."""

    first: int
    last: int

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class ChunkedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def __init__(self, options):
        super().__init__(options)
        self._handles: dict[str, Handle] | None = None

    def handles(self) -> dict[str, Handle]:
        if self._handles is None:
            if "handles" in self.options:
                self._handles = unpack(self.options["handles"])
            else:
                from chunkwright.operators.array import open_handle

                if "path" not in self.options:
                    raise MetadataError("the option path is missing")
                store = open_store(self.options["path"])
                names = json.loads(self.options["variables"]) if "variables" in self.options else [self.options.get("array", "")]
                found = {n: open_handle(store, n) for n in names}
                self._handles = found if "variables" in self.options else {"value": found[names[0]]}
            shapes = {(h.meta.shape, h.meta.chunks) for h in self._handles.values()}
            if len(shapes) > 1:
                raise MetadataError("variables of one scan need the same shape and chunks; join them on their index columns instead")
            cache = self.options.get("cache_dir")
            if cache:
                limit = self.options.get("cache_bytes")
                self._handles = {n: replace(h, store=CachedStore(h.store, cache, max_bytes=float(limit) if limit else None)) for n, h in self._handles.items()}
        return self._handles

    def schema(self) -> T.StructType | str:
        layout = self.options.get("layout", "cells")
        if layout in ("chunks", "events"):
            return _CHUNKS if layout == "chunks" else _EVENTS
        handles = self.handles()
        meta = next(iter(handles.values())).meta
        index = [T.StructField(f"i{d}", T.LongType(), False) for d in range(len(meta.shape))]
        return T.StructType(index + [T.StructField(n, h.meta.element().spark, False) for n, h in handles.items()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        # Where the session's push-down is off, Spark refuses readers that can push.
        kind = ChunkedReader if self.options.get("pushdown", "on") == "off" else PushingReader
        return kind(self.handles(), dict(self.options))


class ChunkedReader(DataSourceReader):
    def __init__(self, handles: dict[str, Handle], options: dict[str, str]):
        self.named, self.options = handles, options
        self.meta = next(iter(handles.values())).meta
        selection = json.loads(options["selection"]) if "selection" in options else None
        self.box: Box = indexing.normalize(selection, self.meta.shape)
        self.only: dict[int, list[int]] = {}  # sorted indices of a dimension that alone are wanted
        if options.get("bounds", "fill") == "error" and any(a < 0 or b > n for (a, b), n in zip(self.box, self.meta.shape, strict=True)):
            raise SliceError(f"the selection {self.box} leaves the shape {self.meta.shape}")

    def partitions(self) -> list[InputPartition]:
        grid = indexing.chunk_box(self.box, self.meta.chunks)
        count = indexing.volume(grid)
        if indexing.volume(self.box) == 0:
            return []
        # Cells weigh more than stored elements: an index column for each dimension.
        decoded = sum(peak_bytes(h.meta) for h in self.named.values()) + prod(self.meta.chunks) * 8 * len(self.meta.shape)
        each = max(1, int(self.options.get("max_partition_bytes", MAX_PARTITION_BYTES)) // max(1, decoded))
        parts = min(count, max(-(-count // each), int(self.options.get("min_partitions", 1))))
        return [ChunkRun(count * i // parts, count * (i + 1) // parts) for i in range(parts)]

    def read(self, partition: ChunkRun | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of a plan without partitions
            return
        grid = indexing.chunk_box(self.box, self.meta.chunks)
        layout, handles = self.options.get("layout", "cells"), list(self.named.values())
        limit = int(self.options.get("memory_cache_bytes", 0))
        cache = _WORKER_CACHE.setdefault(limit, MemoryCache(limit)) if limit else None
        hooks = unpack(self.options["hooks"]) if "hooks" in self.options else None
        strict, byte_range = self.options.get("strict", "false").lower() == "true", self.options.get("byte_range", "auto") != "off"
        options = [ReadOptions(strict=strict, byte_range=byte_range, memory_cache=cache, cache_scope=h.scope, hooks=hooks) for h in handles]
        decoders = [h.decoder() for h in handles]
        names = [f"i{d}" for d in range(len(self.meta.shape))] + list(self.named)
        kinds = [h.meta.element() for h in handles]
        budget, cost = float(self.options.get("max_in_flight_bytes", IN_FLIGHT_BYTES)), sum(peak_bytes(h.meta) for h in handles)
        window = max(1, min(int(self.options.get("concurrency", CONCURRENCY)), int(budget // max(1, cost)), partition.last - partition.first))
        limiter = ByteLimiter(budget, hooks and hooks.in_flight)

        def raw_chunks(at: tuple[int, ...]) -> list[tuple[str, bytes | None]]:
            return [(h.key(at), h.store.get(h.key(at))) for h in handles]

        def decoded(at: tuple[int, ...]) -> tuple[tuple[int, ...], list[Chunk], float]:
            began = time.perf_counter()
            limiter.acquire(cost)
            try:
                chunks = [read_chunk(h, at, self.box, o, d) for h, o, d in zip(handles, options, decoders, strict=True)]
            finally:
                limiter.release(cost)
            return at, chunks, (time.perf_counter() - began) * 1000

        coordinates = [at for at in (indexing.nth_coordinate(grid, n) for n in range(partition.first, partition.last)) if self._wanted(at)]
        if layout == "chunks":
            for at, found in zip(coordinates, prefetched(raw_chunks, coordinates, window), strict=True):
                for key, raw in found:
                    if raw is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([list(at)], pa.list_(pa.int64())), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], names=["key", "chunk_coord", "nbytes", "raw"])
            return
        for at, chunks, took in prefetched(decoded, coordinates, window):
            if layout == "events":
                rows = [(c.key, list(at), c.missing, c.cached, c.fetched, c.offset, c.values.size, c.decode_ms, took) for c in chunks]
                types = [pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _EVENTS.split(", ")])
            else:
                yield from cell_batches(chunks[0], kinds, [c.values for c in chunks], names)


    def _wanted(self, at: tuple[int, ...]) -> bool:
        """Whether a chunk holds one of the wanted indices in each dimension that names them."""
        for d, values in self.only.items():
            k = bisect_left(values, at[d] * self.meta.chunks[d])
            if k == len(values) or values[k] >= (at[d] + 1) * self.meta.chunks[d]:
                return False
        return True


class PushingReader(ChunkedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Shrink the box; every filter goes back to Spark, which applies it to the rows."""
        for f in filters:
            d = self._dimension(f)
            if d is not None:
                self.box[d] = self._narrowed(f, *self.box[d])
                if isinstance(f, In) and all(isinstance(v, int) for v in f.value):
                    self.only[d] = sorted(set(f.value) & set(self.only.get(d, f.value)))
            yield f

    def _dimension(self, f: Filter) -> int | None:
        name = getattr(f, "attribute", ("",))
        known = [f"i{d}" for d in range(len(self.meta.shape))]
        if len(name) != 1 or name[0] not in known or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In):
            return None
        return known.index(name[0])

    @staticmethod
    def _narrowed(f: Filter, low: int, high: int) -> tuple[int, int]:
        if isinstance(f, In):
            values = [v for v in f.value if isinstance(v, int)]
            first, stop = (min(values), max(values) + 1) if len(values) == len(f.value) and values else (low, high)
        elif not isinstance(f.value, int):
            first, stop = low, high
        elif isinstance(f, EqualTo):
            first, stop = f.value, f.value + 1
        else:
            first = f.value + isinstance(f, GreaterThan) if isinstance(f, GreaterThan | GreaterThanOrEqual) else low
            stop = f.value + isinstance(f, LessThanOrEqual) if isinstance(f, LessThan | LessThanOrEqual) else high
        first, stop = max(low, first), min(high, stop)
        return (first, stop) if first < stop else (low, low)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filter push-down."""
    ship(spark)
    spark.dataSource.register(ChunkedSource)
    spark.conf.set(PUSHDOWN, "true")


def custom_codecs() -> dict:
    return codec_registry.custom()
