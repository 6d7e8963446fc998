"""Opening arrays and groups, and selecting from them as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.errors import ArrayError, MetadataError, SliceError, StoreError
from chunkwright.functions import indexing, metadata
from chunkwright.functions.dtypes import resolve_fill
from chunkwright.functions.metadata import ARRAY_DOC, ATTRS_DOC, CONSOLIDATED_DOC, GROUP_DOC, ArrayMeta, Consolidated
from chunkwright.sources import source
from chunkwright.sources.caches import Cache, MetadataContext, read_metadata
from chunkwright.sources.hooks import Hooks
from chunkwright.sources.limiter import ByteLimiter
from chunkwright.sources.reader import Handle, ReadOptions, read_array, warn_of_size
from chunkwright.sources.stores import Store, derive_store_id, open_store

#: Cells that a selection may have to become one array column.
SERIES_CELLS = 50_000_000


@dataclass
class OpenOptions:
    metadata_cache: Cache | None = None
    store_id: str | None = None
    hooks: Hooks | None = None

    def context(self, store: Store) -> MetadataContext | None:
        """Cached metadata needs a name for its store; that is settled before any request."""
        if self.metadata_cache is None:
            return None
        name = self.store_id or derive_store_id(store)
        if name is None:
            raise StoreError("a metadata cache needs store_id, as this store has no name of its own")
        return MetadataContext(self.metadata_cache, name, self.hooks)


def _below(path: str, name: str) -> str:
    return f"{path}/{name}" if path else name


def _linear(meta: ArrayMeta, box: indexing.Box) -> Column:
    steps = indexing.strides([b - a for a, b in box])
    terms = [(F.col(f"i{d}") - F.lit(a)) * F.lit(s) for d, ((a, _), s) in enumerate(zip(box, steps, strict=True))]
    return sum(terms[1:], terms[0]) if terms else F.lit(0).cast("long")


class Array:
    """An immutable array; ``get`` is a DataFrame that reads when it runs."""

    def __init__(self, spark: SparkSession, handle: Handle):
        self.spark, self.handle = spark, handle
        meta = handle.meta
        self.shape, self.chunks, self.dtype, self.order, self.attrs = meta.shape, meta.chunks, meta.dtype, meta.order, meta.attrs
        self.fill_value = resolve_fill(meta.fill_value)

    @property
    def path(self) -> str:
        return self.handle.path

    def _load(self, selection: Sequence | None, **options: object) -> DataFrame:
        indexing.normalize(selection, self.shape)  # selections that can't be are refused here, not in a task
        return load(self.spark, {"value": self.handle}, selection, **options)

    def get(self, selection: Sequence | None = None, **options: object) -> DataFrame:
        """Rows i0..i{n-1}, value of a selection: per dimension null (all), k, or [start, stop)."""
        self.handle.meta.element()
        return self._load(selection, **options)

    def chunk_table(self, selection: Sequence | None = None, **options: object) -> DataFrame:
        """The stored chunks that a selection touches: key, chunk_coord, nbytes, raw. Absent ones have no row."""
        return self._load(selection, layout="chunks", **options)

    def events(self, selection: Sequence | None = None, **options: object) -> DataFrame:
        """Read a selection and report, per chunk, what was fetched, decoded, cached or missing."""
        return self._load(selection, layout="events", **options)

    def linear(self, selection: Sequence | None = None, **options: object) -> DataFrame:
        """``get`` with the place of each cell in C order of the selection, as column linear."""
        box = indexing.normalize(selection, self.shape)
        return self.get(selection, **options).withColumn("linear", _linear(self.handle.meta, box))

    def series(self, selection: Sequence | None = None, **options: object) -> DataFrame:
        """One row: shape, data (C order). For results of bounded size only."""
        box = indexing.normalize(selection, self.shape)
        if indexing.volume(box) > SERIES_CELLS:
            raise SliceError(f"{indexing.volume(box)} cells don't fit one row; the bound is {SERIES_CELLS}")
        cells = self.linear(selection, **options).agg(F.array_sort(F.collect_list(F.struct("linear", "value"))).alias("cells"))
        return cells.select(F.lit([b - a for a, b in box]).cast("array<bigint>").alias("shape"), F.transform("cells", lambda c: c["value"]).alias("data"))

    def to_numpy(self, selection: Sequence | None = None, options: ReadOptions | None = None, limiter: ByteLimiter | None = None) -> np.ndarray:
        """A selection in this process; for coordinates and other small arrays."""
        return read_array(self.handle, selection, options, limiter)

    def point_series(self, i: int, j: int, **options: object) -> DataFrame:
        """All of the first dimension at one cell of the last two; dimensions between are taken at 0."""
        if len(self.shape) < 2:
            return self.get([None] if not self.shape[1:] else None, **options)
        middle = [0] * max(0, len(self.shape) - 3)
        return self.get([None, *middle, i, j] if len(self.shape) > 2 else [i, j], **options)


def load(spark: SparkSession, handles: dict[str, Handle], selection: Sequence | None = None, **options: object) -> DataFrame:
    """A scan of arrays of one shape and chunking: their selection as rows, a column for each.

    ``hooks`` (a ``Hooks``) are called where chunks are read, in the executors' Python workers, so their handlers need to
    report to something that all of them reach. ``large_read_warning_bytes`` warns here, before anything is read.
    """
    source.register(spark)
    first = next(iter(handles.values())).meta
    warn_of_size(handles.values(), indexing.normalize(selection, first.shape), float(options.pop("large_read_warning_bytes", "inf")))
    if (hooks := options.pop("hooks", None)) is not None:
        options["hooks"] = source.pack(hooks)
    reader = spark.read.format(source.FORMAT).option("handles", source.pack(handles))
    settings = {"min_partitions": spark.sparkContext.defaultParallelism, **options}
    if selection is not None:
        settings["selection"] = json.dumps(list(selection))
    for key, value in settings.items():
        reader = reader.option(key, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load()


def _read_meta(read, path: str) -> ArrayMeta | None:
    raw = read(_below(path, ARRAY_DOC))
    if raw is None:
        return None
    return metadata.parse_array(raw).with_attrs(metadata.parse_attrs(read(_below(path, ATTRS_DOC))))


def _handle(store: Store, path: str, meta: ArrayMeta) -> Handle:
    return Handle(store, path, meta, source.custom_codecs())


def open_handle(store: Store, path: str, options: OpenOptions | None = None) -> Handle:
    path = path.strip("/")
    context = (options or OpenOptions()).context(store)
    meta = _read_meta(lambda key: read_metadata(store, key, context), path)
    if meta is None:
        raise MetadataError(f"no array at {path or '/'}")
    return _handle(store, path, meta)


class Group:
    """A node of the hierarchy; children come from consolidated metadata where there is some."""

    def __init__(self, spark: SparkSession, store: Store, path: str, attrs: dict, consolidated: Consolidated | None, context: MetadataContext | None):
        self.spark, self.store, self.path, self.attrs = spark, store, path, attrs
        self._consolidated, self._context = consolidated, context

    def _read(self, key: str) -> bytes | None:
        if self._consolidated is not None and self._consolidated.has(key):
            return self._consolidated.get(key)
        return read_metadata(self.store, key, self._context)

    def children(self) -> list[str]:
        """Distinct names below; consolidated metadata isn't completed by a listing."""
        if self._consolidated is not None:
            return self._consolidated.list_children(self.path)
        start = f"{self.path}/" if self.path else ""
        keys = (k[len(start) :] for k in self.store.list(start) if k.startswith(start))
        names = (k.split("/", 1)[0] for k in keys)
        return list(dict.fromkeys(n for n in names if n and not n.startswith(".")))

    def get_array(self, name: str) -> Array:
        path = _below(self.path, name)
        meta = _read_meta(self._read, path)
        if meta is None:
            raise MetadataError(f"no array at {path}")
        return Array(self.spark, _handle(self.store, path, meta))

    def get_group(self, name: str) -> Group:
        path = _below(self.path, name)
        raw = self._read(_below(path, GROUP_DOC))
        if raw is None:
            raise MetadataError(f"no group at {path}")
        metadata.parse_group(raw)
        return Group(self.spark, self.store, path, metadata.parse_attrs(self._read(_below(path, ATTRS_DOC))), self._consolidated, self._context)

    def arrays(self) -> Iterator[tuple[str, Array]]:
        for name in self.children():
            if self._read(_below(_below(self.path, name), ARRAY_DOC)) is not None:
                yield name, self.get_array(name)

    def groups(self) -> Iterator[tuple[str, Group]]:
        for name in self.children():
            if self._read(_below(_below(self.path, name), GROUP_DOC)) is not None:
                yield name, self.get_group(name)

    def contains(self, name: str) -> bool:
        path = _below(self.path, name)
        return any(self._read(_below(path, doc)) is not None for doc in (ARRAY_DOC, GROUP_DOC))

    def _openable(self, names: Sequence[str]) -> dict[str, Array]:
        found = {}
        for name in dict.fromkeys(names):
            try:
                found[name] = self.get_array(name)
            except ArrayError:  # names that can't be opened are left out
                continue
        return found

    def read_multiple(self, names: Sequence[str], selection: Sequence | None = None, **options: object) -> dict[str, DataFrame]:
        """The same selection of several arrays, by name in the order given."""
        return {n: a.get(selection, **options) for n, a in self._openable(names).items()}

    def read_wide(self, names: Sequence[str], selection: Sequence | None = None, **options: object) -> DataFrame:
        """Several arrays of one shape as one table: a scan where their chunks agree, an index join where not."""
        arrays = self._openable(names)
        if not arrays:
            raise MetadataError(f"none of {list(names)} can be opened")
        shapes = {a.shape for a in arrays.values()}
        if len(shapes) > 1:
            raise SliceError(f"the arrays differ in shape: {sorted(shapes)}")
        by_chunks: dict[tuple, dict[str, Handle]] = {}
        for n, a in arrays.items():
            by_chunks.setdefault(a.chunks, {})[n] = a.handle
        index = [f"i{d}" for d in range(len(next(iter(shapes))))]
        scans = [load(self.spark, handles, selection, **options) for handles in by_chunks.values()]
        out = scans[0]
        for scan in scans[1:]:
            out = out.join(scan, index) if index else out.crossJoin(scan)
        return out.select(*index, *arrays)

    def to_numpy(self, names: Sequence[str], selection: Sequence | None = None, options: ReadOptions | None = None) -> dict[str, np.ndarray]:
        """``read_multiple`` in this process, all arrays under one budget of bytes."""
        options = options or ReadOptions()
        limiter = ByteLimiter(options.max_in_flight_bytes, options.hooks and options.hooks.in_flight)
        return {n: a.to_numpy(selection, options, limiter) for n, a in self._openable(names).items()}

    def catalog(self) -> DataFrame:
        """All nodes at and below this one: path, kind, shape, chunks, dtype, attrs_json."""
        rows: list[tuple] = []

        def walk(group: Group) -> None:
            rows.append((group.path, "group", None, None, None, json.dumps(group.attrs, sort_keys=True)))
            for _, a in group.arrays():
                rows.append((a.path, "array", list(a.shape), list(a.chunks), a.dtype, json.dumps(a.attrs, sort_keys=True)))
            for _, g in group.groups():
                walk(g)

        walk(self)
        return self.spark.createDataFrame(rows, "path string, kind string, shape array<bigint>, chunks array<bigint>, dtype string, attrs_json string")


def _store(at: Store | str) -> Store:
    return open_store(at) if isinstance(at, str) else at


def open_array(spark: SparkSession, at: Store | str, path: str = "", options: OpenOptions | None = None) -> Array:
    return Array(spark, open_handle(_store(at), path, options))


def open_group(spark: SparkSession, at: Store | str, path: str = "", options: OpenOptions | None = None) -> Group:
    store, path = _store(at), path.strip("/")
    context = (options or OpenOptions()).context(store)

    def read(key: str) -> bytes | None:
        return read_metadata(store, key, context)

    raw = read(_below(path, GROUP_DOC))
    if raw is None:
        raise MetadataError(f"no group at {path or '/'}")
    metadata.parse_group(raw)
    whole = None if path else read(CONSOLIDATED_DOC)
    consolidated = None if whole is None else Consolidated(whole)
    attrs = consolidated.get(ATTRS_DOC) if consolidated is not None else read(_below(path, ATTRS_DOC))
    return Group(spark, store, path, metadata.parse_attrs(attrs), consolidated, context)


def open(spark: SparkSession, at: Store | str, path: str = "", options: OpenOptions | None = None) -> Array | Group:  # noqa: A001
    """The array or else the group at a path."""
    store = _store(at)
    context = (options or OpenOptions()).context(store)
    clean = path.strip("/")
    for doc, opener in ((ARRAY_DOC, open_array), (GROUP_DOC, open_group)):
        if read_metadata(store, _below(clean, doc), context) is not None:
            return opener(spark, store, clean, options)
    raise MetadataError(f"neither array nor group at {clean or '/'}")
