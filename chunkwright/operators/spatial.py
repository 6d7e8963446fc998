"""Nearest cells of curvilinear grids, and reads by coordinate labels."""

from __future__ import annotations

import contextlib
import hashlib
import re
import struct
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.errors import ArrayError, SliceError
from chunkwright.operators.array import Array, Group
from chunkwright.runtime import scratched, ship, stage
from chunkwright.sources.caches import Cache
from chunkwright.sources.reader import ReadOptions

# Kilometres of a degree, the snapshot's magic number, and the prefix of its keys
KM_PER_DEGREE = 111.195
MAGIC = 0x44495247
KEY_PREFIX = "gridindex:"
#: Grids up to this size go to the executors whole; larger ones are joined block by block.
BROADCAST_BYTES = 256 << 20


@dataclass(frozen=True)
class Nearest:
    i: int
    j: int
    distance_km: float


#: Cells of a tile on average, and pairs of points and cells that are looked at at once.
TILE_CELLS, PAIRS = 16, 1 << 21


class _Searcher:
    """Cells in tiles of latitude and longitude. Points look at squares of tiles around their own, which double until no cell outside can be nearer."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        known = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
        y, x = lat[known].astype(np.float64), lon[known].astype(np.float64)
        self.side = max(1, int((len(known) / TILE_CELLS) ** 0.5))
        self.low = [float(v.min()) if len(v) else 0.0 for v in (y, x)]
        self.step = [(float(v.max() - v.min()) / self.side or 1.0) if len(v) else 1.0 for v in (y, x)]
        tile = self._tile(0, y) * self.side + self._tile(1, x)
        order = np.lexsort((known, tile))
        self.cell, self.lat, self.lon = known[order], y[order], x[order]
        self.first = np.searchsorted(tile[order], np.arange(self.side * self.side + 1))

    def _tile(self, axis: int, v: np.ndarray) -> np.ndarray:
        return np.clip((v - self.low[axis]) / self.step[axis], 0, self.side - 1).astype(np.int64)

    def find(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row-major number of the nearest cell, squared degrees) of each point; ties go to the smallest number, and points without any to cell 0."""
        cells, squared = np.zeros(len(lat), dtype=np.int64), np.full(len(lat), np.inf)
        todo = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon)) if len(self.cell) else np.zeros(0, dtype=np.int64)
        reach = 1
        while len(todo):
            cells[todo], squared[todo], settled = self._look(lat[todo], lon[todo], reach)
            todo = todo[~settled]
            reach *= 2
        return cells, squared

    def _look(self, lat: np.ndarray, lon: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = [self._tile(0, lat), self._tile(1, lon)]
        low, high = zip(*((np.maximum(t - reach, 0), np.minimum(t + reach, self.side - 1)) for t in at), strict=True)
        rows = high[0] - low[0] + 1
        owner = np.repeat(np.arange(len(lat)), rows)
        row = np.arange(rows.sum()) - np.repeat(rows.cumsum() - rows, rows) + low[0][owner]
        begin, end = self.first[row * self.side + low[1][owner]], self.first[row * self.side + high[1][owner] + 1]
        count = np.bincount(owner, weights=end - begin, minlength=len(lat)).astype(np.int64)
        if count.sum() > PAIRS and len(lat) > 1:
            half = len(lat) // 2
            parts = [self._look(lat[i], lon[i], reach) for i in (slice(None, half), slice(half, None))]
            return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
        cos = np.cos(lat * np.pi / 180)
        size = end - begin
        place = np.arange(size.sum()) + np.repeat(begin - (size.cumsum() - size), size)
        point = np.repeat(np.arange(len(lat)), count)
        d_lat, d_lon = self.lat[place] - lat[point], (self.lon[place] - lon[point]) * cos[point]
        gap = d_lat * d_lat + d_lon * d_lon
        best, cell = np.full(len(lat), np.inf), np.zeros(len(lat), dtype=np.int64)
        met = np.flatnonzero(count)
        if len(met):
            starts = (count.cumsum() - count)[met]
            best[met] = np.minimum.reduceat(gap, starts)
            cell[met] = np.minimum.reduceat(np.where(gap == best[point], self.cell[place], np.iinfo(np.int64).max), starts)
        room = np.full(len(lat), np.inf)  # how far the nearest cell outside is, at least
        for axis, (v, scale) in enumerate(((lat, np.ones(len(lat))), (lon, np.abs(cos)))):
            below = np.where(low[axis] > 0, v - (self.low[axis] + low[axis] * self.step[axis]), np.inf)
            above = np.where(high[axis] < self.side - 1, self.low[axis] + (high[axis] + 1) * self.step[axis] - v, np.inf)
            for edge in (below, above):
                room = np.minimum(room, np.where(np.isinf(edge), np.inf, edge * scale))
        return cell, best, np.isinf(room) | (np.sqrt(best) * (1 + 1e-9) + 1e-12 < room)


class GridIndex:
    """A 2-D grid of latitudes and longitudes as 32-bit floats, row-major."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, ny: int, nx: int):
        if lat.size != ny * nx or lon.size != ny * nx:
            raise ArrayError(f"{lat.size} latitudes and {lon.size} longitudes for a grid of {ny} x {nx}")
        self.lat, self.lon = (np.ascontiguousarray(a, dtype=np.float32).ravel() for a in (lat, lon))
        self.ny, self.nx = ny, nx
        self._searcher: _Searcher | None = None

    @classmethod
    def from_coordinates(cls, lat: Sequence[float] | np.ndarray, lon: Sequence[float] | np.ndarray, ny: int, nx: int) -> GridIndex:
        return cls(np.asarray(lat), np.asarray(lon), ny, nx)

    @classmethod
    def from_group(cls, group: Group, lat_name: str = "lat", lon_name: str = "lon", options: ReadOptions | None = None) -> GridIndex:
        return cls._read(_coordinate(group, lat_name), _coordinate(group, lon_name), options)

    @classmethod
    def _read(cls, lat: Array, lon: Array, options: ReadOptions | None) -> GridIndex:
        if len(lat.shape) != 2 or lat.shape != lon.shape:
            raise ArrayError(f"a grid needs two 2-D arrays of one shape; these have {lat.shape} and {lon.shape}")
        return cls(lat.to_numpy(options=options), lon.to_numpy(options=options), *lat.shape)

    @classmethod
    def load_cached(cls, group: Group, cache: Cache | None = None, lat_name: str = "lat", lon_name: str = "lon", grid_key: str | None = None, verify_grid: bool = False, ttl_ms: float | None = None, options: ReadOptions | None = None) -> GridIndex:
        """From a shared cache, or else read and remembered there; a failing cache is passed by."""
        lat, lon = _coordinate(group, lat_name), _coordinate(group, lon_name)
        key = KEY_PREFIX + _key_part(grid_key) if grid_key else grid_cache_key(group, lat, lon, verify_grid, options)
        if cache is not None:
            with contextlib.suppress(Exception):
                if kept := cache.get(key):
                    return cls.from_bytes(kept)
        index = cls._read(lat, lon, options)
        if cache is not None:
            with contextlib.suppress(Exception):
                cache.set(key, index.to_bytes(), ttl_ms)
        return index

    def to_bytes(self) -> bytes:
        return struct.pack("<III", MAGIC, self.ny, self.nx) + self.lat.astype("<f4").tobytes() + self.lon.astype("<f4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> GridIndex:
        if len(data) < 12:
            raise ArrayError("a grid snapshot is longer than its header")
        magic, ny, nx = struct.unpack_from("<III", data)
        if magic != MAGIC:
            raise ArrayError("not a grid snapshot")
        if len(data) != 12 + 8 * ny * nx:
            raise ArrayError(f"a snapshot of {ny} x {nx} cells has {12 + 8 * ny * nx} bytes, not {len(data)}")
        both = np.frombuffer(data, dtype="<f4", offset=12)
        return cls(both[: ny * nx], both[ny * nx :], ny, nx)

    def nearest(self, lat: float, lon: float) -> Nearest:
        """By flat distance with the longitude scaled by the target's cosine; no wrap at the date line."""
        i, j, distance = self.nearest_of(np.array([lat], dtype=np.float64), np.array([lon], dtype=np.float64))
        return Nearest(int(i[0]), int(j[0]), float(distance[0]))

    def nearest_of(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance_km) of many points at once."""
        if self._searcher is None:
            self._searcher = _Searcher(self.lat, self.lon)
        cell, squared = self._searcher.find(lat, lon)
        return cell // self.nx, cell % self.nx, np.sqrt(squared) * KM_PER_DEGREE

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Rows i, j, lat, lon."""
        cell = np.arange(self.ny * self.nx, dtype=np.int64)
        return spark.createDataFrame(pa.table({"i": cell // self.nx, "j": cell % self.nx, "lat": self.lat, "lon": self.lon}))

    def nearest_many(self, points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """The rows of ``points`` with i, j and distance_km of their nearest cells."""
        spark = points.sparkSession
        if 8 * self.ny * self.nx > BROADCAST_BYTES:
            return nearest_join(points, self.to_df(spark), lat, lon)
        ship(spark)
        grid = spark.sparkContext.broadcast(self.to_bytes())  # its size was checked above
        names = points.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = GridIndex.from_bytes(grid.value)
            for batch in batches:
                targets = (batch.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in ("_lat", "_lon"))
                extra = [pa.array(v) for v in index.nearest_of(*targets)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *extra], names=[*names, "i", "j", "distance_km"])

        given = points.withColumns({"_lat": F.col(lat).cast("double"), "_lon": F.col(lon).cast("double")})
        schema = T.StructType([*points.schema.fields, T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("distance_km", T.DoubleType())])
        return given.mapInArrow(run, schema)


#: Cells of a block, at most, where points and cells meet.
BLOCK_CELLS = 4096


class _Boxes:
    """The bounds of blocks that lie in slabs (``block >> 32``): which of them may hold a point's nearest cell."""

    def __init__(self, table: pa.Table):
        self.block = table.column("_block").to_numpy()
        self.bounds = np.stack([table.column(c).to_numpy() for c in ("y0", "y1", "x0", "x1")])
        first = np.flatnonzero(np.diff(self.block >> 32, prepend=-1))
        self.first = np.append(first, len(self.block))
        self.slabs = np.stack([(np.minimum if k % 2 == 0 else np.maximum).reduceat(self.bounds[k], first) for k in range(4)])

    @staticmethod
    def _least(bounds: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """[point, box]: squared degrees that a cell inside is away, at least."""
        y0, y1, x0, x1 = bounds
        d_lat = np.maximum(np.maximum(y0 - lat[:, None], lat[:, None] - y1), 0)
        d_lon = np.maximum(np.maximum(x0 - lon[:, None], lon[:, None] - x1), 0) * np.cos(lat * np.pi / 180)[:, None]
        return d_lat * d_lat + d_lon * d_lon

    def closest(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """A block near each point: the one with the nearest box in the slab with the nearest box."""
        slab, found = self._least(self.slabs, lat, lon).argmin(axis=1), np.zeros(len(lat), dtype=np.int64)
        for k in np.unique(slab):
            own, low, high = np.flatnonzero(slab == k), self.first[k], self.first[k + 1]
            found[own] = self.block[low + self._least(self.bounds[:, low:high], lat[own], lon[own]).argmin(axis=1)]
        return found

    def within(self, lat: np.ndarray, lon: np.ndarray, squared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of points, their blocks): all blocks that may hold a cell as near as the squared degrees, slab by slab."""
        bound = squared * (1 + 1e-9) + 1e-24
        near = self._least(self.slabs, lat, lon) <= bound[:, None]
        for k in np.flatnonzero(near.any(axis=0)):
            own, low, high = np.flatnonzero(near[:, k]), self.first[k], self.first[k + 1]
            point, box = np.nonzero(self._least(self.bounds[:, low:high], lat[own], lon[own]) <= bound[own, None])
            yield own[point], self.block[low + box]


def _blocked(cells: DataFrame) -> DataFrame:
    """Cells (_i, _j, _y, _x) with the _block of each: equal slabs by latitude, cut into blocks along the longitude. Cells at one place are one."""
    size = BLOCK_CELLS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, seen, last = TaskContext.get().partitionId() << 32, 0, (np.nan, np.nan)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x = (batch.column(c).to_numpy() for c in ("_y", "_x"))
            new = (np.diff(y, prepend=last[0]) != 0) | (np.diff(x, prepend=last[1]) != 0)  # sorted: the first of a place has the least i, j
            last = y[-1], x[-1]
            kept = batch.filter(pa.array(new))
            block = slab + (seen + np.arange(kept.num_rows)) // size
            seen += kept.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(block), *kept.columns], names=["_block", *batch.schema.names])

    slabs = max(1, round((cells.count() / size) ** 0.5))
    laid = cells.repartitionByRange(slabs, "_y", "_x", "_i", "_j").sortWithinPartitions("_x", "_y", "_i", "_j")
    return laid.mapInArrow(cut, "_block bigint, _i bigint, _j bigint, _y double, _x double")


def _met(cells: DataFrame, points: DataFrame) -> DataFrame:
    """The nearest cell in its _block of each point (_block, _point, _y, _x): _block, _point, _y, _x, d, i, j.

    A task streams its blocks, each block's cells before its points, and holds the cells of one block; all points of a block are one task's.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, index = None, [], None
        for batch in batches:
            block = batch.column("_block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if block[low] != current:
                    current, held, index = block[low], [], None
                part = batch.slice(low, high - low)
                n = part.column("_point").null_count
                if n:
                    held.append([part.slice(0, n).column(c).to_numpy() for c in ("_i", "_j", "_y", "_x")])
                if n == part.num_rows:
                    continue
                if index is None:
                    i, j, y, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.lexsort((j, i))
                    i, j, index, held = i[order], j[order], _Searcher(y[order], x[order]), []
                asked = part.slice(n)
                cell, squared = index.find(*(asked.column(c).to_numpy() for c in ("_y", "_x")))
                yield pa.RecordBatch.from_arrays([*(asked.column(c) for c in ("_block", "_point", "_y", "_x")), pa.array(squared), pa.array(i[cell]), pa.array(j[cell])], names=["_block", "_point", "_y", "_x", "d", "i", "j"])

    none = F.lit(None).cast("long")
    both = cells.select("_block", none.alias("_point"), "_i", "_j", "_y", "_x").union(points.select("_block", "_point", none, none, "_y", "_x"))
    sorted_ = both.repartition("_block").sortWithinPartitions(F.col("_block"), F.col("_point").asc_nulls_first())
    return sorted_.mapInArrow(search, "_block bigint, _point bigint, _y double, _x double, d double, i bigint, j bigint")


@scratched
def nearest_join(points: DataFrame, cells: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``nearest_many`` for grids that are too large to copy: points meet the cells of blocks, of which only the bounds are copied.

    A point looks into a block near it first, then into every other block whose bounds are no farther than the cell found there.
    """
    spark = points.sparkSession
    ship(spark)
    numbered = stage(points.withColumn("_point", F.monotonically_increasing_id()), "points")
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    infinite = F.lit(float("inf"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite)
    asked = numbered.select("_point", y.alias("_y"), x.alias("_x")).where(finite(F.col("_y")) & finite(F.col("_x")))
    known = cells.select(F.col("i").cast("long").alias("_i"), F.col("j").cast("long").alias("_j"), F.col("lat").cast("double").alias("_y"), F.col("lon").cast("double").alias("_x")).where(finite(F.col("_y")) & finite(F.col("_x")))
    blocks = stage(_blocked(stage(known, "cells")), "blocks")
    table = blocks.groupBy("_block").agg(F.min("_y").alias("y0"), F.max("_y").alias("y1"), F.min("_x").alias("x0"), F.max("_x").alias("x1")).toArrow().sort_by("_block")
    kind = cells.schema
    if not table.num_rows:
        return numbered.select(*points.columns, F.lit(0).cast(kind["i"].dataType).alias("i"), F.lit(0).cast(kind["j"].dataType).alias("j"), infinite.alias("distance_km"))
    sent = spark.sparkContext.broadcast(table)  # a row for each block

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = _Boxes(sent.value)
        for batch in batches:
            block = boxes.closest(*(batch.column(c).to_numpy() for c in ("_y", "_x")))
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["_block", *batch.schema.names])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = _Boxes(sent.value)
        for batch in batches:
            looked = batch.column("_block").to_numpy()
            for place, block in boxes.within(*(batch.column(c).to_numpy() for c in ("_y", "_x", "d"))):
                new = block != looked[place]
                chosen = batch.select(["_point", "_y", "_x"]).take(pa.array(place[new]))
                yield pa.RecordBatch.from_arrays([pa.array(block[new]), *chosen.columns], names=["_block", "_point", "_y", "_x"])

    routed = "_block bigint, _point bigint, _y double, _x double"
    begun = stage(_met(blocks, asked.mapInArrow(first, routed)), "nearest")
    ended = stage(_met(blocks, begun.select("_block", "_point", "_y", "_x", "d").mapInArrow(others, routed)), "nearest")
    best = begun.union(ended).groupBy("_point").agg(F.min(F.struct("d", "i", "j")).alias("_best"))
    out = numbered.join(best, "_point", "left")
    return out.select(*points.columns, *(F.coalesce(F.col(f"_best.{c}").cast(kind[c].dataType), F.lit(0)).alias(c) for c in ("i", "j")), F.coalesce(F.sqrt("_best.d") * KM_PER_DEGREE, infinite).alias("distance_km"))


def grid_cells(group: Group, lat_name: str = "lat", lon_name: str = "lon") -> DataFrame:
    """i, j, lat, lon of a grid, scanned by tasks."""
    return group.read_wide([lat_name, lon_name]).select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.col(lat_name).alias("lat"), F.col(lon_name).alias("lon"))


def nearest_cells(group: Group, points: DataFrame, lat: str = "lat", lon: str = "lon", lat_name: str = "lat", lon_name: str = "lon") -> DataFrame:
    """``nearest_many`` on a group's grid: sent to the executors whole if its shape says it is small enough, else scanned and joined."""
    shape = _coordinate(group, lat_name).shape
    if len(shape) == 2 and 8 * shape[0] * shape[1] <= BROADCAST_BYTES:
        return GridIndex.from_group(group, lat_name, lon_name).nearest_many(points, lat, lon)
    return nearest_join(points, grid_cells(group, lat_name, lon_name), lat, lon)


def _coordinate(group: Group, name: str) -> Array:
    found = group.get_array(name)
    if found.dtype[1:] in ("i8", "u8"):
        raise ArrayError(f"{name} has 64-bit integers; coordinates are floats or smaller integers")
    return found


def _clean(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "", text)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _key_part(given: str) -> str:
    return _clean(given) or _digest(given)


def grid_cache_key(group: Group, lat: Array, lon: Array, verify: bool = False, options: ReadOptions | None = None) -> str:
    """A name that all runs of one model domain share: its attributes, shapes, chunks and types, not its values."""
    told = (group.attrs.get(a) for a in ("source_model", "experiment", "grid_id"))
    domain = "-".join(str(v) for v in told if v is not None and str(v))
    if not domain:
        warnings.warn("the group names no source_model, experiment or grid_id; grids of one shape share a key unless grid_key or verify_grid tells them apart", stacklevel=3)
    dims = ["x".join(map(str, d)) for d in (lat.shape, lon.shape, lat.chunks, lon.chunks)]
    text = "|".join([domain, *dims, lat.dtype, lon.dtype])
    if verify:
        corner = [a.to_numpy([0, 0], options).ravel()[0] for a in (lat, lon)]
        text += f"|corner={corner[0]},{corner[1]}"
    return f"{KEY_PREFIX}{_clean(domain or 'grid')}-{dims[0]}-{_digest(text)}"


def nearest_1d(lat: DataFrame, lon: DataFrame, target: tuple[float, float]) -> DataFrame:
    """Nearest of a list of points (i0, value of each coordinate): point, distance_km; one row."""
    y, x = F.col("lat").cast("double") - F.lit(target[0]), (F.col("lon").cast("double") - F.lit(target[1])) * F.cos(F.radians(F.lit(target[0])))
    both = lat.select("i0", F.col("value").alias("lat")).join(lon.select("i0", F.col("value").alias("lon")), "i0")
    best = both.where(~F.isnan("lat") & ~F.isnan("lon")).agg(F.min(F.struct((y * y + x * x).alias("d"), "i0")).alias("best"))
    return best.select(F.col("best.i0").alias("point"), (F.sqrt("best.d") * KM_PER_DEGREE).alias("distance_km"))


def point_series(group: Group, variable: str, grid: GridIndex, lat: float, lon: float, **options: object) -> DataFrame:
    """The series of a variable in the cell nearest to a position; the cell becomes literals, so chunks are pruned."""
    cell = grid.nearest(lat, lon)
    return group.get_array(variable).point_series(cell.i, cell.j, **options)


#: A 1-D coordinate of more values is searched by tasks.
LOCAL_LABELS = 1 << 20


def _nearest_label(coordinate: Array, label: float) -> int:
    """The place of the value nearest to a label, the first of equals."""
    if coordinate.shape[0] <= LOCAL_LABELS:
        return int(np.nanargmin(np.abs(coordinate.to_numpy().ravel().astype(np.float64) - label)))
    gap = F.abs(F.col("value").cast("double") - F.lit(float(label)))
    return coordinate.get().where(~F.isnan(gap)).agg(F.min(F.struct(gap.alias("gap"), "i0"))["i0"]).first()[0]


def select_labels(group: Group, labels: dict[str, float], variables: Sequence[str] | None = None, **options: object) -> dict[str, DataFrame]:
    """Data variables at the coordinates nearest to the labels; dimensions are named by _ARRAY_DIMENSIONS.

    Labels of a dimension's own 1-D coordinate choose along it. Two labels of 2-D coordinates over the same two dimensions, latitude first,
    choose the nearest cell of that grid.
    """
    arrays = dict(group.arrays())
    at: dict[str, int] = {}
    flat = [n for n in labels if n in arrays and len(arrays[n].shape) == 2]
    if flat:
        if len(flat) != 2 or (dims := arrays[flat[0]].attrs.get("_ARRAY_DIMENSIONS")) is None or dims != arrays[flat[1]].attrs.get("_ARRAY_DIMENSIONS"):
            raise SliceError(f"{flat} aren't two 2-D coordinates over the same dimensions")
        cell = GridIndex.from_group(group, *flat).nearest(labels[flat[0]], labels[flat[1]])
        at |= dict(zip(dims, (cell.i, cell.j), strict=True))
    for name, label in labels.items():
        if name in flat:
            continue
        if name not in arrays or len(arrays[name].shape) != 1:
            raise SliceError(f"{name} isn't a coordinate of the group")
        at[(arrays[name].attrs.get("_ARRAY_DIMENSIONS") or [name])[0]] = _nearest_label(arrays[name], label)
    out = {}
    for name, array in arrays.items():
        dims = array.attrs.get("_ARRAY_DIMENSIONS", [])
        wanted = variables is None and name not in {*dims, *labels} or variables is not None and name in variables
        if wanted and any(d in at for d in dims):
            out[name] = array.get([at.get(d) for d in dims], **options)
    return out
