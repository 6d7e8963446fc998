"""Encodes tables as array stores, so that queries have arrays to read. Not a writer of the engine, which only reads.

Chunks are built and written by the tasks that hold their cells; a chunk is the
most that a task gathers.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Sequence
from functools import partial
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.functions import blosc1, indexing
from chunkwright.functions.dtypes import element_type
from chunkwright.runtime import fresh_path, ship

#: What fills the padding of edge chunks; it must never be read.
PADDING = 0x7F


def xor_codec(config: dict):
    key = config["key"]
    return partial(_xor, key=key)


def _xor(data: bytes, key: int) -> bytes:
    return (np.frombuffer(data, dtype=np.uint8) ^ np.uint8(key)).tobytes()


def blosc_frame(data: bytes, item: int, inner: str, shuffle: str = "byte", block: int = 4096, split: bool = False) -> bytes:
    """A Blosc 1 frame; each block is one stream, or a stream for each byte of an element if it is whole and ``split``."""
    number = next(k for k, v in blosc1.INNER.items() if v == inner)
    flags = number << 5 | (0 if split else blosc1.UNSPLIT) | {"byte": blosc1.SHUFFLE, "bit": blosc1.BITSHUFFLE, "none": 0}[shuffle]
    streams = []
    for i in range(0, len(data), block):
        part = data[i : i + block]
        n = len(part) // item
        if shuffle == "byte":
            part = np.frombuffer(part, dtype=np.uint8, count=n * item).reshape(n, item).T.tobytes() + part[n * item :]
        elif shuffle == "bit":
            n = n // 8 * 8
            bits = np.unpackbits(np.frombuffer(part, dtype=np.uint8, count=n * item).reshape(n, item), axis=1, bitorder="little").T
            part = np.packbits(bits, axis=1, bitorder="little").tobytes() + part[n * item :]
        apart = item if split and len(part) == block and 1 < item <= blosc1.MAX_SPLITS and block // item >= blosc1.MIN_SPLIT_BYTES else 1
        stream = b""
        for k in range(apart):
            plain = part[k * len(part) // apart : (k + 1) * len(part) // apart]
            packed = zlib.compress(plain) if inner == "zlib" else pa.Codec("lz4_raw" if inner == "lz4" else inner).compress(plain, asbytes=True)
            kept = plain if len(packed) >= len(plain) else packed
            stream += struct.pack("<i", len(kept)) + kept
        streams.append(stream)
    starts, at = [], blosc1.HEADER + 4 * len(streams)
    for s in streams:
        starts.append(at)
        at += len(s)
    body = b"".join(streams)
    return struct.pack("<BBBBIII", 2, 1, flags, item, len(data), block, at) + struct.pack(f"<{len(starts)}i", *starts) + body


def compress(data: bytes, compressor: dict | None, item: int) -> bytes:
    if compressor is None:
        return data
    kind = compressor["id"]
    if kind == "zlib":
        return zlib.compress(data)
    if kind == "gzip":
        return gzip.compress(data, mtime=0)
    if kind == "blosc":
        return blosc_frame(data, item, compressor["cname"], compressor.get("shuffle_name", "byte"), split=compressor.get("split", False))
    return _xor(data, compressor["key"])


def write_bytes(folder: str, key: str, data: bytes) -> None:
    """A whole file or none: written aside, then moved."""
    filesystem, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{key}"
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{base}/_aside-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(aside) as out:
        out.write(data)
    filesystem.move(aside, path)


def array_document(shape: Sequence[int], chunks: Sequence[int], dtype: str, order: str = "C", compressor: dict | None = None, fill_value: object = 0, separator: str = ".") -> dict:
    return {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "order": order, "compressor": compressor, "fill_value": fill_value, "filters": None, "dimension_separator": separator}


def encode_array(cells: DataFrame, folder: str, path: str, shape: Sequence[int], chunks: Sequence[int], dtype: str, *, order: str = "C", compressor: dict | None = None, fill_value: object = 0, separator: str = ".", keep: str = "true", attrs: dict | None = None) -> dict:
    """Write the cells (i0.., value); ``keep`` is SQL on c0.. that says which chunks are stored. Returns the array's document."""
    spark = cells.sparkSession
    ship(spark)
    kind, dims = element_type(dtype), range(len(shape))
    document = array_document(shape, chunks, dtype, order, compressor, fill_value, separator)
    write_bytes(folder, f"{path}/.zarray" if path else ".zarray", json.dumps(document).encode())
    if attrs is not None:
        write_bytes(folder, f"{path}/.zattrs" if path else ".zattrs", json.dumps(attrs).encode())
    for d in dims:
        cells = cells.withColumn(f"c{d}", F.expr(f"i{d} div {chunks[d]}"))
    steps = indexing.strides(chunks)
    place = sum((F.pmod(F.col(f"i{d}"), F.lit(chunks[d])) * steps[d] for d in dims), F.lit(0))
    placed = cells.where(keep).select(*(f"c{d}" for d in dims), place.cast("long").alias("place"), F.col("value").cast("string" if dtype[1:] == "u8" else "double" if kind.stored.kind == "f" else "long").alias("value"))

    def build(table: pa.Table) -> pa.Table:
        at = [table.column(d)[0].as_py() for d in dims]
        plain = np.full(prod(chunks) * kind.size, PADDING, dtype=np.uint8).view(kind.stored).copy()
        values = table.column("value").to_pylist()
        plain[np.array(table.column("place"))] = np.array([int(v) for v in values] if dtype[1:] == "u8" else values).astype(kind.stored)
        data = compress(plain.reshape(chunks).tobytes(order=order), compressor, kind.size)
        key = indexing.chunk_key(at, separator)
        write_bytes(folder, f"{path}/{key}" if path else key, data)
        return pa.table({"bytes": pa.array([len(data)], pa.int64())})

    placed.groupBy(*(f"c{d}" for d in dims)).applyInArrow(build, "bytes bigint").agg(F.sum("bytes")).collect()
    return document


_BUILT: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """The folder of a store, built at its first use in this application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        folder = fresh_path(spark, f"store-{name}")
        build(folder)
        _BUILT[key] = folder
    return _BUILT[key]
