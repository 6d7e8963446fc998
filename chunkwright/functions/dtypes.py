"""Element types: Zarr v2 names, NumPy, Arrow and Spark types."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from chunkwright.errors import MetadataError


@dataclass(frozen=True)
class ElementType:
    """How one element is stored, and what it becomes."""

    name: str
    stored: np.dtype
    spark: T.DataType
    arrow: pa.DataType

    @property
    def size(self) -> int:
        return self.stored.itemsize

    @property
    def big_endian(self) -> bool:
        return self.name[0] == ">"


# The element kinds of the format, and the Spark type that holds each without loss
_KINDS = {
    "b1": (T.ByteType(), pa.int8()),
    "i1": (T.ByteType(), pa.int8()),
    "u1": (T.ShortType(), pa.int16()),
    "i2": (T.ShortType(), pa.int16()),
    "u2": (T.IntegerType(), pa.int32()),
    "i4": (T.IntegerType(), pa.int32()),
    "u4": (T.LongType(), pa.int64()),
    "i8": (T.LongType(), pa.int64()),
    "u8": (T.DecimalType(20, 0), pa.decimal128(20, 0)),
    "f4": (T.FloatType(), pa.float32()),
    "f8": (T.DoubleType(), pa.float64()),
}


def element_type(name: str) -> ElementType:
    """The type of a dtype string; booleans read as 0 and 1."""
    kind = name[1:]
    if kind not in _KINDS or (name[0] not in "<>" if kind[1] != "1" else name[0] != "|"):
        raise MetadataError(f"Unsupported dtype: {name}")
    spark, arrow = _KINDS[kind]
    return ElementType(name, np.dtype("|i1" if kind == "b1" else name), spark, arrow)


def native(values: np.ndarray) -> np.ndarray:
    """The same values in this machine's byte order."""
    return values if values.dtype.isnative else values.astype(values.dtype.newbyteorder("="))


def to_arrow(values: np.ndarray, kind: ElementType) -> pa.Array:
    flat = native(np.ascontiguousarray(values).ravel())
    if pa.types.is_decimal(kind.arrow):
        if len(flat) and int(flat.max()) >= 1 << 63:
            return pa.array([Decimal(int(x)) for x in flat], kind.arrow)
        return pa.array(flat.astype(np.int64)).cast(pa.decimal128(20, 0))
    return pa.array(flat).cast(kind.arrow)


def resolve_fill(raw: object) -> float | int | None:
    """What a fill_value stands for; anything but a number or a special float's name is no value."""
    special = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
    if isinstance(raw, str):
        return special.get(raw)
    if isinstance(raw, bool) or not isinstance(raw, int | float):
        return None
    return raw


def fill_scalar(raw: object, kind: ElementType) -> np.generic:
    """The element that stands in for absent data: zero unless a fill value says otherwise."""
    value, dtype = resolve_fill(raw), kind.stored.newbyteorder("=")
    if value is None:
        return dtype.type(0)
    if dtype.kind == "f":
        return dtype.type(value)
    if not isfinite(value):
        return dtype.type(0)
    bits = dtype.itemsize * 8
    wrapped = int(value) % (1 << bits)  # integers wrap, fractions are cut off
    if dtype.kind == "i" and wrapped >= 1 << (bits - 1):
        wrapped -= 1 << bits
    return dtype.type(wrapped)
