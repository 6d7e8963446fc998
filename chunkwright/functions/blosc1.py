"""A decoder for Blosc 1 frames, after the published frame format.

Inner codecs: LZ4, Snappy and Zstandard through Arrow, zlib, and BloscLZ here.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

from chunkwright.errors import CodecError

# The frame's flags and inner codec numbers
HEADER, SHUFFLE, COPIED, BITSHUFFLE, UNSPLIT = 16, 0x1, 0x2, 0x4, 0x10
INNER = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
MAX_SPLITS, MIN_SPLIT_BYTES = 16, 128
_FAR = 8191


def _blosclz(data: bytes, size: int) -> bytes:
    out, at, control = bytearray(), 1, data[0] & 31
    while True:
        if control >= 32:
            length, distance = (control >> 5) - 1, (control & 31) << 8
            if length == 6:
                while True:
                    length += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
            low = data[at]
            at += 1
            if low == 255 and distance == 31 << 8:
                distance = (data[at] << 8 | data[at + 1]) + _FAR
                at += 2
            else:
                distance += low
            start, length = len(out) - distance - 1, length + 3
            if start < 0:
                raise CodecError("blosc: a match begins before the data")
            while length > 0:  # a match may overlap what it writes
                part = out[start : start + length]
                out += part
                length -= len(part)
        else:
            out += data[at : at + control + 1]
            at += control + 1
        if at >= len(data) or len(out) >= size:
            return bytes(out)
        control = data[at]
        at += 1


def _inner(name: str, data: bytes, size: int) -> bytes:
    if name == "zlib":
        return zlib.decompress(data)
    if name == "blosclz":
        return _blosclz(data, size)
    return pa.Codec("lz4_raw" if name == "lz4" else name).decompress(data, decompressed_size=size, asbytes=True)


def _unshuffle(block: bytes, item: int) -> bytes:
    n = len(block) // item
    body = np.frombuffer(block, dtype=np.uint8, count=n * item).reshape(item, n).T
    return body.tobytes() + block[n * item :]


def _unshuffle_bits(block: bytes, item: int) -> bytes:
    n = len(block) // item // 8 * 8
    rows = np.frombuffer(block, dtype=np.uint8, count=n * item).reshape(item * 8, n // 8)
    bits = np.unpackbits(rows, axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").tobytes() + block[n * item :]


def decode(frame: bytes) -> bytes:
    if len(frame) < HEADER:
        raise CodecError("blosc: the frame is shorter than its header")
    flags, item = frame[2], frame[3]
    size, block_size, packed = struct.unpack_from("<III", frame, 4)
    if packed > len(frame):
        raise CodecError("blosc: the frame is cut off")
    if flags & COPIED:
        return bytes(frame[HEADER : HEADER + size])
    if size == 0:
        return b""
    name = INNER.get(flags >> 5)
    if name is None:
        raise CodecError(f"blosc: unknown inner codec {flags >> 5}")
    count = -(-size // block_size)
    out = []
    try:
        for i, at in enumerate(struct.unpack_from(f"<{count}i", frame, HEADER)):
            length = min(block_size, size - i * block_size)
            split = not flags & UNSPLIT and length == block_size and 1 < item <= MAX_SPLITS and block_size // item >= MIN_SPLIT_BYTES
            parts = item if split else 1
            block = []
            for _ in range(parts):
                n = struct.unpack_from("<i", frame, at)[0]
                data = frame[at + 4 : at + 4 + n]
                at += 4 + n
                block.append(data if n == length // parts else _inner(name, data, length // parts))
            joined = b"".join(block)
            if flags & SHUFFLE and item > 1:
                joined = _unshuffle(joined, item)
            elif flags & BITSHUFFLE:
                joined = _unshuffle_bits(joined, item)
            out.append(joined)
    except (struct.error, IndexError, OSError, pa.ArrowInvalid, zlib.error) as error:
        raise CodecError(f"blosc: {error}") from error
    whole = b"".join(out)
    if len(whole) != size:
        raise CodecError(f"blosc: {len(whole)} bytes where the header says {size}")
    return whole
