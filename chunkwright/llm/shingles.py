"""Hashes of words and word shingles, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

_SEED = np.random.default_rng(20240229)
#: A random number for each byte value, after A-Z became a-z.
_BYTE = _SEED.integers(1, 1 << 63, size=256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = _SEED.integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)

#: Words are separated by a space and the controls from tab to carriage return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

#: Longer texts are hashed in slices that end at a separator.
SLICE_BYTES = 1 << 20
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _slice_hashes(raw: np.ndarray, gap: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    up, down = _grown(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: bytes, separators: np.ndarray = SPACES) -> np.ndarray:
    """One 64-bit hash for each word, in order; A-Z count as a-z."""
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = separators[raw]
    if len(raw) <= SLICE_BYTES:
        return _slice_hashes(raw, gap)
    out, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + SLICE_BYTES)
        if stop < len(raw):
            after = np.flatnonzero(gap[stop:])
            stop = stop + int(after[0]) if len(after) else len(raw)
        out.append(_slice_hashes(raw[at:stop], gap[at:stop]))
        at = stop
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; of fewer words, but not none, one for all."""
    if len(words) == 0:
        return words
    if len(words) < width:
        width = len(words)
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out += words[j : len(words) - width + 1 + j] * _STEP[j]
    return mix(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode()), width))


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    a = mix(shingles).sum(dtype=np.uint64)
    b = mix(shingles * _STEP[63] + np.uint64(1)).sum(dtype=np.uint64)
    return a.tobytes() + b.tobytes()
