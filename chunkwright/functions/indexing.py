"""Selections, chunk grids and byte ranges: pure arithmetic on index boxes.

A box is a list of half-open ranges, one for each dimension.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product
from math import prod

from chunkwright.errors import SliceError

Box = list[tuple[int, int]]
Selector = int | Sequence[int] | None


def normalize(selection: Sequence[Selector] | None, shape: Sequence[int]) -> Box:
    """The box of a selection: null takes a whole dimension, k one index, [a, b] a range of step 1.

    Indices beyond the shape are kept; what they select is fill. Fewer or more
    selectors than dimensions, and ranges that end before they begin, are errors.
    """
    if selection is None:
        return [(0, n) for n in shape]
    if len(selection) != len(shape):
        raise SliceError(f"{len(selection)} selectors for {len(shape)} dimensions")
    box = []
    for selector, n in zip(selection, shape, strict=True):
        if selector is None:
            box.append((0, n))
        elif isinstance(selector, int):
            box.append((selector, selector + 1))
        else:
            start, stop = selector
            if start > stop:
                raise SliceError(f"range [{start}, {stop}) ends before it begins")
            box.append((int(start), int(stop)))
    return box


def volume(box: Box) -> int:
    return prod(b - a for a, b in box)


def chunk_box(box: Box, chunks: Sequence[int]) -> Box:
    """The chunks, as a box of the chunk grid, that hold a box of cells; empty if the box is."""
    if volume(box) == 0 and box:
        return [(0, 0)] * len(box)
    return [(a // c, (b - 1) // c + 1) for (a, b), c in zip(box, chunks, strict=True)]


def grid_box(shape: Sequence[int], chunks: Sequence[int]) -> Box:
    return [(0, -(-n // c)) for n, c in zip(shape, chunks, strict=True)]


def coordinates(box: Box) -> Iterator[tuple[int, ...]]:
    """All points of a box, the last dimension fastest."""
    return product(*(range(a, b) for a, b in box))


def nth_coordinate(box: Box, n: int) -> tuple[int, ...]:
    """The n-th of ``coordinates(box)`` without walking there."""
    out = []
    for a, b in reversed(box):
        n, i = divmod(n, b - a)
        out.append(a + i)
    return tuple(reversed(out))


def chunk_key(coordinate: Sequence[int], separator: str = ".") -> str:
    """The key of a chunk inside its array; the only chunk of an array without dimensions is 0."""
    return separator.join(map(str, coordinate)) or "0"


def strides(shape: Sequence[int], order: str = "C") -> list[int]:
    """Elements between neighbours along each dimension."""
    sizes = list(shape) if order == "F" else list(reversed(shape))
    out, step = [], 1
    for n in sizes:
        out.append(step)
        step *= n
    return out if order == "F" else out[::-1]


def inside(coordinate: Sequence[int], chunks: Sequence[int], box: Box) -> Box:
    """The part of ``box`` in one chunk, in the chunk's own indices."""
    return [(max(a, i * c) - i * c, min(b, (i + 1) * c) - i * c) for i, c, (a, b) in zip(coordinate, chunks, box, strict=True)]


def within_shape(coordinate: Sequence[int], chunks: Sequence[int], shape: Sequence[int]) -> Box:
    """The part of a chunk that holds data, in the chunk's own indices; the rest is padding."""
    return [(0, max(0, min(c, n - i * c))) if i >= 0 else (0, 0) for i, c, n in zip(coordinate, chunks, shape, strict=True)]


def byte_span(part: Box, chunks: Sequence[int], item: int) -> tuple[int, int] | None:
    """(offset, length) of a part of a C-ordered stored chunk, if its bytes are contiguous and fewer than all.

    They are if, behind the first dimension of which more than one index is
    taken, each dimension is taken over its full stored width.
    """
    if volume(part) in (0, prod(chunks)):
        return None
    first = next((d for d, (a, b) in enumerate(part) if b - a > 1), len(part))
    if any((a, b) != (0, c) for (a, b), c in list(zip(part, chunks, strict=True))[first + 1 :]):
        return None
    offset = sum(a * s for (a, _), s in zip(part, strides(chunks), strict=True))
    return offset * item, volume(part) * item
