"""Shapes, regions and linear indices.  Axis 0 is x and varies fastest."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from math import prod

from pyspark.sql import functions as F

from gridwright.errors import InvalidRange

AXES = ("x", "y", "z")
Size = tuple[int, ...]


@dataclass(frozen=True)
class Region:
    """A box of cells."""

    corner: Size
    size: Size

    @property
    def end(self) -> Size:
        return tuple(c + s for c, s in zip(self.corner, self.size))

    def holds(self, index: Sequence[int]) -> bool:
        return all(c <= i < e for i, c, e in zip(index, self.corner, self.end))

    def inside(self, size: Size) -> bool:
        return all(c >= 0 and s >= 0 and e <= n for c, s, e, n in zip(self.corner, self.size, self.end, size))

    def grown(self, low: Sequence[int], high: Sequence[int]) -> Region:
        return Region(tuple(c - a for c, a in zip(self.corner, low)), tuple(s + a + b for s, a, b in zip(self.size, low, high)))

    def clamped(self, size: Size) -> Region:
        corner = tuple(min(max(c, 0), n) for c, n in zip(self.corner, size))
        return Region(corner, tuple(max(0, min(e, n) - c) for e, n, c in zip(self.end, size, corner)))


def checked(region: Region, size: Size) -> Region:
    if len(region.corner) != len(size) or len(region.size) != len(size) or not region.inside(size):
        raise InvalidRange(region, size)
    return region


def valid_region(size: Size) -> Region:
    return Region((0,) * len(size), tuple(size))


def is_inside(index: Sequence[int], size: Size) -> bool:
    return valid_region(size).holds(index)


def element_count(size: Size) -> int:
    return prod(size)


def is_empty(size: Size) -> bool:
    return prod(size) == 0


def strides(size: Size) -> Size:
    """Cells between neighbours along each axis: 1, sx, sx * sy."""
    return tuple(prod(size[:d]) for d in range(len(size)))


def linear_index(index: Sequence[int], size: Size) -> int:
    return sum(i * s for i, s in zip(index, strides(size)))


def index_of(linear: int, size: Size) -> Size:
    return tuple(linear // s % n for s, n in zip(strides(size), size))


def wrap_to_index(linear: int, size: Size) -> Size:
    """The index in iteration order, in which the last axis varies fastest."""
    return tuple(reversed(index_of(linear, tuple(reversed(size)))))


def linear_column(size: Size, dims: Sequence[str] = AXES) -> F.Column:
    """Linear index of a cell, as a bigint."""
    out = F.col(dims[0]).cast("bigint")
    for d, s in list(zip(dims, strides(size)))[1 : len(size)]:
        out = out + F.col(d).cast("bigint") * F.lit(s).cast("bigint")
    return out


def coordinate_columns(linear: str, size: Size) -> list[F.Column]:
    """Coordinates of the linear index in a bigint column, by whole-number arithmetic."""
    return [F.expr(f"({linear} div {s}) % {n}") if s > 1 else F.expr(f"{linear} % {n}") for s, n in zip(strides(size), size)]


def offsets(size: Size, centre: Size) -> Iterator[tuple[Size, Size]]:
    """Kernel positions with their offsets from the centre."""
    for at in product(*(range(n) for n in size)):
        yield at, tuple(a - c for a, c in zip(at, centre))


def sum_each_neighbour(start: Sequence[int], end: Sequence[int], f: Callable) -> object:
    """Sum of ``f`` over the half-open box."""
    return sum(f(i) for i in product(*(range(a, b) for a, b in zip(start, end))))


def largest_batch(first: int, last: int, memory: int, cost: Callable[[int], int]) -> tuple[int, int]:
    """The largest batch size in ``first..last`` whose cost fits, with its cost.

    (0, 0) for an empty range, (-1, -1) if not even ``first`` fits; costs must not fall.
    """
    if first > last:
        return 0, 0
    low, high, best = first, last, -1
    while low <= high:
        mid = (low + high) // 2
        if cost(mid) <= memory:
            best, low = mid, mid + 1
        else:
            high = mid - 1
    return (best, cost(best)) if best >= 0 else (-1, -1)
