"""Grids combined cell by cell: one projection over a shared DataFrame, else an equi-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from gridwright.operators import complexes
from gridwright.operators.grid import Grid, arithmetic, divide, n_ary  # noqa: F401


def linear_combination(f1, a: Grid, f2, b: Grid) -> Grid:
    return arithmetic(a, b, lambda v, w: F.lit(f1) * v + F.lit(f2) * w)


def add(a: Grid, b: Grid) -> Grid:
    return a + b


def subtract(a: Grid, b: Grid) -> Grid:
    return a - b


def multiply(a: Grid, b: Grid) -> Grid:
    """Product; the complex product of complex grids."""
    if complexes.is_complex(a) and complexes.is_complex(b):
        return n_ary(complexes.product, a, b)
    return a * b


def binary(f: Callable[[F.Column, F.Column], F.Column], a: Grid, b: Grid) -> Grid:
    return n_ary(f, a, b)


def zipped(*grids: Grid) -> Grid:
    """Values of all grids as one struct."""
    return n_ary(lambda *v: F.struct(*(x.alias(f"_{i}") for i, x in enumerate(v))), *grids)


def hadamard(a: Grid, b: Grid) -> Grid:
    """Products of the parts of complex values."""
    return n_ary(complexes.parts_product, a, b)


def cross_power_spectrum(a: Grid, b: Grid) -> Grid:
    """``a * conjugate(b)`` of unit magnitude."""
    return n_ary(lambda v, w: complexes.unit(complexes.product(v, complexes.conjugate(w))), a, b)


def sum_square_differences(a: Grid, b: Grid, initial=0):
    """The sum over all cells of ``(a - b) ** 2``, as a DataFrame of one row."""
    from gridwright.operators.elementwise import square
    from gridwright.operators.reduce import total

    return total(square(a - b), initial)
