"""Projections of one grid's values; a chain of them is one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from gridwright.operators.grid import Grid, wide


def for_each(g: Grid, f: Callable[[F.Column], F.Column]) -> Grid:
    """``f`` of each value; nothing is changed in place, the result is a grid."""
    return g.with_value(f(g.value))


transform = for_each


def for_each_position(g: Grid, f: Callable[..., F.Column]) -> Grid:
    """``f`` of each value and its coordinates."""
    return g.with_value(f(g.value, *(F.col(d) for d in g.dims)))


transform_position = for_each_position


def with_position(g: Grid) -> Grid:
    """Element and position as one value."""
    return g.with_value(F.struct(g.value.alias("element"), F.array(*g.dims).alias("position")))


def identity(g: Grid) -> Grid:
    return g


def cast(g: Grid, kind: str) -> Grid:
    """Fractions are cut off, values that don't fit are an error."""
    return g.with_value(g.value.cast(kind))


def rounded(g: Grid) -> Grid:
    """To whole numbers, halves away from zero."""
    return g.with_value(F.round(g.value))


def clamp(g: Grid, low, high) -> Grid:
    return g.with_value(F.when(g.value <= low, F.lit(low)).when(g.value >= high, F.lit(high)).otherwise(g.value))


def square(g: Grid) -> Grid:
    return g.with_value(wide(g) * wide(g))


def square_root(g: Grid) -> Grid:
    return g.with_value(F.sqrt(g.value))


def multiply_by(g: Grid, factor) -> Grid:
    return g.with_value(F.lit(factor) * wide(g))


def add_value(g: Grid, value) -> Grid:
    return g.with_value(F.lit(value) + wide(g))


increment = add_value


def lower_limit(g: Grid, limit, instead=None) -> Grid:
    """Values below the limit become it, or ``instead``."""
    return g.with_value(F.when(g.value < limit, F.lit(limit if instead is None else instead)).otherwise(g.value))


def upper_limit(g: Grid, limit, instead=None) -> Grid:
    return g.with_value(F.when(g.value > limit, F.lit(limit if instead is None else instead)).otherwise(g.value))


def absolute(g: Grid) -> Grid:
    return g.with_value(F.abs(g.value))


def perceptual_scale(g: Grid) -> Grid:
    """``log(1 + v)``"""
    return g.with_value(F.log1p(g.value))


def threshold(g: Grid, limit, above=255, below=0) -> Grid:
    return g.with_value(F.when(g.value > limit, F.lit(above)).otherwise(F.lit(below)))


def by_batches(g: Grid, f: Callable, kind: str) -> Grid:
    """A vectorised Python function of the values (pandas series to series), for what columns can't express."""
    return g.with_value(F.pandas_udf(f, kind)(g.value))
