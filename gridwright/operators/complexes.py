"""Complex values as ``struct<re, im>``: column functions, and grids of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.operators.grid import Grid, ieee_div

TINY = 1e-6
"""Magnitude below which a value has no direction: its unit is zero."""
Column = F.Column


def make(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def re(c: Column) -> Column:
    return c["re"]


def im(c: Column) -> Column:
    return c["im"]


def plus(a: Column, b: Column) -> Column:
    return make(re(a) + re(b), im(a) + im(b))


def minus(a: Column, b: Column) -> Column:
    return make(re(a) - re(b), im(a) - im(b))


def product(a: Column, b: Column) -> Column:
    return make(re(a) * re(b) - im(a) * im(b), re(a) * im(b) + im(a) * re(b))


def scaled(a: Column, f: Column) -> Column:
    return make(re(a) * f, im(a) * f)


def quotient(a: Column, b: Column) -> Column:
    top = product(a, conjugate(b))
    return make(ieee_div(re(top), squared(b)), ieee_div(im(top), squared(b)))


def over_real(a: Column, f: Column) -> Column:
    return make(ieee_div(re(a), f.cast("double")), ieee_div(im(a), f.cast("double")))


def parts_product(a: Column, b: Column) -> Column:
    return make(re(a) * re(b), im(a) * im(b))


def conjugate(a: Column) -> Column:
    return make(re(a), -im(a))


def squared(a: Column) -> Column:
    """Squared magnitude."""
    return re(a) * re(a) + im(a) * im(a)


def size_of(a: Column) -> Column:
    return F.sqrt(squared(a))


def angle(a: Column) -> Column:
    """In [0, 2 pi), zero at the origin."""
    t = F.atan2(im(a), re(a))
    return F.when((re(a) == 0) & (im(a) == 0), 0.0).when(t < 0, t + 2 * math.pi).otherwise(t)


def unit(a: Column) -> Column:
    """The value over its magnitude, zero below :data:`TINY`."""
    m = size_of(a)
    safe = F.when(m < TINY, F.lit(1.0)).otherwise(m)
    return F.when(m < TINY, make(F.lit(0.0), F.lit(0.0))).otherwise(make(re(a) / safe, im(a) / safe))


def equal(a: Column, b: Column) -> Column:
    return (re(a) == re(b)) & (im(a) == im(b))


def is_complex(g: Grid) -> bool:
    k = g.kind
    return isinstance(k, T.StructType) and k.fieldNames() == ["re", "im"]


def magnitude(g: Grid) -> Grid:
    return g.with_value(size_of(g.value))


def amplitude(g: Grid) -> Grid:
    """The squared magnitude."""
    return g.with_value(squared(g.value))


def phase(g: Grid) -> Grid:
    return g.with_value(angle(g.value))


def conjugated(g: Grid) -> Grid:
    return g.with_value(conjugate(g.value))


def normalized(g: Grid) -> Grid:
    """Unit values: complex, or arrays by their norm."""
    if is_complex(g):
        return g.with_value(unit(g.value))
    from gridwright.operators import vectors

    return g.with_value(vectors.normalize(g.value))


def phase_shift(g: Grid, shift, sizes=None, axes=(0,)) -> Grid:
    """Times ``exp(-2 pi i * k * s / n)`` along ``axes``; by default the first only, in units of the spectrum's full size."""
    n = sizes or g.size
    t = sum((F.col(g.dims[d]) * (-2 * math.pi * shift[d] / n[d]) for d in axes[1:]), F.col(g.dims[axes[0]]) * (-2 * math.pi * shift[axes[0]] / n[axes[0]]))
    return g.with_value(product(g.value, make(F.cos(t), F.sin(t))))


def wiener(g: Grid, noise: float) -> Grid:
    """``conjugate(v) / (|v|^2 + noise)``"""
    return g.with_value(over_real(conjugate(g.value), squared(g.value) + noise))
