"""Grids that are computed, not read."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridwright.functions.shapes import AXES, Region, coordinate_columns, element_count, linear_column, valid_region
from gridwright.operators.grid import Grid


def generated(spark: SparkSession, size: Sequence[int], f: Callable[[Sequence[F.Column]], F.Column], region: Region | None = None) -> Grid:
    """``f`` of the coordinates; of a region only its cells are ever made, rebased to zero."""
    size = tuple(size)
    part = region or valid_region(size)
    rows = spark.range(element_count(part.size))
    df = rows.select(*(c.alias(d) for c, d in zip(coordinate_columns("id", part.size), AXES)))
    at = [F.col(d) + F.lit(c).cast("bigint") for d, c in zip(AXES, part.corner)]
    again = lambda r: generated(spark, size, f, Region(tuple(a + b for a, b in zip(part.corner, r.corner)), r.size))
    return Grid(df, part.size, f(at), again)


def constant(spark: SparkSession, value, size: Sequence[int]) -> Grid:
    return generated(spark, size, lambda at: F.lit(value))


def unique_id(spark: SparkSession, size: Sequence[int], first: int = 0) -> Grid:
    """The linear index, from ``first``."""

    def value(at):
        stride, out = 1, F.lit(first).cast("bigint")
        for a, n in zip(at, size):
            out, stride = out + a * F.lit(stride).cast("bigint"), stride * n
        return out

    return generated(spark, size, value)


def checkerboard(spark: SparkSession, white, black, tile: Sequence[int], size: Sequence[int]) -> Grid:
    """Tiles of two values; that at the origin is black."""
    return generated(spark, size, lambda at: F.when(sum((F.floor(a / F.lit(t)) for a, t in zip(at[1:], tile[1:])), F.floor(at[0] / F.lit(tile[0]))) % 2 == 1, F.lit(white)).otherwise(F.lit(black)))


def sinus(spark: SparkSession, amplitude: Sequence[float], frequency: Sequence[float], phase: Sequence[float], size: Sequence[int]) -> Grid:
    """Sum over the axes of ``a * sin(f * 2 pi * i / s + p)``."""
    term = lambda d, at: F.lit(float(amplitude[d])) * F.sin(F.lit(2 * math.pi * frequency[d]) * at[d] / F.lit(float(size[d])) + F.lit(float(phase[d])))
    return generated(spark, size, lambda at: reduce(lambda a, b: a + b, (term(d, at) for d in range(len(size)))))


def mesh_grid(spark: SparkSession, start: Sequence[int], end: Sequence[int]) -> list[Grid]:
    """One grid per axis with its coordinate, from ``start`` toward ``end``, which is not reached."""
    size = [abs(b - a) for a, b in zip(start, end)]
    return [generated(spark, size, lambda at, d=d: F.lit(start[d]).cast("bigint") + (1 if end[d] >= start[d] else -1) * at[d]) for d in range(len(size))]


def index_view(spark: SparkSession, size: Sequence[int]) -> Grid:
    """The index of each cell as an array."""
    return generated(spark, size, lambda at: F.array(*at))


def superposed_boards(spark: SparkSession, size: Sequence[int], count: int, base: int = 3) -> Grid:
    """Sum of 0/1 boards with tiles of ``base ** k``."""
    boards = [checkerboard(spark, 1, 0, [base**k] * len(size), size).value for k in range(count)]
    return Grid(constant(spark, 0, size).df, size, reduce(lambda a, b: a + b, boards))


def mandelbrot(spark: SparkSession, size: Sequence[int], low: Sequence[float] = (-2.0, -1.0), high: Sequence[float] = (1.0, 1.0), most: int = 500) -> Grid:
    """Steps until ``z * z + c`` leaves the circle of radius 2, ``most`` at most."""

    def steps(re, im):
        cr, ci = re.to_numpy(), im.to_numpy()
        n, live = np.zeros(len(cr), np.int32), np.arange(len(cr))
        zr = zi = np.zeros(len(cr))
        for _ in range(most):
            zr, zi = zr * zr - zi * zi + cr[live], 2 * zr * zi + ci[live]
            inside = zr * zr + zi * zi <= 4
            live, zr, zi = live[inside], zr[inside], zi[inside]
            n[live] += 1
        return pd.Series(n)

    count = F.pandas_udf(steps, "int")
    scale = [(h - a) / n for a, h, n in zip(low, high, size)]
    return generated(spark, size, lambda at: count(F.lit(low[0]) + at[0] * F.lit(scale[0]), F.lit(low[1]) + at[1] * F.lit(scale[1])))


def linear_ids(g: Grid) -> Grid:
    """The linear index of each cell of a grid."""
    return g.with_value(linear_column(g.size, g.dims))
