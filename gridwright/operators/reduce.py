"""Reductions of whole grids and of one axis, by partial and final aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators import tiles
from gridwright.operators.grid import Grid, aligned, wide

# name: aggregate of a column, and how the initial value joins its result
OPERATIONS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda r, i: r + i),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "product": (F.product, lambda r, i: r * i),
    "and": (F.bool_and, lambda r, i: r & i),
    "or": (F.bool_or, lambda r, i: r | i),
    "bit_and": (F.bit_and, lambda r, i: r.bitwiseAND(i)),
    "bit_or": (F.bit_or, lambda r, i: r.bitwiseOR(i)),
    "bit_xor": (F.bit_xor, lambda r, i: r.bitwiseXOR(i)),
}


def _aggregate(value: F.Column, operation: str, initial) -> F.Column:
    f, joined = OPERATIONS[operation]
    out = f(value)
    return out if initial is None else joined(out, F.lit(initial))


def reduce(g: Grid, operation: str, initial=None) -> DataFrame:
    """One row ``v``; the initial value counts once."""
    return g.df.select(wide(g).alias("v")).agg(_aggregate(F.col("v"), operation, initial).alias("v"))


def dimension_reduce(g: Grid, axis: int, operation: str, initial=None) -> Grid:
    """The grid without ``axis``, whose cells are reduced; the initial value counts once for each result."""
    rest = [d for i, d in enumerate(g.dims) if i != axis]
    df = g.df.select(*rest, wide(g).alias("v")).groupBy(*rest).agg(_aggregate(F.col("v"), operation, initial).alias("v"))
    size = [s for i, s in enumerate(g.size) if i != axis]
    return Grid(df.select(*(F.col(d).alias(n) for d, n in zip(rest, "xyz")), "v"), size)


def reduce_by(g: Grid, partial: Callable, final: Callable, kind: str) -> DataFrame:
    """Any associative operator: ``partial`` of each batch's values (a series), ``final`` of the partial results."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [partial(b["v"]) for b in batches if len(b)]
        if found:
            yield pd.DataFrame({"v": [final(pd.Series(found))]})

    def all_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [x for b in batches for x in b["v"]]
        if found:
            yield pd.DataFrame({"v": [final(pd.Series(found))]})

    # a shuffle: `some` runs in as many tasks as the grid has, and one value of each reaches the last task
    return g.df.select(g.value.alias("v")).mapInPandas(some, f"v {kind}").repartition(1).mapInPandas(all_, f"v {kind}")


def reduce_along(g: Grid, axis: int, f: Callable[[np.ndarray, int], np.ndarray], cells: int = tiles.CELLS) -> Grid:
    """The grid without ``axis``, along which an associative operator has joined the cells in their order.

    ``f`` joins an array's values along a numpy axis (``np.gcd.reduce`` is one); it
    needn't commute.  Tiles are joined first, then their results, level by level,
    so no task holds a whole line.  Whole numbers are int64, others float64.
    """
    dims, kind = g.dims, "bigint" if g.is_whole else "double"
    schema = pa.schema([*((d, pa.int64()) for d in dims), ("v", pa.int64() if g.is_whole else pa.float64())])
    at, none = len(dims) - 1 - axis, [0] * len(dims)

    def joined(size: Sequence[int], side: Sequence[int]) -> Callable[[pa.Table], pa.Table]:
        def apply(table: pa.Table) -> pa.Table:
            origin = [int(table.column(f"_t{d}")[0].as_py()) * t for d, t in zip(dims, side)]
            tile = tiles.Tile(origin, [min(t, n - o) for t, n, o in zip(side, size, origin)], size, none, none)
            out = np.expand_dims(f(tiles.filled(table, tile, dims), at), at)
            where = np.indices(out.shape).reshape(len(dims), -1)[::-1]
            places = [w + (o // t if d == axis else o) for d, (w, o, t) in enumerate(zip(where, origin, side))]
            return pa.table([*map(pa.array, places), pa.array(out.reshape(-1))], schema=schema)

        return apply

    while True:
        size, side = g.size, tiles.tile_size(g.size, cells)
        if side[axis] == 1 < size[axis]:  # narrow tiles would join nothing
            side = tuple(max(2, min(s, cells)) if d == axis else 1 for d, s in enumerate(size))
        rows = tiles.spread(g, none, none, side, "none").groupBy(*(f"_t{d}" for d in dims)).applyInArrow(joined(size, side), ", ".join([*(f"{d} bigint" for d in dims), f"v {kind}"]))
        g = Grid(rows, [-(-s // t) if d == axis else s for d, (s, t) in enumerate(zip(size, side))])
        if g.size[axis] == 1:
            rest = [d for i, d in enumerate(dims) if i != axis]
            return Grid(rows.select(*(F.col(d).alias(n) for d, n in zip(rest, dims)), "v"), [s for i, s in enumerate(size) if i != axis])


def total(g: Grid, initial=0) -> DataFrame:
    return reduce(g, "sum", initial)


def min_max(g: Grid) -> DataFrame:
    return g.df.agg(F.min(g.value).alias("min"), F.max(g.value).alias("max"))


def min_max_mean(g: Grid) -> DataFrame:
    return g.df.agg(F.min(g.value).alias("min"), F.max(g.value).alias("max"), F.avg(g.value.cast("double")).alias("mean"))


def all_finite(g: Grid) -> DataFrame:
    v = g.value.cast("double")
    return g.df.agg(F.bool_and(~F.isnan(v) & (F.abs(v) < float("inf"))).alias("v"))


def vector_reduce(g: Grid, length: int, operation: str) -> DataFrame:
    """Arrays of ``length`` reduced element by element."""
    return g.df.select(g.value.alias("v")).agg(F.array(*(OPERATIONS[operation][0](F.col("v")[i]) for i in range(length))).alias("v"))


def arg_max(g: Grid, skip_first: bool = False) -> DataFrame:
    """Coordinates and value of the largest cell, the first of equal ones; ``skip_first``: not at index 0 of an axis."""
    from gridwright.functions.shapes import linear_column

    df = g.cells
    if skip_first:
        for d in g.dims:
            df = df.where(F.col(d) > 0)
    best = F.max_by(F.struct(*g.dims, "v"), F.struct("v", -linear_column(g.size, g.dims)))
    return df.agg(best.alias("best")).select(*(F.col("best")[d].alias(d) for d in (*g.dims, "v")))


def max_intensity(g: Grid, axis: int) -> Grid:
    """Maximum-intensity projection along an axis."""
    return dimension_reduce(g, axis, "max")


def square_difference(a: Grid, b: Grid) -> DataFrame:
    df, (v, w) = aligned([a, b])
    return df.agg(F.sum((v - w) * (v - w)).alias("v"))


def max_range_converted(g: Grid, low: int, high: int) -> Grid:
    """Values mapped from their own minimum and maximum to ``low``..``high``; one row is broadcast.

    Between whole numbers the scale factor is whole too, and zero for one value only.
    """
    own = g.settled()
    ends = own.df.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    df = own.df.crossJoin(F.broadcast(ends))  # a single row
    if g.is_whole:
        factor = F.expr(f"if(_hi = _lo, 0L, {high - low} div (_hi - _lo))")
        return Grid(df, g.size, ((F.col("v") - F.col("_lo")) * factor + F.lit(low)).cast("bigint"))
    span = F.col("_hi") - F.col("_lo")
    factor = F.when(span == 0, 0.0).otherwise(F.lit(float(high - low)) / F.when(span == 0, 1.0).otherwise(span))
    return Grid(df, g.size, ((F.col("v") - F.col("_lo")) * factor + F.lit(low)).cast("bigint"))
