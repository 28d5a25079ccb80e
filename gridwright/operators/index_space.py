"""Crops, slices, mirrors, padding and other moves of cells: projections and filters, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from gridwright.errors import SliceOutOfRange
from gridwright.functions.shapes import AXES, Region, coordinate_columns, element_count
from gridwright.operators import complexes
from gridwright.operators.grid import Grid


def subview(g: Grid, corner: Sequence[int], size: Sequence[int]) -> Grid:
    """The cells of a region, rebased to zero; of a computed grid only those are made."""
    region = g.check_inside(Region(tuple(corner), tuple(size)))
    if g.remake:
        return g.remake(region)
    df = g.df
    for d, c, s, whole in zip(g.dims, corner, size, g.size):
        if (c, s) != (0, whole):
            df = df.where((F.col(d) >= c) & (F.col(d) < c + s))
    moved = [(F.col(d) - F.lit(c).cast("bigint")).alias(d) for d, c in zip(g.dims, corner)]
    return Grid(df.select(*moved, g.value.alias("v")), size)


def array_subview(g: Grid, first: int, last: int) -> Grid:
    """The range ``first..last`` of a one-dimensional grid, ``last`` excluded."""
    return subview(g, (first,), (last - first,))


def sliced(g: Grid, axis: int, at: int) -> Grid:
    """The cells with one coordinate, without that axis."""
    if not 0 <= at < g.size[axis]:
        raise SliceOutOfRange(at, g.size[axis])
    rest = [(d, s) for i, (d, s) in enumerate(zip(g.dims, g.size)) if i != axis]
    df = g.df.where(F.col(g.dims[axis]) == at).select(*(F.col(d).alias(n) for (d, _), n in zip(rest, AXES)), g.value.alias("v"))
    return Grid(df, [s for _, s in rest])


def mirrored(g: Grid, flips: Sequence[bool]) -> Grid:
    moved = [(F.lit(s - 1).cast("bigint") - F.col(d) if f else F.col(d)).alias(d) for d, s, f in zip(g.dims, g.size, flips)]
    return Grid(g.df.select(*moved, g.value.alias("v")), g.size)


def padded(g: Grid, size: Sequence[int], offset: Sequence[int], fill) -> Grid:
    """The grid at ``offset`` in a larger one that wraps around; other cells are ``fill``."""
    size = tuple(size)
    moved = [F.pmod(F.col(d) + F.lit(o).cast("bigint"), F.lit(n).cast("bigint")).alias(d) for d, o, n in zip(g.dims, offset, size)]
    inside = g.df.select(*moved, g.value.alias("v"))
    rest = g.df.sparkSession.range(element_count(size)).select(*(c.alias(d) for c, d in zip(coordinate_columns("id", size), g.dims)))
    covered = F.lit(True)
    for d, o, n, s in zip(g.dims, offset, size, g.size):
        covered = covered & (F.pmod(F.col(d) - F.lit(o).cast("bigint"), F.lit(n).cast("bigint")) < s)
    outside = rest.where(~covered).select(*g.dims, F.lit(fill).cast(g.kind).alias("v"))
    return Grid(inside.unionByName(outside), size)


def swizzled(g: Grid, order: Sequence[int]) -> Grid:
    """Axis ``i`` of the result is axis ``order[i]`` of the grid."""
    df = g.df.select(*(F.col(g.dims[o]).alias(d) for o, d in zip(order, AXES)), g.value.alias("v"))
    return Grid(df, [g.size[o] for o in order])


def reshaped(g: Grid, size: Sequence[int]) -> Grid:
    """The same linear order in another shape."""
    from gridwright.functions.shapes import linear_column

    df = g.settled().df.select(linear_column(g.size, g.dims).alias("_i"), "v")
    return Grid(df.select(*(c.alias(d) for c, d in zip(coordinate_columns("_i", tuple(size)), AXES)), "v"), size)


def stack_slice(g: Grid, at: int) -> Grid:
    """Slice ``at`` of a stack, whose last axis numbers the slices."""
    return sliced(g, g.dimension - 1, at)


def stacked(slices: Sequence[Grid]) -> Grid:
    """Grids of one size as slices of a stack."""
    from gridwright.errors import IncompatibleViewSizes

    if len({s.size for s in slices}) > 1:
        raise IncompatibleViewSizes(*(s.size for s in slices))
    last = AXES[slices[0].dimension]
    parts = [s.cells.withColumn(last, F.lit(i).cast("bigint")) for i, s in enumerate(slices)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Grid(out, (*slices[0].size, len(slices)))


def centred_half(g: Grid) -> Grid:
    """A half spectrum with negative frequencies as negative coordinates along y and z."""
    df = g.settled().df
    for d, s in list(zip(g.dims, g.size))[1:]:
        df = df.withColumn(d, F.when(F.col(d) >= s - (s - 1) // 2, F.col(d) - s).otherwise(F.col(d)))
    return Grid(df, g.size)


def full_spectrum(g: Grid) -> Grid:
    """All frequencies of a half spectrum, zero frequency in the middle; every axis becomes odd.

    What the half lacks follows by Hermitian symmetry.  The outermost frequency
    of an even axis shows at both ends.
    """
    size = (2 * g.size[0] - 1, *(s + 1 - s % 2 for s in g.size[1:]))
    df = g.settled().df
    for d, s in list(zip(g.dims, g.size))[1:]:
        none = F.array().cast("array<bigint>")
        ends = F.concat(F.when(F.col(d) <= s // 2, F.array(d)).otherwise(none), F.when(F.col(d) - s >= -(s // 2), F.array(F.col(d) - F.lit(s).cast("bigint"))).otherwise(none))
        df = df.withColumn(d, F.explode(ends))
    twins = df.where("x > 0").select(*((-F.col(d)).alias(d) for d in g.dims), complexes.conjugate(F.col("v")).alias("v"))
    moved = [(F.col(d) + F.lit(s // 2).cast("bigint")).alias(d) for d, s in zip(g.dims, size)]
    return Grid(df.select(*g.dims, complexes.make(F.col("v.re"), F.col("v.im")).alias("v")).unionByName(twins).select(*moved, "v"), size)


def bounded(g: Grid, size: Sequence[int], corner: Sequence[int], outside) -> Grid:
    """Access to any region: cells outside of the grid are ``outside``."""
    want = g.df.sparkSession.range(element_count(size)).select(*(c.alias(d) for c, d in zip(coordinate_columns("id", tuple(size)), g.dims)))
    have = g.cells.select(*((F.col(d) - F.lit(c).cast("bigint")).alias(d) for d, c in zip(g.dims, corner)), "v")
    return Grid(want.join(have, list(g.dims), "left").select(*g.dims, F.coalesce("v", outside if isinstance(outside, F.Column) else F.lit(outside)).alias("v")), size)
