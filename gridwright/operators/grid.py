"""The grid: a dense array of one to three dimensions as a lazy DataFrame.

A row is a cell: bigint coordinates ``x[, y[, z]]`` and what its value is computed
from.  The shape is known when the plan is built.  A grid keeps its value as an
expression over its DataFrame, so element-wise operations add projections only,
and grids over one DataFrame combine in one projection; others meet in an
equi-join on the coordinates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.errors import GridError, IncompatibleViewSizes, InvalidRange
from gridwright.functions.shapes import AXES, Region, Size, element_count

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Grid:
    """``df`` with a row per cell of ``size``; ``value`` gives the cell's value."""

    def __init__(self, df: DataFrame, size: Sequence[int], value: F.Column | None = None, remake: Callable[[Region], Grid] | None = None, lines: DataFrame | None = None):
        if not 1 <= len(size) <= 3:
            raise GridError(f"{len(size)} dimensions")
        self.df, self.size = df, tuple(int(s) for s in size)
        self.value = F.col("v") if value is None else value
        self.remake = remake
        self.lines = lines  # the same cells with a whole line along x as the array `line` of a row `y`, if they came so

    @property
    def dims(self) -> tuple[str, ...]:
        return AXES[: len(self.size)]

    @property
    def dimension(self) -> int:
        return len(self.size)

    @property
    def element_count(self) -> int:
        return element_count(self.size)

    @property
    def cells(self) -> DataFrame:
        """Coordinates and ``v``."""
        return self.df.select(*self.dims, self.value.alias("v"))

    @property
    def kind(self) -> T.DataType:
        return self.df.select(self.value.alias("v")).schema["v"].dataType

    @property
    def is_whole(self) -> bool:
        return isinstance(self.kind, WHOLE)

    def with_value(self, value: F.Column) -> Grid:
        """Another value of the same cells."""
        return Grid(self.df, self.size, value)

    def settled(self) -> Grid:
        """The value as a column of its own, for operators that read it more than once."""
        return Grid(self.cells, self.size)

    def over(self, df: DataFrame, size: Sequence[int] | None = None) -> Grid:
        """A grid of the cells of ``df`` (coordinates and ``v``)."""
        return Grid(df, self.size if size is None else size)

    def check_inside(self, region: Region) -> Region:
        if not region.inside(self.size):
            raise InvalidRange(region, self.size)
        return region

    def validate(self) -> None:
        """Raise unless every cell is there once, within the shape, with a value."""
        inside = F.lit(True)
        for d, s in zip(self.dims, self.size):
            inside = inside & F.col(d).between(0, s - 1)
        seen = self.cells.agg(F.count("*").alias("n"), F.count_if(~inside).alias("out"), F.count_if(F.col("v").isNull()).alias("null")).first()
        twice = self.cells.groupBy(*self.dims).count().where("count > 1").limit(1).count()
        if seen.n != self.element_count or seen.out or seen.null or twice:
            raise GridError(f"{seen.n} cells for {self.element_count}, {seen.out} outside, {seen.null} null, repeated: {bool(twice)}")

    def __add__(self, other):
        return arithmetic(self, other, lambda a, b: a + b)

    def __sub__(self, other):
        return arithmetic(self, other, lambda a, b: a - b)

    def __mul__(self, other):
        return arithmetic(self, other, lambda a, b: a * b)

    def __truediv__(self, other):
        return divide(self, other)

    def __radd__(self, other):
        return self.with_value(F.lit(other) + wide(self))

    def __rsub__(self, other):
        return self.with_value(F.lit(other) - wide(self))

    def __rmul__(self, other):
        return self.with_value(F.lit(other) * wide(self))

    def __rtruediv__(self, other):
        return divide(self.with_value(F.lit(other)), self)


def wide(g: Grid) -> F.Column:
    """The value, whole numbers as bigints."""
    return g.value.cast("bigint") if g.is_whole else g.value


def aligned(grids: Sequence[Grid]) -> tuple[DataFrame, list[F.Column]]:
    """One DataFrame with all cells and each grid's value over it.

    Without a join if all grids are over one DataFrame.
    """
    first = grids[0]
    if len({g.size for g in grids}) > 1:
        raise IncompatibleViewSizes(*(g.size for g in grids))
    if all(g.df is first.df for g in grids):
        return first.df, [g.value for g in grids]
    named = [g.df.select(*g.dims, g.value.alias(f"v{i}")) for i, g in enumerate(grids)]
    df = named[0]
    for other in named[1:]:
        df = df.join(other, list(first.dims))
    return df, [F.col(f"v{i}") for i in range(len(grids))]


def n_ary(f: Callable[..., F.Column], *grids: Grid) -> Grid:
    """``f`` of the values of all grids, cell by cell."""
    df, values = aligned(grids)
    return Grid(df, grids[0].size, f(*values))


def arithmetic(a: Grid, b, f: Callable[[F.Column, F.Column], F.Column]) -> Grid:
    if not isinstance(b, Grid):
        return a.with_value(f(wide(a), F.lit(b)))
    return n_ary(f, a.with_value(wide(a)), b.with_value(wide(b)))


def divide(a: Grid, b) -> Grid:
    """Whole numbers: truncated toward zero; else by IEEE rules, zero divisors included."""
    both = isinstance(b, Grid)
    whole = a.is_whole and (b.is_whole if both else isinstance(b, int))
    if not both:
        b = a.with_value(F.lit(b))
    df, (v, w) = aligned([a, b])
    if whole:
        df = df.select(*a.dims, v.cast("bigint").alias("v0"), w.cast("bigint").alias("v1"))
        return Grid(df, a.size, F.expr("v0 div v1"))
    return Grid(df, a.size, ieee_div(v.cast("double"), w.cast("double")))


def ieee_div(a: F.Column, b: F.Column) -> F.Column:
    """Quotient of doubles that gives an infinity or NaN where the divisor is zero."""
    over_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, over_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))
