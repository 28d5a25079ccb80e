"""Neighbourhood operators: convolution, filters and any function of a cell's surroundings.

Borders act on each axis by itself, so a stencil of d dimensions runs as d
window passes, one per axis, also if its weights don't separate: the pass along
x makes one sum per row of weights, that along y one of those per layer, and so
on.  Each pass costs one shuffle of the cells; that along x none if lines are arrays.

A window's partition is a line of cells, cut into bands of :data:`BAND` cells: a
band also gets copies of the few cells next to it, and the cells that the border
mode puts outside.  So a long axis is as parallel as a short one, and no task
sorts a whole line.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product
from math import floor, prod

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.errors import BorderTooWide, GridError
from gridwright.functions.kernels import Kernel
from gridwright.functions.shapes import Region
from gridwright.operators import tiles
from gridwright.operators.grid import Grid, wide
from gridwright.operators.index_space import subview

BAND = 4096
MANY = 64
"""Weights beyond which a kernel isn't a term for each of them."""
BORDERS = ("repeat", "mirror", "periodic", "zero", "none")


def _images(c: F.Column, n: int, low: int, high: int, border: str) -> list[F.Column]:
    """Arrays of places outside ``0..n-1`` at which the border mode shows cell ``c``."""
    none = F.array().cast("array<bigint>")
    span = lambda a, b: F.sequence(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))
    one = lambda x, here: F.when(here, F.array(x.cast("bigint"))).otherwise(none)
    out = []
    if border == "repeat":
        if low:
            out.append(F.when(c == 0, span(-low, -1)).otherwise(none))
        if high:
            out.append(F.when(c == n - 1, span(n, n - 1 + high)).otherwise(none))
    elif border == "mirror":
        if max(low, high) >= n:
            raise BorderTooWide(f"reach {max(low, high)} on an axis of {n}")
        if low:
            out.append(one(-c, (c >= 1) & (c <= low)))
        if high:
            out.append(one(2 * (n - 1) - c, (c >= n - 1 - high) & (c <= n - 2)))
    elif border == "periodic":
        for k in range(1, (max(low, high) - 1) // n + 2 if max(low, high) else 1):
            out.append(one(c - k * n, c - k * n >= -low))
            out.append(one(c + k * n, c + k * n <= n - 1 + high))
    return out


def _banded(df: DataFrame, axis: str, n: int, low: int, high: int, border: str) -> tuple[DataFrame, int]:
    """Cells with ``_band`` and their place along the axis, repeated where another band or the border needs them."""
    c = F.col(axis)
    images = _images(c, n, low, high, border)
    bands = -(-n // BAND)
    if bands == 1 and not images:
        return df.withColumn("_band", F.lit(0)), 1
    places = F.concat(F.array(c), *images) if images else F.array(c)
    if bands == 1:
        df = df.withColumn(axis, F.explode(places))
        return df.withColumn("_band", F.lit(0)), 1
    edge = lambda x, by: F.least(F.greatest(F.expr(f"({x} {by}) div {BAND}"), F.lit(0)), F.lit(bands - 1))
    df = df.withColumn(axis, F.explode(places))
    # a cell is seen by bands whose cells are up to `high` before it and up to `low` behind it
    first, last = edge(axis, f"- {high}"), edge(axis, f"+ {low}")
    return df.withColumn("_band", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))), bands


def axis_pass(df: DataFrame, dims: Sequence[str], size: Sequence[int], axis: int, low: int, high: int, border: str, makes: Callable[[Callable[[str, int], F.Column]], dict[str, F.Column]]) -> DataFrame:
    """One window pass along an axis.

    ``makes`` gets ``at(column, offset)`` and returns the new columns; offsets
    are within ``-low..high``.
    """
    if border not in BORDERS:
        raise GridError(f"border {border!r}")
    name, n = dims[axis], size[axis]
    if low == high == 0:
        return df.select(*dims, *(c.alias(k) for k, c in makes(lambda col, k: F.col(col)).items()))
    spread, bands = _banded(df, name, n, low, high, border)
    line = [d for d in dims if d != name]
    w = Window.partitionBy(*line, "_band").orderBy(name)

    def at(col: str, k: int) -> F.Column:
        if not k:
            return F.col(col)
        out = F.lead(col, k).over(w) if k > 0 else F.lag(col, -k).over(w)
        if border == "zero":
            inside = (F.col(name) + k >= 0) & (F.col(name) + k < n)
            out = F.when(inside, out).otherwise(F.lit(0).cast(df.schema[col].dataType))
        return out

    made = spread.select(*dims, "_band", *(c.alias(k) for k, c in makes(at).items()))
    kept = made.where((F.col(name) >= 0) & (F.col(name) < n))
    if bands > 1:
        kept = kept.where(F.expr(f"{name} div {BAND}") == F.col("_band"))
    return kept.drop("_band")


def line_pass(g: Grid, low: int, high: int, border: str, makes: Callable[[Callable[[str, int], F.Column]], dict[str, F.Column]]) -> DataFrame:
    """The pass along x of a grid whose lines are arrays: within rows, nothing is shuffled or sorted."""
    n = g.size[0]
    if border not in BORDERS:
        raise GridError(f"border {border!r}")
    if border == "mirror" and max(low, high) >= n:
        raise BorderTooWide(f"reach {max(low, high)} on an axis of {n}")
    whole = F.transform("line", lambda v: v.cast("bigint")) if g.is_whole else F.col("line")

    def cell(i: F.Column) -> F.Column:
        def at(col: str, k: int) -> F.Column:
            c = i + k
            if not k:
                return F.get("_line", c)
            if border == "repeat":
                return F.get("_line", F.greatest(F.least(c, F.lit(n - 1)), F.lit(0)))
            if border == "mirror":
                return F.get("_line", F.when(c < 0, -c).when(c > n - 1, 2 * (n - 1) - c).otherwise(c))
            if border == "periodic":
                return F.get("_line", F.pmod(c, F.lit(n)))
            here = F.get("_line", c)  # null outside
            return F.coalesce(here, F.lit(0)) if border == "zero" else here

        return F.struct(*(v.alias(k) for k, v in makes(at).items()))

    rows = g.lines.select("y", whole.alias("_line")).select("y", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell).alias("_cells"))
    # the outer form: for the inner one a filter of the array's size is inferred, which computes the whole line once for every tap
    return rows.select("y", F.posexplode_outer("_cells").alias("x", "_c")).select(F.col("x").cast("bigint").alias("x"), "y", "_c.*")


def _pass(g: Grid, df: DataFrame, axis: int, low: int, high: int, border: str, makes: Callable) -> DataFrame:
    """The pass along one axis, on lines where there are some."""
    if axis == 0 and g.lines is not None:
        return line_pass(g, low, high, border, makes)
    return axis_pass(df, g.dims, g.size, axis, low, high, border, makes)


def _sum(terms: list[F.Column]) -> F.Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def convolve_all(g: Grid, kernels: Sequence[Kernel], border: str = "repeat") -> list[Grid]:
    """Correlations with several kernels in the same passes; the results share a DataFrame.

    No weight is flipped: ``sum(weight[o] * cell[i + o])``.
    """
    dims = g.dims
    low = [max(0, *(-k.start[d] for k in kernels)) for d in range(len(dims))]
    high = [max(0, *(k.end[d] - 1 for k in kernels)) for d in range(len(dims))]
    df = g.df.select(*dims, wide(g).alias("s"))
    # open sums: by kernel and the offsets along the axes that are still to come
    state: dict[tuple[int, tuple[int, ...]], str] = {}

    def rows(k: Kernel, d: int):
        """Offset tuples along the axes from ``d`` on."""
        yield from product(*(range(a, b) for a, b in zip(k.start[d:], k.end[d:])))

    for d in range(len(dims)):
        step: dict[tuple[int, tuple[int, ...]], list[tuple[str, int, object]]] = {}
        for i, k in enumerate(kernels):
            if d == 0:
                for o in rows(k, 0):
                    if k.at(o):
                        step.setdefault((i, o[1:]), []).append(("s", o[0], k.at(o)))
            else:
                for (j, o), col in state.items():
                    if j == i:
                        step.setdefault((i, o[1:]), []).append((col, o[0], 1))
        names = {key: f"s{d}_{n}" for n, key in enumerate(step)}

        def makes(at, step=step, names=names):
            return {names[key]: _sum([at(c, o) if w == 1 else at(c, o) * F.lit(w) for c, o, w in terms]) for key, terms in step.items()}

        df, state = _pass(g, df, d, low[d], high[d], border, makes), names
    zero = F.lit(0)
    return [Grid(df, g.size, F.col(state[i, ()]) if (i, ()) in state else zero) for i in range(len(kernels))]


def _times(g: Grid, factor: int) -> Grid:
    return g.with_value(g.value * F.lit(factor).cast("bigint"))


def convolve(g: Grid, kernel: Kernel, border: str = "repeat") -> Grid:
    """Correlation with a kernel; one that is a product of lines runs line by line.

    Beyond :data:`MANY` weights constant ones of whole numbers run by prefix sums, and fractions as :func:`dense` has them.
    """
    if border != "none" and kernel.weights.size > MANY:
        w = kernel.weights
        if g.is_whole and (w == w.flat[0]).all() and np.issubdtype(w.dtype, np.integer):
            return _times(boxed(g, kernel.centre, [e - 1 for e in kernel.end], border), w.flat[0].item()) if all(0 <= c < n for c, n in zip(kernel.centre, kernel.size)) else convolve_all(g, [kernel], border)[0]
        if not (g.is_whole and np.issubdtype(w.dtype, np.integer)):
            return dense(g, kernel, border)
    factors = kernel.separated() if border != "none" else None
    if factors and all(len(f) > 1 for f in factors):
        return separable(g, [Kernel(f, (c,)) for f, c in zip(factors, kernel.centre)], border)
    return convolve_all(g, [kernel], border)[0]


def separable(g: Grid, kernels: Sequence[Kernel], border: str = "repeat") -> Grid:
    """One-dimensional kernels along x, y and z in turn."""
    df = g.df.select(*g.dims, wide(g).alias("v"))
    for d, k in enumerate(kernels):
        terms = [(o, k.at((o,))) for o in range(k.start[0], k.end[0]) if k.at((o,))]
        df = _pass(g, df, d, max(0, -k.start[0]), max(0, k.end[0] - 1), border, lambda at, terms=terms: {"v": _sum([at("v", o) if w == 1 else at("v", o) * F.lit(w) for o, w in terms]) if terms else F.lit(0)})
    return Grid(df, g.size)


def neighbourhood(g: Grid, low: Sequence[int], high: Sequence[int], border: str = "repeat") -> Grid:
    """Each cell's surroundings as an array, x fastest, from ``-low`` to ``high``."""
    df = g.df.select(*g.dims, g.value.alias("v"))
    for d, (a, b) in enumerate(zip(low, high)):
        df = _pass(g, df, d, a, b, "repeat" if border == "zero" else border, lambda at, a=a, b=b, d=d: {"v": F.array(*(at("v", o) for o in range(-a, b + 1))) if d == 0 else F.concat(*(at("v", o) for o in range(-a, b + 1)))})
    out = Grid(df, g.size)
    return _zeroed(out, low, high) if border == "zero" else out


def _zeroed(g: Grid, low: Sequence[int], high: Sequence[int]) -> Grid:
    """Entries of surroundings that lie outside of the grid become zero."""
    df = g.df.withColumn("v", F.expr("transform(v, (e, i) -> struct(e as e, i as _i))"))
    texts = []
    stride = 1
    for d, a, b, n in zip(g.dims, low, high, g.size):
        width = a + b + 1
        where = f"({d} + (s._i div {stride}) % {width} - {a})"
        texts.append(f"{where} >= 0 and {where} < {n}")
        stride *= width
    return Grid(df.withColumn("v", F.expr(f"transform(v, s -> if({' and '.join(texts)}, s.e, cast(0 as {g.df.schema['v'].dataType.elementType.simpleString()})))")), g.size)


def transform_locator(g: Grid, low: Sequence[int], high: Sequence[int], f: Callable[[Callable[..., F.Column]], F.Column], border: str = "repeat") -> Grid:
    """``f`` of each cell's locator: ``at(dx[, dy[, dz]])`` is the cell at that offset, between cells by linear interpolation."""
    around = neighbourhood(g, low, high, border)

    def whole(offset: Sequence[int]) -> F.Column:
        i, stride = 0, 1
        for o, a, b in zip(offset, low, high):
            if not -a <= o <= b:
                raise GridError(f"offset {tuple(offset)} is beyond the reach")
            i, stride = i + (o + a) * stride, stride * (a + b + 1)
        return around.value[i]

    def at(*offset: float) -> F.Column:
        if all(o == int(o) for o in offset):
            return whole([int(o) for o in offset])
        ends = [[(floor(o), 1 - (o - floor(o))), (floor(o) + 1, o - floor(o))] for o in offset]
        terms = [(whole([o for o, _ in near]), prod(w for _, w in near)) for near in product(*ends) if all(w for _, w in near)]
        return _sum([c * F.lit(w) for c, w in terms])

    return around.with_value(f(at))


for_each_locator = transform_locator


def filtered(g: Grid, radius: Sequence[int], f: Callable[[F.Column], F.Column], border: str = "repeat") -> Grid:
    """``f`` of the array of surroundings: median, erosion and the like."""
    around = neighbourhood(g, radius, radius, border)
    return around.with_value(f(around.value))


def median(g: Grid, radius: Sequence[int], border: str = "repeat") -> Grid:
    """The middle value (surroundings have an odd count)."""
    widths = [2 * r + 1 for r in radius]
    return tiles.by_tiles(g, radius, radius, lambda block, tile: tiles.sliding_rank(block, widths, prod(widths) // 2), border, cells=tiles.CELLS // 2)


def eroded(g: Grid, radius: Sequence[int], border: str = "repeat") -> Grid:
    """The least value around each cell, at a price that doesn't depend on the radius."""
    return tiles.by_tiles(g, radius, radius, lambda block, tile: tiles.sliding_extreme(block, [2 * r + 1 for r in radius], False), border)


def dilated(g: Grid, radius: Sequence[int], border: str = "repeat") -> Grid:
    """The largest value around each cell."""
    return tiles.by_tiles(g, radius, radius, lambda block, tile: tiles.sliding_extreme(block, [2 * r + 1 for r in radius], True), border)


def boxed(g: Grid, low: Sequence[int], high: Sequence[int], border: str = "repeat") -> Grid:
    """Sums from ``-low`` to ``high`` around each cell, by prefix sums (of fractions they round as sums of a tile do)."""
    return tiles.by_tiles(g, low, high, lambda block, tile: tiles.box_sums(block, [a + b + 1 for a, b in zip(low, high)]), border)


def dense(g: Grid, kernel: Kernel, border: str = "repeat", lines: int = 64) -> Grid:
    """Correlation with many weights, as fractions.

    Weights that are a sum of few products of lines (by their singular values) go
    line by line, up to ``lines`` weights a cell in all; others by the product of
    spectra of each tile and the weights.
    """
    low, high = [max(0, -s) for s in kernel.start], [max(0, e - 1) for e in kernel.end]
    weights = np.asarray(kernel.weights, float)
    terms = kernel.low_rank()

    def f(block: np.ndarray, tile: tiles.Tile) -> np.ndarray:
        # a centre outside of the weights leaves a reach on one side only
        block = block[tuple(slice(a + s, block.shape[-1 - d] - (b + 1 - e)) for d, (a, b, s, e) in enumerate(zip(low, high, kernel.start, kernel.end)))[::-1]]
        if sum(len(w) for term in terms for w in term) <= lines:
            return tiles.correlated(block, terms)
        return tiles.correlated_by_spectrum(block, weights)

    return tiles.by_tiles(g.with_value(g.value.cast("double")), low, high, f, border)


def bordered(g: Grid, region: Region, low: Sequence[int], high: Sequence[int], f: Callable[[Grid], Grid]) -> Grid:
    """A stencil of a region that sees the cells around it: run on the region and its halo, then cropped.

    Neighbours outside of the whole grid follow the border mode at the grid's own edge.
    """
    g.check_inside(region)
    wide_ = region.grown(low, high).clamped(g.size)
    done = f(subview(g, wide_.corner, wide_.size))
    return subview(Grid(done.cells, done.size), tuple(a - b for a, b in zip(region.corner, wide_.corner)), region.size)


def sobel_magnitude(g: Grid, border: str = "repeat") -> Grid:
    """Root of the sum of squared Sobel derivatives."""
    from gridwright.functions.kernels import sobel

    parts = convolve_all(g, [sobel(g.dimension, d) for d in range(g.dimension)], border)
    return parts[0].with_value(F.sqrt(_sum([p.value * p.value for p in parts]).cast("double")))


def edges(g: Grid, border: str = "repeat") -> Grid:
    """Three times the Sobel magnitude, 255 at most, under 50 zero."""
    base = sobel_magnitude(g, border)
    m = F.least(3 * base.value, F.lit(255.0))
    return base.with_value(F.when(m < 50, 0.0).otherwise(m))
