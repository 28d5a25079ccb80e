"""Work on tiles: blocks of a grid as arrays, with the cells around them.

Cells are rows; what looks at many neighbours of each is better off with arrays.
Here a cell goes to its tile, and a copy of it to each tile that needs it in its
margin (the *halo*), in one shuffle whatever is done with it then.  A tile is a
group of bounded size, so no task holds a line or an image.

Tiles of a small grid, and of one that is narrow along an axis, are longer along
the others, so that a tile has about :data:`CELLS` cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.errors import BorderTooWide, GridError
from gridwright.operators.grid import Grid

CELLS = 1 << 16
BORDERS = ("repeat", "mirror", "periodic", "zero", "none")


def tile_size(size: Sequence[int], cells: int = CELLS) -> tuple[int, ...]:
    """Sides of a tile of about ``cells`` cells, none longer than the grid's."""
    out, left = [0] * len(size), cells
    for k, d in enumerate(sorted(range(len(size)), key=lambda d: size[d])):  # short axes first: what they leave goes to the others
        out[d] = max(1, min(size[d], round(left ** (1 / (len(size) - k)))))
        left = max(1, left // out[d])
    return tuple(out)


def places(name: str, n: int, low: int, high: int, border: str) -> F.Column:
    """All places in ``-low..n - 1 + high`` at which the border mode shows the cell at ``name``, its own included."""
    c = F.col(name)
    span = lambda a, b: F.sequence(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))
    own, none = F.array(c), F.array().cast("array<bigint>")
    if border == "repeat":
        before = F.when(c == 0, span(-low, -1)).otherwise(none) if low else none
        behind = F.when(c == n - 1, span(n, n - 1 + high)).otherwise(none) if high else none
        return F.concat(own, before, behind)
    if border == "mirror":
        if max(low, high) >= n:
            raise BorderTooWide(f"reach {max(low, high)} on an axis of {n}")
        twins = F.array(-c, 2 * (n - 1) - c)
        return F.concat(own, F.filter(twins, lambda p: ((p < 0) & (p >= -low)) | ((p >= n) & (p <= n - 1 + high))))
    if border == "periodic":
        turns = F.sequence(F.expr(f"-(({low} + {name}) div {n})"), F.expr(f"({n - 1 + high} - {name}) div {n}"))
        return F.transform(turns, lambda k: c + k * n)
    return own


class Tile:
    """What a function of a tile may ask about it."""

    def __init__(self, origin: Sequence[int], core: Sequence[int], size: Sequence[int], low: Sequence[int], high: Sequence[int]):
        self.origin, self.core, self.size, self.low, self.high = tuple(origin), tuple(core), tuple(size), tuple(low), tuple(high)


def spread(g: Grid, low: Sequence[int], high: Sequence[int], side: Sequence[int], border: str) -> DataFrame:
    """The cells with the numbers of their tiles (``_t`` and the axis), once for every tile that sees them; values as bigints or doubles."""
    df = g.df.select(*g.dims, g.value.cast("bigint" if g.is_whole else "double").alias("v"))
    for d, n, t, a, b in zip(g.dims, g.size, side, low, high):
        last = -(-n // t) - 1
        if a or b:
            df = df.withColumn(d, F.explode_outer(places(d, n, a, b, border)))
        edge = lambda x: F.greatest(F.least(F.expr(x), F.lit(last)), F.lit(0)).cast("bigint")  # noqa: B023, E731
        if not last:
            df = df.withColumn(f"_t{d}", F.lit(0).cast("bigint"))
        elif a or b:
            df = df.withColumn(f"_t{d}", F.explode_outer(F.sequence(edge(f"({d} - {b}) div {t}"), edge(f"({d} + {a}) div {t}"))))
        else:
            df = df.withColumn(f"_t{d}", F.expr(f"{d} div {t}"))
    return df.select(*(f"_t{d}" for d in g.dims), *g.dims, "v")


def filled(table: pa.Table, tile: Tile, dims: Sequence[str]) -> np.ndarray:
    """A tile's cells and halo as an array; what isn't there is zero."""
    v = table.column("v")
    v = v.fill_null(0).to_numpy() if v.null_count else v.to_numpy()
    shape = [c + a + b for c, a, b in zip(tile.core, tile.low, tile.high)]
    place, fits = [], np.ones(len(table), bool)
    for d, o, a, s in zip(dims, tile.origin, tile.low, shape):
        p = table.column(d).to_numpy() - o + a
        fits &= (p >= 0) & (p < s)
        place.append(p)
    block = np.zeros(shape[::-1], v.dtype)
    block[tuple(p[fits] for p in place[::-1])] = v[fits]
    return block


def blocks(g: Grid, low: Sequence[int], high: Sequence[int], side: Sequence[int], count: Sequence[int], border: str) -> DataFrame:
    """``_tile`` (its number, x fastest) and ``_values``: the tiles with their halos, an array of doubles each."""
    dims, size = g.dims, g.size
    schema = pa.schema([("_tile", pa.int64()), ("_values", pa.list_(pa.float64()))])

    def apply(table: pa.Table) -> pa.Table:
        at = [int(table.column(f"_t{d}")[0].as_py()) for d in dims]
        origin = [k * t for k, t in zip(at, side)]
        tile = Tile(origin, [min(t, n - o) for t, n, o in zip(side, size, origin)], size, low, high)
        number = 0
        for k, c in zip(reversed(at), reversed(count)):
            number = number * c + k
        return pa.table([pa.array([number]), pa.array([filled(table, tile, dims).astype(float).reshape(-1)])], schema=schema)

    return spread(g, low, high, side, border).groupBy(*(f"_t{d}" for d in dims)).applyInArrow(apply, "_tile bigint, _values array<double>")


def by_tiles(g: Grid, low: Sequence[int], high: Sequence[int], f: Callable[[np.ndarray, Tile], np.ndarray], border: str = "repeat", kind: str | None = None, cells: int = CELLS) -> Grid:
    """A grid of what ``f`` makes of every tile.

    ``f`` gets a block of the tile and its halo (``low`` cells in front of it and
    ``high`` behind along each axis; the array's last axis is x) and returns the
    tile's own cells.  Whole numbers come as int64, others as float64.  Outside
    of the grid the halo holds what ``border`` shows there, with ``zero`` and
    ``none`` zeros; with ``none``, cells whose surroundings leave the grid are null.
    """
    if border not in BORDERS:
        raise GridError(f"border {border!r}")
    dims, size, low, high = g.dims, g.size, tuple(low), tuple(high)
    side = tile_size(size, cells)
    kind = kind or ("bigint" if g.is_whole else "double")
    out_type = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind]
    schema = pa.schema([*((d, pa.int64()) for d in dims), ("v", out_type)])

    def apply(table: pa.Table) -> pa.Table:
        origin = [int(table.column(f"_t{d}")[0].as_py()) * t for d, t in zip(dims, side)]
        core = [min(t, n - o) for t, n, o in zip(side, size, origin)]
        tile = Tile(origin, core, size, low, high)
        out = np.ascontiguousarray(f(filled(table, tile, dims), tile))
        where = np.indices(core[::-1]).reshape(len(dims), -1)[::-1]
        mask = None
        if border == "none":
            mask = np.zeros(where.shape[1], bool)
            for w, o, n, a, b in zip(where, origin, size, low, high):
                mask |= (w + o < a) | (w + o >= n - b)
        return pa.table([*(pa.array(w + o) for w, o in zip(where, origin)), pa.array(out.reshape(-1), out_type, mask=mask)], schema=schema)

    made = spread(g, low, high, side, border).groupBy(*(f"_t{d}" for d in dims)).applyInArrow(apply, ", ".join([*(f"{d} bigint" for d in dims), f"v {kind}"]))
    return Grid(made, size)


# --- functions of blocks; `axis` counts from x, the array's last ------------------------------------------------------


def _sliding(block: np.ndarray, axis: int, width: int, ufunc: np.ufunc) -> np.ndarray:
    """``ufunc`` (minimum, maximum) of every ``width`` cells in a row along an axis, in two sweeps whatever the width.

    Runs of ``width`` cells are swept from both ends; any window is the end of one run and the beginning of the next.
    """
    a = np.moveaxis(block, -1 - axis, -1)
    n = a.shape[-1]
    pad = -n % width
    if pad:
        a = np.concatenate([a, np.repeat(a[..., -1:], pad, -1)], -1)
    runs = a.reshape(*a.shape[:-1], -1, width)
    ahead = ufunc.accumulate(runs, -1).reshape(a.shape)
    back = ufunc.accumulate(runs[..., ::-1], -1)[..., ::-1].reshape(a.shape)
    out = ufunc(back[..., : n - width + 1], ahead[..., width - 1 : n])
    return np.moveaxis(out, -1, -1 - axis)


def sliding_extreme(block: np.ndarray, widths: Sequence[int], largest: bool) -> np.ndarray:
    """The least or largest cell of every box; NaN counts as the largest number."""
    for axis, width in enumerate(widths):
        if width > 1:
            block = _sliding(block, axis, width, np.maximum if largest else np.fmin)
    return block


def box_sums(block: np.ndarray, widths: Sequence[int]) -> np.ndarray:
    """Sums of all boxes, by prefix sums: two reads for each axis whatever the box."""
    for axis, width in enumerate(widths):
        if width > 1:
            at = block.ndim - 1 - axis
            sums = np.cumsum(block, at)
            zero = np.zeros_like(np.take(sums, [0], at))
            sums = np.concatenate([zero, sums], at)
            n = sums.shape[at]
            block = np.take(sums, range(width, n), at) - np.take(sums, range(n - width), at)
    return block


def sliding_rank(block: np.ndarray, widths: Sequence[int], rank: int) -> np.ndarray:
    """The value of ``rank`` (from 0) among the cells of every box, at a price that doesn't depend on the box.

    The block's cells are numbered in the order of their values and cut into
    about as many bins as a bin has cells.  Prefix sums of each bin's cells count
    what a box holds of the bins up to it, so a search over the bins finds the one
    with the wanted cell; then the bin's few cells are looked at one by one.
    """
    shape = tuple(s - w + 1 for s, w in zip(block.shape, widths[::-1]))
    order = np.argsort(block, axis=None, kind="stable")
    per_bin = max(1, int(np.sqrt(block.size)))
    bins = -(-block.size // per_bin)
    bin_of = np.empty(block.size, np.int32)
    bin_of[order] = np.arange(block.size) // per_bin
    bin_of = bin_of.reshape(block.shape)
    where = [x.reshape(-1) for x in np.indices(shape)]
    n_out = len(where[0])
    # counts of the bins up to each, of every box; searched for the first above `rank`
    low, high = np.zeros(n_out, np.int32), np.full(n_out, bins - 1, np.int32)
    upto = np.empty((bins, n_out), np.int32 if block.size < 1 << 31 else np.int64)
    for b in range(bins):
        upto[b] = box_sums((bin_of <= b).astype(np.int32), widths).reshape(-1)
    every = np.arange(n_out)
    while (low < high).any():
        mid = (low + high) // 2
        more = upto[mid, every] > rank
        high = np.where(more, mid, high)
        low = np.where(more, low, mid + 1)
    left = rank - np.where(low > 0, upto[np.maximum(low - 1, 0), every], 0)
    places = np.unravel_index(order, block.shape)
    out = np.empty(n_out, block.dtype)
    flat = block.reshape(-1)[order]
    by_bin = np.argsort(low, kind="stable")
    ends = np.cumsum(np.bincount(low, minlength=bins))
    for b in range(bins):
        mine = by_bin[(ends[b - 1] if b else 0) : ends[b]]
        if not len(mine):
            continue
        cells = slice(b * per_bin, min((b + 1) * per_bin, block.size))
        held = np.ones((len(mine), cells.stop - cells.start), bool)
        for p, w, at in zip(places, widths[::-1], where):
            off = p[cells][None, :] - at[mine][:, None]
            held &= (off >= 0) & (off < w)
        found = (np.cumsum(held, 1) > left[mine][:, None]).argmax(1)
        out[mine] = flat[cells][found]
    return out.reshape(shape)


def correlated(block: np.ndarray, lines: Sequence[Sequence[np.ndarray]]) -> np.ndarray:
    """Sum over ``lines`` of the correlation with the product of one line of weights for each axis, x first."""
    total = None
    for factors in lines:
        part = block
        for axis, w in enumerate(factors):
            at = part.ndim - 1 - axis
            n = part.shape[at] - len(w) + 1
            moved = np.moveaxis(part, at, -1)
            out = sum(moved[..., k : k + n] * x for k, x in enumerate(w) if x)
            part = np.moveaxis(out if not isinstance(out, int) else np.zeros((*moved.shape[:-1], n), moved.dtype), -1, at)
        total = part if total is None else total + part
    return total


def correlated_by_spectrum(block: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Correlation with dense weights by the product of spectra; what wraps around is cut off."""
    axes = tuple(range(block.ndim))
    shape = [1 << (s - 1).bit_length() for s in block.shape]
    product = np.fft.rfftn(block, shape, axes) * np.conj(np.fft.rfftn(weights, shape, axes))
    out = np.fft.irfftn(product, shape, axes)
    return out[tuple(slice(0, s - w + 1) for s, w in zip(block.shape, weights.shape))]


MODES = {"repeat": {"mode": "edge"}, "mirror": {"mode": "reflect"}, "zero": {"mode": "constant"}, "periodic": {"mode": "constant"}}


class Rounds:
    """A block on its way through rounds that each use up some of its halo.

    A side within the grid loses cells.  A side at the grid's edge gets them anew
    from the border mode, as if the whole grid had gone through the round.
    ``periodic`` halos go around, so they are cells like others.
    """

    def __init__(self, tile: Tile, border: str):
        self.tile, self.mode = tile, MODES[border]
        self.edges = [(o < a, o + c + b > n) if border != "periodic" else (False, False) for o, c, n, a, b in zip(tile.origin, tile.core, tile.size, tile.low, tile.high)]

    def _cut(self, block: np.ndarray, take: list[slice]) -> np.ndarray:
        return block[tuple(take[::-1])]

    def begun(self, block: np.ndarray) -> np.ndarray:
        """The block's cells that are cells of the grid."""
        t = self.tile
        return self._cut(block, [slice(a - o if first else 0, n - o + a if last else None) for o, n, a, (first, last) in zip(t.origin, t.size, t.low, self.edges)])

    def padded(self, block: np.ndarray, low: Sequence[int], high: Sequence[int]) -> np.ndarray:
        """The block with cells beyond the grid's edges."""
        return np.pad(block, [(a if first else 0, b if last else 0) for a, b, (first, last) in zip(low, high, self.edges)][::-1], **self.mode)

    def lessened(self, block: np.ndarray, low: Sequence[int], high: Sequence[int]) -> np.ndarray:
        """The block without the cells that a round has used up."""
        return self._cut(block, [slice(0 if first else a, None if last or not b else -b) for a, b, (first, last) in zip(low, high, self.edges)])

    def ended(self, block: np.ndarray) -> np.ndarray:
        """The tile's own cells, when the halo is used up."""
        return self._cut(block, [slice(o if first else 0, (o if first else 0) + c) for o, c, (first, _) in zip(self.tile.origin, self.tile.core, self.edges)])


def rounds(block: np.ndarray, tile: Tile, step: Callable[[np.ndarray], np.ndarray], times: int, reach: int, border: str) -> np.ndarray:
    """``step`` so many times; each makes an array that lacks ``reach`` cells at every side.  The halo is ``times * reach`` wide."""
    way = Rounds(tile, border)
    block, reaches = way.begun(block), [reach] * block.ndim
    for _ in range(times):
        block = step(way.padded(block, reaches, reaches))
    return way.ended(block)
