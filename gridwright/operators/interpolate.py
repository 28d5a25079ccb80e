"""Values between cells, and geometric transformations built on them.

The source is cut into tiles that carry the cells around them (:mod:`.tiles`), each
a row with its values in one array.  Points are sorted into tiles batch by batch,
and the points of a batch that lie in one tile are a row too.  Both meet in an
equi-join on the tile, and the interpolation is array arithmetic: what is shuffled
is the source and a row of numbers for each point, however many cells a point
reads.  A tile that many points lie in (all outside of the grid under a clamping
border, say) has many rows of bounded size, which a skewed join can split.

Interpolations and borders that are functions of columns go another way: a row for
each cell that a point reads, joined with the cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.errors import GridError
from gridwright.functions.shapes import AXES, coordinate_columns, element_count
from gridwright.operators import tiles
from gridwright.operators.grid import WHOLE, Grid
from gridwright.operators.quaternion import Quaternion

Tap = tuple[F.Column, F.Column]
ALMOST_HALF = 0.499999
"""Nearest neighbour takes ``round(p - ALMOST_HALF)``: a point half way goes down."""


def lerp(a: F.Column, b: F.Column, w: F.Column) -> F.Column:
    return (1 - w) * a + w * b


def nearest_taps(p: F.Column) -> list[Tap]:
    return [(F.ceil(p - ALMOST_HALF - 0.5).cast("bigint"), F.lit(1.0))]


def linear_taps(p: F.Column) -> list[Tap]:
    low = F.floor(p)
    w = p - low
    return [(low.cast("bigint"), 1 - w), ((low + 1).cast("bigint"), w)]


def cubic_taps(p: F.Column) -> list[Tap]:
    """Two linear reads per axis that stand for four Catmull-Rom weights.

    Each outer pair of weights (one of them negative) is folded into one read at
    the pair's weighted mean place, so on impulses the result isn't Catmull-Rom.
    """
    low = F.floor(p)
    t = p - low
    w0 = t * (-0.5 + t * (1.0 - 0.5 * t))
    w1 = 1.0 + t * t * (-2.5 + 1.5 * t)
    w2 = t * (0.5 + t * (2.0 - 1.5 * t))
    w3 = t * t * (-0.5 + 0.5 * t)
    out: list[Tap] = []
    for first, (a, b) in ((-1, (w0, w1)), (1, (w2, w3))):
        both = a + b
        share = F.when(both == 0, 0.0).otherwise(b / F.when(both == 0, 1.0).otherwise(both))
        at = low + first + share
        base = F.floor(at)
        frac = at - base
        out += [(base.cast("bigint"), both * (1 - frac)), ((base + 1).cast("bigint"), both * frac)]
    return out


TAPS: dict[str, Callable[[F.Column], list[Tap]]] = {"nearest": nearest_taps, "linear": linear_taps, "cubic": cubic_taps}


PRESETS = {"nearest_repeat": ("nearest", "repeat"), "linear_repeat": ("linear", "repeat"), "cubic_repeat": ("cubic", "repeat")}
"""Usual pairs of ``how`` and ``border``."""


def border_index(c: F.Column, n: int, border: str | Callable[[F.Column, int], F.Column]) -> F.Column:
    """The cell that a border mode (or a function of place and length) shows at ``c``; null where there is none."""
    if callable(border):
        return border(c, n)
    if border == "repeat":
        return F.least(F.greatest(c, F.lit(0).cast("bigint")), F.lit(n - 1).cast("bigint"))
    if border == "mirror":
        return F.when(c < 0, -c).when(c > n - 1, 2 * (n - 1) - c).otherwise(c)
    if border == "periodic":
        return F.pmod(c, F.lit(n).cast("bigint"))
    if border == "zero":
        return F.when((c >= 0) & (c < n), c)
    raise GridError(f"border {border!r}")


def sampled(g: Grid, points: DataFrame, source: Sequence[F.Column], keys: Sequence[str], how: str = "linear", border: str = "repeat") -> DataFrame:
    """``keys`` of ``points`` and ``v``, the grid's value at the point that ``source`` gives (doubles).

    ``how`` names an interpolation or is a function from a coordinate to its taps.
    """
    if callable(how) or callable(border):
        return _by_taps(g, points, source, keys, how, border)
    if border not in ("repeat", "mirror", "periodic", "zero"):
        raise GridError(f"border {border!r}")
    dims, size, whole = g.dims, g.size, g.is_whole
    side = tiles.tile_size(size, TILE)
    count = [-(-n // t) for n, t in zip(size, side)]
    k, reach = len(keys), REACH[how]
    if border == "mirror":  # beyond an edge cells come in reverse
        reach = (max(reach), max(reach))
    asked = points.select(*keys, *(s.cast("double").alias(f"_p{d}") for s, d in zip(source, dims)))
    named = [asked.schema[c].dataType.simpleString() for c in keys]
    kinds = [*(f"_k{i} array<{x}>" for i, x in enumerate(named)), *(f"_p{d} array<double>" for d in dims)]

    def sorted_into_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tile = np.zeros(b.num_rows, np.int64)
            for d in reversed(range(len(dims))):
                low = np.floor(b.column(k + d).to_numpy())
                at = np.clip(np.nan_to_num(low, nan=-9.0), -1, size[d])
                if border in ("mirror", "periodic"):
                    at = _shown(np.nan_to_num(low).astype(np.int64), size[d], border)
                tile = tile * count[d] + np.clip(at, 0, size[d] - 1).astype(np.int64) // side[d]
            order = np.argsort(tile, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(tile[order]) != 0)) if len(tile) else order
            ends = np.append(heads, len(tile)).astype(np.int32)
            at = pa.array(order)
            lists = [pa.ListArray.from_arrays(pa.array(ends), b.column(i).take(at)) for i in range(k + len(dims))]
            yield pa.RecordBatch.from_arrays([pa.array(tile[order][heads]), *lists], names=["_tile", *(x.split()[0] for x in kinds)])

    asks = asked.mapInArrow(sorted_into_tiles, ", ".join(["_tile bigint", *kinds]))
    blocks = _blocks(g, side, count, reach, border)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                own = [b.column(i)[r].values for i in range(1, 1 + k + len(dims))]
                tile = b.column(0)[r].as_py()
                values = b.column(1 + k + len(dims))[r].values.to_numpy()
                origin = []
                for c, t in zip(count, side):
                    origin.append(tile % c * t)
                    tile //= c
                shape = [min(t, n - o) + reach[0] + reach[1] for t, n, o in zip(side, size, origin)]
                out = _read(values.reshape(shape[::-1]), [p.to_numpy() for p in own[k:]], origin, size, reach, how, border)
                if whole:
                    out = np.where(out >= 0, np.floor(out + 1e-9), np.ceil(out - 1e-9)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*own[:k], pa.array(out)], names=[*(f"_k{i}" for i in range(k)), "v"])

    both = asks.join(blocks, "_tile").select("_tile", *(x.split()[0] for x in kinds), "_values")
    out = both.mapInArrow(read, ", ".join([*(f"_k{i} {x}" for i, x in enumerate(named)), f"v {'bigint' if whole else 'double'}"]))
    return out.toDF(*keys, "v")


TILE = 1 << 14
"""Cells of a source tile."""
REACH = {"nearest": (0, 1), "linear": (0, 1), "cubic": (1, 3)}
"""Cells that a point may read in front of and behind the one it lies in."""


def _shown(c: np.ndarray, n: int, border: str) -> np.ndarray:
    """The cell that a border mode shows at ``c``; -1 if none."""
    if border == "repeat":
        return np.clip(c, 0, n - 1)
    if border == "mirror":
        return np.where(c < 0, -c, np.where(c > n - 1, 2 * (n - 1) - c, c))
    if border == "periodic":
        return c % n
    return np.where((c >= 0) & (c < n), c, -1)


def _blocks(g: Grid, side: Sequence[int], count: Sequence[int], reach: tuple[int, int], border: str) -> DataFrame:
    """``_tile`` and ``_values``: each tile with the cells around it, in one array (x fastest)."""
    low, high = [reach[0]] * g.dimension, [reach[1]] * g.dimension
    # halos hold cells of the grid only, so that `mirror` reads what lies beyond an edge from the same tile; around a periodic grid they go on
    return tiles.blocks(g, low, high, side, count, "periodic" if border == "periodic" else "zero")


def _taps(p: np.ndarray, how: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells that a coordinate reads, with their weights; as :data:`TAPS` has them."""
    if how == "nearest":
        return [(np.ceil(p - ALMOST_HALF - 0.5).astype(np.int64), np.ones(len(p)))]
    low = np.floor(p)
    t = p - low
    if how == "linear":
        return [(low.astype(np.int64), 1 - t), (low.astype(np.int64) + 1, t)]
    w = [t * (-0.5 + t * (1.0 - 0.5 * t)), 1.0 + t * t * (-2.5 + 1.5 * t), t * (0.5 + t * (2.0 - 1.5 * t)), t * t * (-0.5 + 0.5 * t)]
    out = []
    for first, a, b in ((-1, w[0], w[1]), (1, w[2], w[3])):
        both = a + b
        at = low + first + np.divide(b, both, out=np.zeros(len(p)), where=both != 0)
        base = np.floor(at)
        out += [(base.astype(np.int64), both * (1 - (at - base))), (base.astype(np.int64) + 1, both * (at - base))]
    return out


def _read(block: np.ndarray, points: list[np.ndarray], origin: Sequence[int], size: Sequence[int], reach: tuple[int, int], how: str, border: str) -> np.ndarray:
    """Values of a tile with its halo at points that lie in it."""
    axes = []
    for d, (p, o, n) in enumerate(zip(points, origin, size)):
        own = []
        for c, w in _taps(p, how):
            at = _shown(c, n, border)
            place = at - o + reach[0]
            if border == "periodic":  # around the grid's end the halo goes on
                place = np.where(place < 0, place + n, place)
                place = np.where(place >= block.shape[-1 - d], place - n, place)
            known = (at >= 0) & (at < n)
            fits = known & (place >= 0) & (place < block.shape[-1 - d])
            if ((w != 0) & known & ~fits).any():
                raise GridError("a point reads beyond its tile")
            own.append((np.where(fits, place, 0), np.where(fits, w, 0.0)))
        axes.append(own)
    total = np.zeros(len(points[0]))
    for taps in product(*axes):
        weight = taps[0][1]
        for _, w in taps[1:]:
            weight = weight * w
        v = block[tuple(p for p, _ in reversed(taps))]
        total += np.where(weight != 0, v, 0.0) * weight
    return total


def _by_taps(g: Grid, points: DataFrame, source: Sequence[F.Column], keys: Sequence[str], how, border) -> DataFrame:
    """The same with a row for each cell that a point reads, for taps and borders that are functions of columns."""
    spread = points.select(*keys, *(s.cast("double").alias(f"_p{d}") for s, d in zip(source, g.dims)), F.lit(1.0).alias("_w"))
    for d, n in zip(g.dims, g.size):  # one axis after the other: taps multiply as rows, not as expressions
        taps = F.array(*(F.struct(border_index(c, n, border).alias("c"), w.alias("w")) for c, w in (how if callable(how) else TAPS[how])(F.col(f"_p{d}"))))
        spread = spread.withColumn("_t", F.explode(taps)).withColumn(f"_{d}", F.col("_t.c")).withColumn("_w", F.col("_w") * F.col("_t.w")).drop("_t", f"_p{d}")
        if how != "nearest":
            spread = spread.where("_w <> 0")
    cells = g.df.select(*(F.col(d).alias(f"_{d}") for d in g.dims), g.value.alias("_v"))
    on = [f"_{d}" for d in g.dims]
    # taps outside still need a row for their target
    inside = spread.join(cells, on, "left" if border == "zero" or callable(border) else "inner")
    whole = isinstance(g.kind, WHOLE)
    v = F.sum(F.coalesce(F.col("_v").cast("double"), F.lit(0.0)) * F.col("_w"))
    return inside.groupBy(*keys).agg((F.expr("cast(0 as bigint)") + F.when(v >= 0, F.floor(v + 1e-9)).otherwise(F.ceil(v - 1e-9)) if whole else v).alias("v"))


def in_tiles(spark: SparkSession, size: Sequence[int]) -> DataFrame:
    """All places of a grid, tile after tile, so that those that come together are near each other."""
    side = tiles.tile_size(size, 1 << 12)
    count = [-(-n // t) for n, t in zip(size, side)]
    rows = spark.range(element_count(count) * element_count(side)).select(F.expr(f"id div {element_count(side)}").alias("_tile"), (F.col("id") % element_count(side)).alias("_cell"))
    at = [(a * t + b).alias(d) for a, b, t, d in zip(coordinate_columns("_tile", count), coordinate_columns("_cell", side), side, AXES)]
    rows = rows.select(*at)
    for d, n, t in zip(AXES, size, side):
        rows = rows.where(F.col(d) < n) if n % t else rows
    return rows


def resampled(g: Grid, size: Sequence[int], source: Callable[[Sequence[F.Column]], Sequence[F.Column]], how: str = "linear", border: str = "repeat") -> Grid:
    """A grid of ``size`` whose cells read the source at ``source(coordinates)``."""
    spark: SparkSession = g.df.sparkSession
    size = tuple(size)
    targets = in_tiles(spark, size)
    points = source([F.col(d).cast("double") for d in AXES[: len(size)]])
    return Grid(sampled(g, targets, points, AXES[: len(size)], how, border), size)


def geometry_transformation(g: Grid, size: Sequence[int], inverse: Callable[[Sequence[F.Column]], Sequence[F.Column]], how: str = "linear", border: str = "repeat", centred: bool = False) -> Grid:
    """Each target reads the source at the inverse of its index plus one half.

    ``centred`` takes the half off again, so the identity leaves a grid as it is.
    """
    half = lambda at: inverse([a + 0.5 for a in at])
    source = (lambda at: [s - 0.5 for s in half(at)]) if centred else half
    return resampled(g, size, source, how, border)


def inverse_scaling(anchor: Sequence[float], factor: Sequence[float]) -> Callable:
    return lambda at: [F.lit(float(o)) + (a - F.lit(float(o))) / F.lit(float(f)) for a, o, f in zip(at, anchor, factor)]


def scaled(g: Grid, factor: Sequence[float], size: Sequence[int] | None = None, anchor: Sequence[float] | None = None, how: str = "linear", border: str = "repeat", centred: bool = False) -> Grid:
    """The grid scaled about an anchor (the origin by default)."""
    return geometry_transformation(g, size or g.size, inverse_scaling(anchor or [0.0] * g.dimension, factor), how, border, centred)


def rotated(g: Grid, rotation: Quaternion, centre: Sequence[float], size: Sequence[int] | None = None, border: str = "zero") -> Grid:
    """A volume turned about a point: every target reads the source at the inverse rotation, half cells compensated."""
    m = rotation.normalized().inverted().matrix()

    def source(at):
        p = [a + 0.5 - F.lit(float(c)) for a, c in zip(at, centre)]
        return [sum((p[j] * m[i][j] for j in range(1, 3)), p[0] * m[i][0]) + F.lit(float(centre[i])) - 0.5 for i in range(3)]

    return resampled(g, size or g.size, lambda at: [_snapped(s) for s in source(at)], "linear", border)


def _snapped(c: F.Column) -> F.Column:
    """Whole numbers that rounding missed by less than 1e-9."""
    return F.when(F.abs(c - F.rint(c)) < 1e-9, F.rint(c)).otherwise(c)


def texture(g: Grid, size: Sequence[int], source: Callable[[Sequence[F.Column]], Sequence[F.Column]]) -> Grid:
    """Reads as texture hardware makes them: linear for fractions, nearest for whole numbers, zero outside."""
    return resampled(g, size, source, "nearest" if g.is_whole else "linear", "zero")


def rotation_about(axis: Sequence[float], angle: float) -> Quaternion:
    return Quaternion.rotation(angle, axis)


def degrees(x: float) -> float:
    return x * math.pi / 180
