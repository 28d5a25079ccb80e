"""Ray casting: colours and opacities of a volume blended front to back along rays.

What a stretch of a ray shows is its colour and the light that it lets through, and
two stretches in a row make such a pair again.  So a ray is blended band by band of
:data:`BAND` samples, then the bands, level by level; no group holds a whole ray.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.kernels import Kernel
from gridwright.operators.grid import Grid
from gridwright.operators.interpolate import in_tiles, sampled
from gridwright.operators.stencil import convolve_all

Transfer = Callable[[F.Column], tuple[F.Column, F.Column]]


def table_transfer(colours: Sequence[float], opacities: Sequence[float], low: float, high: float) -> Transfer:
    """A transfer function from a table: values ``low``..``high`` spread over its entries."""

    def look(v: F.Column) -> tuple[F.Column, F.Column]:
        c, a = (F.array(*(F.lit(float(x)) for x in t)) for t in (colours, opacities))
        at = F.least(F.greatest(F.floor((v - low) / (high - low) * len(colours)), F.lit(0)), F.lit(len(colours) - 1)).cast("int")
        return F.get(c, at), F.get(a, at)

    return look


def shaded(g: Grid, transfer: Transfer, light: Sequence[float] = (0.0, 0.0, -1.0), ambient: float = 0.3, shine: float = 0.2, exponent: int = 8) -> Grid:
    """``struct<c, a>`` of every cell: Blinn-Phong by the volume's gradient, viewed along z."""
    lines = [Kernel.of([[[-0.5, 0.0, 0.5]]]), Kernel.of([[[-0.5], [0.0], [0.5]]]), Kernel.of([[[-0.5]], [[0.0]], [[0.5]]])]
    own = Kernel.of([[[1.0]]])
    x, y, z, v = convolve_all(g.with_value(g.value.cast("double")), [*lines, own])
    norm = F.sqrt(x.value * x.value + y.value * y.value + z.value * z.value)
    safe = F.when(norm < 1e-9, 1.0).otherwise(norm)
    n = [p.value / safe for p in (x, y, z)]
    half = [light[0], light[1], light[2] - 1.0]
    size = sum(h * h for h in half) ** 0.5
    toward = lambda d: F.greatest(sum((p * q for p, q in zip(n[1:], d[1:])), n[0] * d[0]), F.lit(0.0))
    colour, opacity = transfer(v.value)
    bright = colour * (ambient + (1 - ambient) * toward(light)) + shine * F.pow(toward([h / size for h in half]), F.lit(float(exponent)))
    return v.with_value(F.struct(bright.alias("c"), opacity.alias("a")))


BAND = 64


def blended(samples: DataFrame, keys: Sequence[str], at: str, count: int, channels: Sequence[str], opacity: str = "a") -> DataFrame:
    """``keys``, ``channels`` and ``left``, the light that gets through, of samples numbered ``at`` (below ``count``) along each ray."""
    df = samples.select(*keys, F.col(at).cast("bigint").alias("_at"), *((F.col(opacity) * F.col(c)).alias(c) for c in channels), (1 - F.col(opacity)).alias("left"))
    parts = [*channels, "left"]
    start = F.struct(*(F.lit(0.0).alias(c) for c in channels), F.lit(1.0).alias("left"))

    def joined(front: F.Column, back: F.Column) -> F.Column:
        return F.struct(*((front[c] + front["left"] * back[c]).alias(c) for c in channels), (front["left"] * back["left"]).alias("left"))

    while True:
        df = df.withColumn("_band", F.expr(f"_at div {BAND}"))
        bands = df.groupBy(*keys, "_band").agg(F.array_sort(F.collect_list(F.struct("_at", *(F.col(c).cast("double").alias(c) for c in parts)))).alias("_line"))
        df = bands.select(*keys, F.col("_band").alias("_at"), F.aggregate("_line", start, joined).alias("_sum")).select(*keys, "_at", "_sum.*")
        count = -(-count // BAND)
        if count <= 1:
            return df.drop("_at")


def composited(g: Grid) -> Grid:
    """Pixels ``v`` of a volume of ``struct<c, a>``: rays run along z, the nearest cell first."""
    rays = blended(g.settled().df.select(*g.dims, "v.c", "v.a"), ["x", "y"], "z", g.size[2], ["c"])
    return Grid(rays.select("x", "y", F.col("c").alias("v")), g.size[:2])


@dataclass(frozen=True)
class Camera:
    """Pixels in space: ``corner`` is that of (0, 0), the next ones are ``across`` and ``down`` from it.

    Rays go along ``direction``, or away from ``eye`` if there is one.  Space is
    that of the volume's cells, whose centres are at whole numbers.
    """

    corner: Sequence[float]
    across: Sequence[float]
    down: Sequence[float]
    direction: Sequence[float] | None = None
    eye: Sequence[float] | None = None

    def ray(self, x: F.Column, y: F.Column) -> tuple[list[F.Column], list[F.Column]]:
        """Where a pixel's ray begins, and its direction of length one."""
        start = [F.lit(float(c)) + x * F.lit(float(a)) + y * F.lit(float(b)) for c, a, b in zip(self.corner, self.across, self.down)]
        if self.eye is None:
            size = sum(d * d for d in self.direction) ** 0.5
            return start, [F.lit(d / size) for d in self.direction]
        away = [s - F.lit(float(e)) for s, e in zip(start, self.eye)]
        size = F.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2])
        return start, [a / size for a in away]


def viewed(g: Grid, camera: Camera, size: Sequence[int], steps: int, step: float, transfer: Callable[[F.Column], tuple[Sequence[F.Column], F.Column]], how: str = "linear") -> DataFrame:
    """``x, y``, the channels ``c0, c1, ...`` and ``left`` of an image of ``size``: each ray in ``steps`` samples, ``step`` apart.

    ``transfer`` gives a value's channels and opacity.  Samples outside of the
    volume let all light through; so a ray that misses it is dark, with ``left`` 1.
    """
    points = in_tiles(g.df.sparkSession, (*size, steps))
    start, direction = camera.ray(F.col("x").cast("double"), F.col("y").cast("double"))
    at = [f"_q{d}" for d in g.dims]
    points = points.select("x", "y", "z", *((s + F.col("z") * F.lit(float(step)) * d).alias(n) for s, d, n in zip(start, direction, at)))
    for n, s in zip(at, g.size):
        points = points.where((F.col(n) >= 0) & (F.col(n) <= s - 1))
    values = sampled(g.with_value(g.value.cast("double")), points, [F.col(n) for n in at], ["x", "y", "z"], how)
    channels, opacity = transfer(F.col("v"))
    names = [f"c{i}" for i in range(len(channels))]
    seen = blended(values.select("x", "y", "z", *(c.alias(n) for c, n in zip(channels, names)), opacity.alias("a")), ["x", "y"], "z", steps, names)
    all_ = in_tiles(g.df.sparkSession, size).join(seen, ["x", "y"], "left")
    return all_.select("x", "y", *(F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names), F.coalesce(F.col("left"), F.lit(1.0)).alias("left"))


def ray_cast(g: Grid, transfer: Transfer, **shading) -> Grid:
    """A volume seen along z (another side: :func:`viewed`)."""
    return composited(shaded(g, transfer, **shading))
