"""Quaternions ``w + xi + yj + zk`` on the driver, and rotation of columns by them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F

from gridwright.errors import GridError


@dataclass(frozen=True)
class Quaternion:
    w: float
    x: float
    y: float
    z: float

    def __mul__(self, o: Quaternion) -> Quaternion:
        return Quaternion(
            self.w * o.w - self.x * o.x - self.y * o.y - self.z * o.z,
            self.w * o.x + self.x * o.w + self.y * o.z - self.z * o.y,
            self.w * o.y - self.x * o.z + self.y * o.w + self.z * o.x,
            self.w * o.z + self.x * o.y - self.y * o.x + self.z * o.w,
        )

    @property
    def squared(self) -> float:
        return self.w**2 + self.x**2 + self.y**2 + self.z**2

    def conjugate(self) -> Quaternion:
        return Quaternion(self.w, -self.x, -self.y, -self.z)

    def inverted(self) -> Quaternion:
        n = self.squared
        return Quaternion(self.w / n, -self.x / n, -self.y / n, -self.z / n)

    def normalized(self) -> Quaternion:
        n = math.sqrt(self.squared)
        return Quaternion(self.w / n, self.x / n, self.y / n, self.z / n)

    def rotate(self, v: Sequence[float]) -> tuple[float, float, float]:
        """``q v q*``; also stretches if ``q`` isn't a unit."""
        r = self * Quaternion(0.0, *v) * self.conjugate()
        return r.x, r.y, r.z

    def matrix(self) -> list[list[float]]:
        """Rows of the rotation matrix."""
        columns = [self.rotate(e) for e in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
        return [[columns[j][i] for j in range(3)] for i in range(3)]

    @staticmethod
    def rotation(angle: float, axis: Sequence[float]) -> Quaternion:
        n = math.sqrt(sum(a * a for a in axis))
        s = math.sin(angle / 2) / n
        return Quaternion(math.cos(angle / 2), *(a * s for a in axis))

    @staticmethod
    def between(a: Sequence[float], b: Sequence[float]) -> Quaternion:
        """The shortest rotation from ``a`` to ``b``; opposite vectors have none."""
        na, nb = (math.sqrt(sum(c * c for c in v)) for v in (a, b))
        a, b = [c / na for c in a], [c / nb for c in b]
        w = 1 + sum(p * q for p, q in zip(a, b))
        if w < 1e-12:
            raise GridError("opposite vectors have no shortest rotation")
        return Quaternion(w, a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]).normalized()

    @staticmethod
    def euler_zxz(a: float, b: float, c: float) -> Quaternion:
        return Quaternion.rotation(a, (0, 0, 1)) * Quaternion.rotation(b, (1, 0, 0)) * Quaternion.rotation(c, (0, 0, 1))

    @staticmethod
    def euler_zyz(a: float, b: float, c: float) -> Quaternion:
        return Quaternion.rotation(a, (0, 0, 1)) * Quaternion.rotation(b, (0, 1, 0)) * Quaternion.rotation(c, (0, 0, 1))

    @staticmethod
    def hopf(theta: float, phi: float, psi: float) -> Quaternion:
        """From Hopf coordinates: tilt, azimuth and turn."""
        tilt, turn = theta / 2, psi / 2
        return Quaternion(math.cos(tilt) * math.cos(turn), math.cos(tilt) * math.sin(turn), math.sin(tilt) * math.cos(phi + turn), math.sin(tilt) * math.sin(phi + turn))


def rotate_columns(q: Quaternion, v: Sequence[F.Column]) -> list[F.Column]:
    """Three columns rotated by a constant quaternion."""
    m = q.matrix()
    return [v[0] * m[i][0] + v[1] * m[i][1] + v[2] * m[i][2] for i in range(3)]


def product_columns(a: F.Column, b: F.Column) -> F.Column:
    """Product of ``struct<w, x, y, z>`` columns."""
    w, x, y, z = (lambda q: [q[k] for k in "wxyz"])(a)
    p, q, r, s = (lambda q: [q[k] for k in "wxyz"])(b)
    return F.struct((w * p - x * q - y * r - z * s).alias("w"), (w * q + x * p + y * s - z * r).alias("x"), (w * r - x * s + y * p + z * q).alias("y"), (w * s + x * r - y * q + z * p).alias("z"))


def column(w: F.Column, x: F.Column, y: F.Column, z: F.Column) -> F.Column:
    """A quaternion column."""
    return F.struct(*(c.cast("double").alias(k) for c, k in zip((w, x, y, z), "wxyz")))


def conjugate_column(q: F.Column) -> F.Column:
    return column(q["w"], -q["x"], -q["y"], -q["z"])


def once(value: F.Column, f: Callable[[F.Column], F.Column]) -> F.Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def inverse_column(q: F.Column) -> F.Column:
    """The inverse; null of zero, which has none."""

    def over(s: F.Column) -> F.Column:
        q, n = s["q"], s["n"]
        return F.when(n > 0, column(*(c / F.when(n > 0, n) for c in (q["w"], -q["x"], -q["y"], -q["z"]))))

    squared = once(q, lambda q: F.struct(q.alias("q"), (q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"]).alias("n")))
    return once(squared, over)


def between_columns(a: Sequence[F.Column], b: Sequence[F.Column]) -> F.Column:
    """The shortest rotation from three columns to three others; null of opposite and zero vectors, which have none."""
    dot = lambda v, w: v[0] * w[0] + v[1] * w[1] + v[2] * w[2]
    cross = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    parts = F.struct(*(c.alias(k) for c, k in zip(cross, "xyz")), dot(a, b).alias("dot"), F.sqrt(dot(a, a) * dot(b, b)).alias("both"))

    def unit(q: F.Column) -> F.Column:
        size = F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
        return once(F.when(size > 0, size), lambda n: column(*(q[k] / n for k in "wxyz")))

    def whole(p: F.Column) -> F.Column:
        w = p["dot"] + p["both"]
        return F.when(w > 1e-12 * p["both"], once(column(w, p["x"], p["y"], p["z"]), unit))

    return once(parts, whole)


def rotated_by_column(q: F.Column, v: Sequence[F.Column]) -> F.Column:
    """``struct<x, y, z>`` of three columns rotated by a quaternion column, of any length."""
    vector = column(F.lit(0.0), *v)
    pair = F.struct(q.alias("q"), inverse_column(q).alias("back"))
    turned = once(pair, lambda s: once(product_columns(s["q"], vector), lambda p: product_columns(p, s["back"])))
    return once(turned, lambda t: F.struct(*(t[k].alias(k) for k in "xyz")))
