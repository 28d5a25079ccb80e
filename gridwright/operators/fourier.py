"""Discrete Fourier transforms along axes of any length.

Each axis is a pass: cells are gathered into lines along it (a shuffle by the
other coordinates; none along x where lines are arrays already), lines go through
numpy in Arrow batches, and become cells again.  No line is longer than
:data:`LONG_LINE` cells.  A longer axis of ``p * q`` cells is a table of ``p``
columns and ``q`` rows: lines along its columns, a twist, lines along its rows;
so both passes have many short lines for every line of the grid, and a factor
that is still too long is split again.  An axis with a prime factor that is too
long becomes a convolution with a chirp (Bluestein), whose transforms have a
power of two for their length.

Transforms aren't scaled in either direction; the ``normalized`` forms multiply
by one over the number of cells.  Of real input the first transformed axis keeps
``n // 2 + 1`` frequencies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import pi, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators import complexes
from gridwright.operators.combine import cross_power_spectrum, multiply
from gridwright.operators.grid import Grid


def spectrum_size(size: Sequence[int], stack: Sequence[int] = ()) -> tuple[int, ...]:
    """The size of a real grid's transform; stacked axes are left alone."""
    first = next(d for d in range(len(size)) if d not in stack)
    return tuple(s // 2 + 1 if d == first else s for d, s in enumerate(size))


def estimated_bytes(size: Sequence[int], stack: Sequence[int] = ()) -> int:
    """Input and transform of one stack slice in doubles."""
    one = [s for d, s in enumerate(size) if d not in stack]
    return 8 * prod(one) + 16 * prod(spectrum_size(one))


LONG_LINE = 4096
"""Cells of the longest line that is gathered; longer axes are split."""


def _lines(df: DataFrame, keys: Sequence[str], axis: str, took: int, length: int, f, ready: DataFrame | None = None) -> DataFrame:
    """Lines of ``took`` cells along ``axis`` through ``f`` (rows of complex values to rows of ``length``); cells that aren't there are zero.

    ``ready``: the lines, with arrays ``i`` (places), ``re`` and ``im``, where they needn't be gathered.
    """
    lines = ready
    if lines is None:
        cell = F.struct(F.col(axis).cast("int").alias("i"), F.col("v")["re"].alias("re"), F.col("v")["im"].alias("im"))
        lines = df.groupBy(*keys).agg(F.collect_list(cell).alias("line")).select(*keys, F.col("line.i").alias("i"), F.col("line.re").alias("re"), F.col("line.im").alias("im"))
    schema = pa.schema([*((d, pa.int64()) for d in keys), (axis, pa.int64()), ("re", pa.float64()), ("im", pa.float64())])
    k = len(keys)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, max(1, CELLS // max(took, length))):
                part = b.slice(at, max(1, CELLS // max(took, length)))
                row = np.repeat(np.arange(part.num_rows), part.column(k).value_lengths().to_numpy(zero_copy_only=False))
                i, re, im = (part.column(k + c).flatten().to_numpy() for c in range(3))
                block = np.zeros((part.num_rows, took), complex)
                block[row, i] = re + 1j * im
                out = f(block)
                places = np.tile(np.arange(length), part.num_rows)
                own = [part.column(c).take(pa.array(np.repeat(np.arange(part.num_rows), length))) for c in range(k)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(places), pa.array(out.real.reshape(-1)), pa.array(out.imag.reshape(-1))], schema=schema)

    out = lines.mapInArrow(apply, ", ".join([*(f"{d} bigint" for d in (*keys, axis)), "re double", "im double"]))
    return out.select(*keys, axis, complexes.make(F.col("re"), F.col("im")).alias("v"))


CELLS = 1 << 18
"""Cells of the lines that are transformed at once."""


def _primes(n: int) -> list[int]:
    """Prime factors, ascending."""
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] * (n > 1)


def _part(n: int) -> int | None:
    """The largest divisor of ``n`` that a line may have, or None if a prime factor is longer."""
    divisors = {1}
    for p in _primes(n):
        if p > LONG_LINE:
            return None
        divisors |= {d * p for d in divisors if d * p <= LONG_LINE}
    return max(divisors)


def _along(df: DataFrame, keys: Sequence[str], axis: str, n: int, turn: int) -> DataFrame:
    """The transform of complex lines of any length along ``axis``; ``turn``: -1 forward, 1 back (not scaled)."""
    if n <= LONG_LINE:
        line = (lambda a: np.fft.fft(a, axis=1)) if turn < 0 else (lambda a: np.fft.ifft(a, axis=1, norm="forward"))
        return _lines(df, keys, axis, n, n, line)
    p = _part(n)
    if p is None:
        return _chirped(df, keys, axis, n, turn)
    return _split(df, keys, axis, n, p, turn)


def _split(df: DataFrame, keys: Sequence[str], axis: str, n: int, p: int, turn: int) -> DataFrame:
    """By lines along the columns and rows of a table, a shuffle each: cell ``a + p * b`` is at column ``a`` and row ``b``."""
    q = n // p
    a, b = f"{axis}_a", f"{axis}_b"
    table = df.select(*keys, (F.col(axis) % p).alias(a), F.expr(f"{axis} div {p}").alias(b), "v")
    table = _along(table, [*keys, a], b, q, turn)
    angle = F.lit(turn * 2 * pi / n) * F.col(a) * F.col(b)
    twisted = complexes.product(F.col("v"), complexes.make(F.cos(angle), F.sin(angle)))
    table = _along(table.select(*keys, a, b, twisted.alias("v")), [*keys, b], a, p, turn)
    return table.select(*keys, (F.col(b) + q * F.col(a)).alias(axis), "v")


def _chirped(df: DataFrame, keys: Sequence[str], axis: str, n: int, turn: int) -> DataFrame:
    """As a convolution: with ``w(j)`` for ``exp(turn * i * pi * j^2 / n)``, the sum over ``j`` of ``v(j) w(j) / w(k - j)``, times ``w(k)``."""
    m = 1 << (2 * n - 2).bit_length()
    x = F.col(axis)

    def chirp(sign: int, j: F.Column) -> F.Column:
        angle = F.lit(sign * pi / n) * F.pmod(j * j, F.lit(2 * n).cast("bigint"))  # whole numbers as long as they can be
        return complexes.make(F.cos(angle), F.sin(angle))

    held = df.select(*keys, axis, complexes.product(F.col("v"), chirp(turn, x)).alias("v"))
    near = F.least(x, F.lit(m).cast("bigint") - x)
    wave = df.sparkSession.range(m).select(F.col("id").alias(axis)).where((x < n) | (x > m - n)).select(axis, chirp(-turn, near).alias("v"))
    one, two = _along(held, keys, axis, m, -1), _along(wave, [], axis, m, -1).select(axis, F.col("v").alias("w"))
    both = one.join(two, axis).select(*keys, axis, complexes.product(F.col("v"), F.col("w")).alias("v"))
    back = _along(both, keys, axis, m, 1).where(x < n)
    return back.select(*keys, axis, complexes.scaled(complexes.product(F.col("v"), chirp(turn, x)), F.lit(1.0 / m)).alias("v"))


def _on(g: Grid, axis: int, length: int, f: Callable[[DataFrame, list[str], str], DataFrame]) -> Grid:
    """The grid with one axis through ``f``, of ``length`` then."""
    df = f(g.settled().df, [d for i, d in enumerate(g.dims) if i != axis], g.dims[axis])
    return Grid(df.select(*(F.col(d).cast("bigint").alias(d) for d in g.dims), "v"), [length if i == axis else s for i, s in enumerate(g.size)])


def forward(g: Grid, stack: Sequence[int] = ()) -> Grid:
    """Real to complex."""
    axes = [d for d in range(g.dimension) if d not in stack]
    out = g.with_value(complexes.make(g.value, F.lit(0.0)))
    whole = None
    if g.lines is not None and axes[0] == 0:  # a row has its whole line along x: nothing to gather
        places = F.sequence(F.lit(0), F.lit(g.size[0] - 1))
        whole = g.lines.select("y", places.alias("i"), F.transform("line", lambda v: v.cast("double")).alias("re"), F.transform("line", lambda v: F.lit(0.0)).alias("im"))
    for i, d in enumerate(axes):
        n = out.size[d]
        if i:
            out = _on(out, d, n, lambda df, keys, axis, n=n: _along(df, keys, axis, n, -1))
        elif n > LONG_LINE:
            out = _on(out, d, n // 2 + 1, lambda df, keys, axis, n=n: _along(df, keys, axis, n, -1).where(F.col(axis) <= n // 2))
        else:
            out = _on(out, d, n // 2 + 1, lambda df, keys, axis, n=n: _lines(df, keys, axis, n, n // 2 + 1, lambda a: np.fft.rfft(a.real, axis=1), whole))
    return out


def inverse(g: Grid, width: int, stack: Sequence[int] = ()) -> Grid:
    """Complex to real, of a signal ``width`` wide along the halved axis."""
    axes = [d for d in range(g.dimension) if d not in stack]
    out = g
    for d in reversed(axes[1:]):
        out = _on(out, d, out.size[d], lambda df, keys, axis, n=out.size[d]: _along(df, keys, axis, n, 1))
    half = width // 2 + 1

    def last(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
        if width <= LONG_LINE:
            return _lines(df, keys, axis, half, width, lambda a: np.fft.irfft(a, width, axis=1, norm="forward").astype(complex))
        x = F.col(axis)
        rest = df.where((x > 0) & (x < (width + 1) // 2)).select(*keys, (width - x).alias(axis), complexes.conjugate(F.col("v")).alias("v"))
        return _along(df.select(*keys, axis, complexes.make(F.col("v.re"), F.col("v.im")).alias("v")).unionByName(rest), keys, axis, width, 1)

    out = _on(out, axes[0], width, last)
    return out.with_value(complexes.re(out.value))


def _count(size: Sequence[int], stack: Sequence[int]) -> int:
    return prod(s for d, s in enumerate(size) if d not in stack)


def forward_normalized(g: Grid, stack: Sequence[int] = ()) -> Grid:
    out = forward(g, stack)
    return out.with_value(complexes.scaled(out.value, F.lit(1.0 / _count(g.size, stack))))


def inverse_normalized(g: Grid, width: int, stack: Sequence[int] = ()) -> Grid:
    out = inverse(g, width, stack)
    return out.with_value(out.value / float(_count(out.size, stack)))


def phase_correlation(a: Grid, b: Grid) -> Grid:
    """Inverse transform of the cross power spectrum of scaled spectra; its peak is the shift between the grids."""
    return inverse(cross_power_spectrum(forward_normalized(a), forward_normalized(b)), a.size[0])


def wiener_deconvolution(g: Grid, point_spread: Grid, noise: float) -> Grid:
    """The grid with the point spread (at its size, centre at the origin) taken out."""
    return inverse_normalized(multiply(forward(g), complexes.wiener(forward(point_spread), noise)), g.size[0])


def convolved_by_spectrum(g: Grid, point_spread: Grid) -> Grid:
    """Periodic convolution as a product of spectra."""
    return inverse_normalized(multiply(forward(g), forward(point_spread)), g.size[0])
