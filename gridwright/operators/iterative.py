"""Operators that repeat: each round reads what the one before wrote.

Plans of many rounds grow without bound and are lost with one executor, so a
grid is written every few rounds into the shared folder that the session's
``spark.checkpoint.dir`` names.  Rounds that are functions of arrays run several at
a time on tiles that carry enough cells around them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from gridwright.errors import GridError
from gridwright.functions import kernels
from gridwright.functions.kernels import Kernel
from gridwright.operators import tiles
from gridwright.operators.grid import Grid, ieee_div, n_ary
from gridwright.operators.stencil import convolve
from gridwright.sources.shared import shared_folder

EVERY = 3
AT_ONCE = 8
"""Rounds that a tile goes through between shuffles."""


def checkpointed(g: Grid) -> Grid:
    """Evaluate and cut the lineage; the copy lies in the checkpoint folder."""
    shared_folder(g.df.sparkSession)
    return Grid(g.cells.checkpoint(), g.size)


def repeated(g: Grid, step: Callable[[Grid], Grid], rounds: int, every: int = EVERY) -> Grid:
    """``step`` applied ``rounds`` times."""
    for i in range(rounds):
        g = step(g)
        if (i + 1) % every == 0 and i + 1 < rounds:
            g = checkpointed(g)
    return g


def in_blocks(g: Grid, step: Callable[[np.ndarray], np.ndarray], times: int, reach: int = 1, border: str = "repeat", at_once: int = AT_ONCE) -> Grid:
    """``step`` of the whole grid ``times`` times, ``at_once`` rounds for each shuffle.

    ``step`` makes of an array one that lacks ``reach`` cells at every side.  A tile
    carries as many cells around it as its rounds use up.
    """
    while times:
        now = min(at_once, times)
        halo = [now * reach] * g.dimension
        g = tiles.by_tiles(g, halo, halo, lambda block, tile, now=now: tiles.rounds(block, tile, step, now, reach, border), "zero" if border in ("repeat", "mirror") else border)
        times -= now
        if times:
            g = checkpointed(g)
    return g


def _within(a: np.ndarray, by: int) -> np.ndarray:
    """The array, if its whole numbers stay such when they grow ``by`` times."""
    if a.dtype.kind == "i" and a.size and max(-int(a.min()), int(a.max())) > np.iinfo(np.int64).max // by:
        raise GridError("values leave the range of whole numbers")
    return a


def laplace_iteration(g: Grid, rounds: int, border: str = "repeat") -> Grid:
    """The Laplacian of the Laplacian and so on, of an image."""
    if border == "none" or g.dimension != 2:
        return repeated(g, lambda x: convolve(x, kernels.laplacian(), border), rounds)

    def step(a: np.ndarray) -> np.ndarray:
        _within(a, 8)
        return a[:-2, 1:-1] + a[1:-1, :-2] - 4 * a[1:-1, 1:-1] + a[1:-1, 2:] + a[2:, 1:-1]

    return in_blocks(g, step, rounds, border=border)


def anisotropic_diffusion(g: Grid, rounds: int, kappa: float, gamma: float, border: str = "repeat") -> Grid:
    """Each cell takes from its four neighbours, less across edges: ``sum(exp(-(d / kappa)^2) * d) * gamma``."""

    def step(a: np.ndarray) -> np.ndarray:
        here = out = a[1:-1, 1:-1]
        for near in (a[:-2, 1:-1], a[1:-1, :-2], a[1:-1, 2:], a[2:, 1:-1]):
            d = near - here
            out = out + np.exp(-(d / kappa) * (d / kappa)) * d * gamma
        return out

    return in_blocks(g.with_value(g.value.cast("double")), step, rounds, border=border)


FAR = 64


def _lucy_in_blocks(g: Grid, point_spread: Kernel, rounds: int, border: str) -> Grid:
    low, high = list(point_spread.centre), [e - 1 for e in point_spread.end]
    there, back = point_spread.low_rank(), point_spread.flipped().low_rank()
    halo = [rounds * (a + b) for a, b in zip(low, high)]

    def f(block: np.ndarray, tile: tiles.Tile) -> np.ndarray:
        way = tiles.Rounds(tile, border)
        data = estimate = way.begun(block)
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(rounds):
                seen = tiles.correlated(way.padded(estimate, low, high), there)
                data, estimate = (way.lessened(x, low, high) for x in (data, estimate))
                change = tiles.correlated(way.padded(data / seen, high, low), back)
                data, estimate = (way.lessened(x, high, low) for x in (data, estimate))
                estimate = estimate * change
        return way.ended(estimate)

    return tiles.by_tiles(g.with_value(g.value.cast("double")), halo, halo, f, "zero" if border in ("repeat", "mirror") else border)


def richardson_lucy(g: Grid, point_spread: Kernel, rounds: int, border: str = "repeat") -> Grid:
    """The estimate times the back-projected ratio of data and projected estimate.

    As long as the rounds reach :data:`FAR` cells at most they go through tiles in one shuffle.
    """
    own = all(0 <= c < n for c, n in zip(point_spread.centre, point_spread.size))
    if own and border != "none" and 2 * rounds * max(point_spread.reach) <= FAR:
        return _lucy_in_blocks(g, point_spread, rounds, border)
    data = g.with_value(g.value.cast("double")).settled()
    back = point_spread.flipped()

    def step(estimate: Grid) -> Grid:
        seen = convolve(estimate, point_spread, border).settled()
        ratio = n_ary(lambda d, s: ieee_div(d, s), data, seen).settled()
        return n_ary(lambda e, r: e * r, estimate, convolve(ratio, back, border).settled()).settled()

    return repeated(data, step, rounds, every=1)
