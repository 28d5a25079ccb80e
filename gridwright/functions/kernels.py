"""Convolution weights: small arrays on the driver, axis x last, with a centre."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Kernel:
    """Weights and the position that lies on the cell itself (centre, x first)."""

    weights: np.ndarray
    centre: tuple[int, ...]

    @staticmethod
    def of(weights, centre: Sequence[int] | None = None) -> Kernel:
        w = np.asarray(weights)
        return Kernel(w, tuple(centre) if centre is not None else tuple((n - 1) // 2 for n in reversed(w.shape)))

    @property
    def size(self) -> tuple[int, ...]:
        return tuple(reversed(self.weights.shape))

    @property
    def start(self) -> tuple[int, ...]:
        """Smallest offset along each axis."""
        return tuple(-c for c in self.centre)

    @property
    def end(self) -> tuple[int, ...]:
        """Offsets stop before this."""
        return tuple(n - c for n, c in zip(self.size, self.centre))

    @property
    def reach(self) -> tuple[int, ...]:
        """The farthest cell, either way, along each axis."""
        return tuple(max(c, n - 1 - c) for n, c in zip(self.size, self.centre))

    def at(self, offset: Sequence[int]):
        """The weight at an offset from the centre."""
        return self.weights[tuple(c + o for c, o in zip(reversed(self.centre), reversed(offset)))].item()

    def flipped(self) -> Kernel:
        """Mirrored along all axes: correlation with it is convolution in the strict sense."""
        return Kernel(self.weights[(slice(None, None, -1),) * self.weights.ndim], tuple(n - 1 - c for n, c in zip(self.size, self.centre)))

    def separated(self) -> list[np.ndarray] | None:
        """One-dimensional factors (x first) of a whole-number kernel of rank one, else None."""
        w = self.weights
        if w.ndim != 2 or not np.issubdtype(w.dtype, np.integer) or not w.any():
            return None
        i, j = (int(x[0]) for x in np.nonzero(w))
        if w[i, j] and (np.outer(w[:, j], w[i, :]) == w[i, j] * w).all() and not (w[:, j] % w[i, j]).any():
            return [w[i, :], w[:, j] // w[i, j]]
        return None

    def low_rank(self, tolerance: float = 1e-14) -> list[list[np.ndarray]]:
        """Products of lines (x first) whose sum is the weights, as few as singular values allow."""
        return _products(np.asarray(self.weights, float), tolerance * float(np.abs(self.weights).sum()))


def _products(w: np.ndarray, least: float) -> list[list[np.ndarray]]:
    if w.ndim == 1:
        return [[w]]
    u, s, v = np.linalg.svd(w.reshape(len(w), -1), full_matrices=False)
    out = []
    for k in range(len(s)):
        if s[k] > least or not k:
            out += [[*inner, u[:, k] * s[k]] for inner in _products(v[k].reshape(w.shape[1:]), least)]
    return out


def constant(value, size: Sequence[int], centre: Sequence[int] | None = None) -> Kernel:
    return Kernel.of(np.full(tuple(reversed(size)), value), centre)


def separable(*factors: Kernel) -> Kernel:
    """The product of one-dimensional kernels, x first."""
    w = factors[0].weights
    for f in factors[1:]:
        w = np.multiply.outer(f.weights, w)
    return Kernel(w, tuple(f.centre[0] for f in factors))


def gaussian_size(sigma: float) -> int:
    return 2 * int(2 * sigma + 0.5) + 1


def gaussian(sigma: float | None = None, size: int | None = None, at_edge: float | None = None) -> Kernel:
    """Normalised Gaussian weights: by sigma, or by size and how many sigmas the edge is away."""
    if size is None:
        size = gaussian_size(sigma)
    elif sigma is None:
        sigma = max(size // 2, 1) / at_edge
    x = np.arange(size) - size // 2
    w = np.exp(-(x * x) / (2 * sigma * sigma))
    return Kernel((w / w.sum()), (size // 2,))


def gaussian_nd(*sigmas: float) -> Kernel:
    return separable(*map(gaussian, sigmas))


def sobel(dimension: int, axis: int) -> Kernel:
    """Derivative 1, 0, -1 along ``axis``, smoothing 1, 2, 1 along the others."""
    return separable(*(Kernel.of([1, 0, -1] if d == axis else [1, 2, 1]) for d in range(dimension)))


def laplacian() -> Kernel:
    return Kernel.of([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
