"""Gaussian-process fits of one series from another, and the direction in which the noise is independent.

Series are standardised. The kernel's length and the noise are taken from a fixed grid by marginal likelihood, from the eigenvalues of a series' T x T kernel, which serve
every noise and every series that it is to explain; a pair holds a few such arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.functions.batches import map_arrays
from pairspan.operators.pairs import PAIR, melt_stats, pair_arrays
from pairspan.spi.distance import kernel_dependence

# The grid.
LENGTHS = (0.25, 0.5, 1.0, 2.0)
NOISES = (0.01, 0.1, 0.3, 0.6, 1.0)


def kernels(x: np.ndarray, kind: str) -> list[np.ndarray]:
    """Kernel matrices (b, n, n) of unit scale: squared exponentials of each length, or the product of the values plus one."""
    if kind == "DotProduct":
        return [1 + x[:, :, None] * x[:, None, :]]
    gap = (x[:, :, None] - x[:, None, :]) ** 2
    return [np.exp(-gap / (2 * length**2)) for length in LENGTHS]


def fitted(x: np.ndarray, y: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Means of the process at the points, and the log marginal likelihood, of the likeliest kernel and noise for each row."""
    b, n = x.shape
    own, at = np.unique(x, axis=0, return_inverse=True)  # a series that explains several others has its kernels taken apart once
    at = at.reshape(-1)
    best, mean = np.full(b, -np.inf), np.zeros((b, n))
    for k in kernels(own, kind):
        values, axes = np.linalg.eigh(k)
        values, turned = np.maximum(values, 0.0)[at], np.empty_like(y)
        for i in range(len(own)):
            turned[at == i] = y[at == i] @ axes[i]
        chosen = np.full((b, n), np.nan)
        for noise in NOISES:
            spread = values + noise
            part = turned / spread
            likelihood = -0.5 * (turned * part).sum(axis=1) - 0.5 * np.log(spread).sum(axis=1) - n / 2 * np.log(2 * np.pi)
            better = likelihood > best
            chosen = np.where(better[:, None], values * part, chosen)
            best = np.maximum(best, likelihood)
        for i in range(len(own)):
            rows = np.flatnonzero((at == i) & ~np.isnan(chosen[:, 0]))
            mean[rows] = chosen[rows] @ axes[i].T
    return mean, best


def process_error(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    return {kind: ((y - fitted(x, y, kind)[0]) ** 2).mean(axis=1) for kind in ("DotProduct", "RBF")}


def noise_dependence(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """How far what x leaves of y depends on x: small where y is a function of x and noise of its own."""
    left = y - fitted(x, y, "RBF")[0]
    left = left - left.mean(axis=1, keepdims=True)
    sd = left.std(axis=1, ddof=1, keepdims=True)
    return {"v": np.where(sd[:, 0] > 1e-9, kernel_dependence(left / np.where(sd > 1e-9, sd, 1), x)["biased"], 0.0)}


def spi_gpfit(panel: DataFrame) -> DataFrame:
    """Mean squared error of each series predicted from another."""
    m = map_arrays(pair_arrays(panel, directed=True), PAIR, ["x", "y"], process_error, ["DotProduct", "RBF"])
    return melt_stats(m, {f"gpfit_{kind}": F.col(kind) for kind in ("DotProduct", "RBF")})


def spi_anm(panel: DataFrame) -> DataFrame:
    """Additive noise model from the first to the second series."""
    m = map_arrays(pair_arrays(panel, directed=True), PAIR, ["x", "y"], noise_dependence, ["v"])
    return melt_stats(m, {"anm": F.col("v")})
