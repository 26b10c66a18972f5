"""Linear fits and cointegration tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairspan.functions.batches import map_arrays
from pairspan.operators.pairs import PAIR, grid_arrays, melt_stats
from pairspan.spi.basic import pair_moments


DECAY = 1e-4  # penalty of the fit by stochastic gradients
EVIDENCE_ROUNDS = 300


def evidence_slope(n: Column, sxx: Column, syy: Column, sxy: Column, rounds: int = EVIDENCE_ROUNDS) -> Column:
    """Slope of a Bayesian ridge of one regressor: the precisions of noise and slope are re-estimated from each other until they rest.

    A fixed-point iteration on the moments, for a batch of rows at once; both precisions have flat gamma priors (1e-6).
    """

    @F.pandas_udf("double")
    def slopes(n: pd.Series, sxx: pd.Series, syy: pd.Series, sxy: pd.Series) -> pd.Series:
        n, sxx, syy, sxy = (v.to_numpy(float) for v in (n, sxx, syy, sxy))
        noise, weight = n / (syy + 1e-12), np.ones(len(n))
        for _ in range(rounds):
            slope = sxy / (sxx + weight / noise)
            left = np.maximum(syy - 2 * slope * sxy + slope * slope * sxx, 0.0)
            used = noise * sxx / (weight + noise * sxx)
            noise, weight = (n - used + 2e-6) / (left + 2e-6), (used + 2e-6) / (slope * slope + 2e-6)
        return pd.Series(sxy / (sxx + weight / noise))

    return slopes(n, sxx, syy, sxy)


def spi_lmfit(panel: DataFrame) -> DataFrame:
    """Mean squared error of y predicted from x by one-regressor penalised fits, from moments. The fit by stochastic gradients is taken where it converges to."""
    m = pair_moments(panel, directed=True).where("n > 0")
    n, sxx, syy, sxy = (F.col(c).cast("double") for c in ("n", "sxx", "syy", "sxy"))
    m = m.withColumn("evidence", evidence_slope(n, sxx, syy, sxy))

    def soft(by: float) -> Column:
        c = sxy / n
        return F.signum(c) * F.greatest(F.abs(c) - by, F.lit(0.0))

    betas = {
        "Ridge": sxy / (sxx + 1), "Lasso": soft(1.0) / (sxx / n), "ElasticNet": soft(0.5) / (sxx / n + 0.5),
        "SGDRegressor": sxy / (sxx + n * DECAY), "BayesianRidge": F.col("evidence"),
    }
    return melt_stats(m, {f"lmfit_{k}": (syy - 2 * b * sxy + b * b * sxx) / n for k, b in betas.items()})


def _residual(v: np.ndarray, on: np.ndarray | None) -> np.ndarray:
    if on is None:
        return v
    gram = np.swapaxes(on, 1, 2) @ on
    return v - on @ (np.linalg.pinv(gram) @ (np.swapaxes(on, 1, 2) @ v))


def _detrended(v: np.ndarray, order: int) -> np.ndarray:
    n = v.shape[1]
    t = np.linspace(-1, 1, n)
    basis = np.stack([t**k for k in range(order + 1)], axis=1)
    return _residual(v, np.broadcast_to(basis, (len(v), *basis.shape)))


def johansen(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Trace and largest-eigenvalue statistics for no cointegration, from lagged differences."""
    out = {}
    z = np.stack([x, y], axis=2)
    for order in (0, 1):
        levels = _detrended(z, order)
        for lag in (1, 10):
            n = x.shape[1] - lag - 1
            if n < 2 * lag + 6:
                for s in ("trace", "max"):
                    out[f"{s}_{order}_{lag}"] = np.full(len(x), np.nan)
                continue
            d = _detrended(np.diff(levels, axis=1), 0)
            past = np.concatenate([d[:, lag - k : d.shape[1] - k] for k in range(1, lag + 1)], axis=2)
            r0 = _residual(d[:, lag:], past)
            r1 = _residual(_detrended(levels[:, lag:-1], 0), past)
            s00, s01, s11 = (np.swapaxes(a, 1, 2) @ b / n for a, b in ((r0, r0), (r0, r1), (r1, r1)))
            m = np.linalg.pinv(s11) @ np.swapaxes(s01, 1, 2) @ np.linalg.pinv(s00) @ s01
            eig = np.sort(np.clip(np.linalg.eigvals(m).real, 0, 1 - 1e-12), axis=1)
            out[f"trace_{order}_{lag}"] = -n * np.log(1 - eig).sum(axis=1)
            out[f"max_{order}_{lag}"] = -n * np.log(1 - eig[:, -1])
    return out


JOHANSEN = [f"{s}_{o}_{k}" for o in (0, 1) for k in (1, 10) for s in ("trace", "max")]


def spi_coint_johansen(panel: DataFrame) -> DataFrame:
    m = map_arrays(grid_arrays(panel, value="signal"), PAIR, ["x", "y"], johansen, JOHANSEN, power=1)
    names = {}
    for c in JOHANSEN:
        s, order, lag = c.split("_")
        names[f"coint_johansen_{'max_eig' if s == 'max' else s}_stat_order-{order}_ardiff-{lag}"] = F.col(c)
    return melt_stats(m, names)


def _unit_root_t(e: np.ndarray, rule: str, max_lag: int = 10) -> np.ndarray:
    """t of the lagged level in the difference regression, its lag chosen by an information rule."""
    b, n = e.shape
    d = np.diff(e, axis=1)
    rows = n - 1 - max_lag
    best, t_best = np.full(b, np.inf), np.full(b, np.nan)
    if rows < max_lag + 4:
        return t_best
    for lag in range(max_lag + 1):
        cols = [e[:, max_lag:-1]] + [d[:, max_lag - k : n - 1 - k] for k in range(1, lag + 1)]
        on, now = np.stack(cols, axis=2), d[:, max_lag:]
        inv = np.linalg.pinv(np.swapaxes(on, 1, 2) @ on)
        beta = (inv @ (np.swapaxes(on, 1, 2) @ now[:, :, None]))[:, :, 0]
        rss = ((now - (on @ beta[:, :, None])[:, :, 0]) ** 2).sum(axis=1)
        k = on.shape[2]
        score = rows * np.log(np.where(rss > 0, rss, np.nan) / rows) + (2 if rule == "aic" else np.log(rows)) * k
        t = beta[:, 0] / np.sqrt(rss / (rows - k) * inv[:, 0, 0])
        better = np.nan_to_num(score, nan=np.inf) < best - 1e-12
        best, t_best = np.where(better, score, best), np.where(better, t, t_best)
    return t_best


AEG = {"c_aic": ("c", "aic"), "ct_aic": ("ct", "aic"), "ct_bic": ("ct", "bic")}


def residual_unit_root(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    n = x.shape[1]
    for name, (trend, rule) in AEG.items():
        cols = [y, np.ones_like(x)] + ([np.broadcast_to(np.arange(n, dtype=float) / n, x.shape)] if trend == "ct" else [])
        out[name] = _unit_root_t(_residual(x[:, :, None], np.stack(cols, axis=2))[:, :, 0], rule)
    return out


def spi_coint_aeg(panel: DataFrame) -> DataFrame:
    m = map_arrays(grid_arrays(panel, value="signal"), PAIR, ["x", "y"], residual_unit_root, list(AEG), power=1)
    return melt_stats(m, {f"coint_aeg_tstat_trend-{t}_autolag-{r}_maxlag-10": F.col(c) for c, (t, r) in AEG.items()})
