"""Directed measures of all channels of a sample together.

A multichannel autoregression is fitted to each sample from a table of lag moments that Spark sums over blocks of steps: sums and counts of products
``z_a(t - lag) z_b(t)`` for every two channels. Only these moments reach the solver, one sample at a time: as for precision matrices, the channel-by-channel matrices of one sample
must fit in a task, its series need not. The transfer matrix is then inverted frequency by frequency. Samples of a batch with as many channels go side by side.

A channel without values (a constant one) is left out of its sample's model, and its pairs are NULL. Steps that a channel lacks are left out of its sums; a sample whose moments are
no covariance of any process after that, or whose channels determine each other, has NULL in every pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.functions.batches import CELLS, group_starts, local_codes, map_whole
from pairspan.operators.pairs import PAIR, melt_stats
from pairspan.spi.spectral import BANDS

MAX_ORDER = 10
FREQUENCIES = np.arange(1, 64) / 128
MEASURES = ("dtf", "dcoh", "pdcoh", "gpdcoh", "ddtf")
STATS = [f"{m}_multitaper_{how}_fs-1_{tag}" for m in MEASURES for how in ("mean", "max") for tag in BANDS]


def lag_moments(panel: DataFrame, max_lag: int = MAX_ORDER, block: int = 4096, value: str = "z") -> DataFrame:
    """``sample_id, node_from, node_to, lag, s, n``: sum and number of products of the first channel ``lag`` steps earlier with the second.

    A task holds one block of steps of a sample, with the ``max_lag`` steps before it; sums over blocks are Spark's. ``t`` must be a whole number.
    """
    cells = [F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"s{k}").alias("s"), F.col(f"n{k}").alias("n")) for k in range(max_lag + 1)]
    wide = wide_moments(panel, max_lag, block, value)
    return wide.select(*PAIR, F.inline(F.array(*cells)))


def wide_moments(panel: DataFrame, max_lag: int, block: int, value: str = "z") -> DataFrame:
    """The lag moments of two channels as one row: ``s0, s1, ..`` and ``n0, n1, ..``."""
    if block <= max_lag:
        raise ValueError("a block must be longer than the largest lag")
    home = F.floor(F.col("t") / block)
    late = F.col("t") - home * block >= block - max_lag  # the next block looks back at these steps
    rows = panel.select("sample_id", "node", "t", F.col(value).cast("double").alias("v"), F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))).alias("blk"))
    names = [f"{k}{lag}" for k in "sn" for lag in range(max_lag + 1)]

    def products(table: pa.Table) -> pa.Table:
        first = group_starts(table, ["sample_id", "blk"])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        node_names, there, (node,) = local_codes(group, len(first), table["node"])
        ids, nodes = table["sample_id"].combine_chunks().take(pa.array(first)), pa.array(node_names, pa.string())
        at = table["t"].to_numpy() - table["blk"].to_numpy() * block + max_lag
        v = table["v"].to_numpy()
        held = ~np.isnan(v)
        width = np.maximum(np.maximum.reduceat(at, first) + 1, max_lag)
        parts = []
        for p, w in sorted(set(zip(there.sum(axis=1).tolist(), width.tolist(), strict=True))):
            same = np.flatnonzero((there.sum(axis=1) == p) & (width == w))
            step = max(1, int(4 * CELLS // (p * max(p * max_lag, w))))
            for lo in range(0, len(same), step):
                own = same[lo : lo + step]
                row = np.flatnonzero(np.isin(group, own) & held)
                x, ok = np.zeros((2, len(own), p, w))
                place = np.searchsorted(own, group[row]), node[row], at[row]
                x[place], ok[place] = v[row], 1
                a, b = np.repeat(np.arange(p), p), np.tile(np.arange(p), p)
                mine = np.nonzero(there[own])[1].reshape(len(own), p)
                columns = {"sample_id": ids.take(pa.array(np.repeat(own, p * p))), "node_from": nodes.take(pa.array(mine[:, a].ravel())), "node_to": nodes.take(pa.array(mine[:, b].ravel()))}
                for lag in range(max_lag + 1):
                    early = slice(max_lag - lag, w - lag)
                    columns[f"s{lag}"] = pa.array((x[:, :, early] @ np.swapaxes(x[:, :, max_lag:], 1, 2)).ravel())
                    columns[f"n{lag}"] = pa.array((ok[:, :, early] @ np.swapaxes(ok[:, :, max_lag:], 1, 2)).ravel().astype(np.int64))
                parts.append(pa.table(columns).select([*PAIR, *names]))
        return pa.concat_tables(parts)

    schema = "sample_id string, node_from string, node_to string, " + ", ".join(f"{k} {'double' if k[0] == 's' else 'long'}" for k in names)
    return map_whole(rows, ["sample_id", "blk"], products, schema).groupBy(*PAIR).agg(*[F.sum(k).alias(k) for k in names])


def autoregressions(r: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coefficients by lag, residual covariance) of the models of order 1, 2, ... that autocovariances ``r[lag] = E z(t) z(t - lag)'`` determine.

    Each order follows from the one before by its forward and backward models. Ends before a residual covariance that is not positive.
    """
    none = np.zeros((0, *r[0].shape))
    ahead, back, v_ahead, v_back, out = none, none, r[0], r[0], []
    for m in range(len(r) - 1):
        if min(np.linalg.eigvalsh(v_ahead).min(), np.linalg.eigvalsh(v_back).min()) <= 1e-9:
            break
        rest = r[m + 1] - sum((ahead[k] @ r[m - k] for k in range(m)), np.zeros_like(r[0]))
        new, new_back = np.linalg.solve(v_back, rest.T).T, np.linalg.solve(v_ahead, rest).T
        ahead, back = np.concatenate([ahead - new @ back[::-1], new[None]]), np.concatenate([back - new_back @ ahead[::-1], new_back[None]])
        v_ahead, v_back = v_ahead - new @ rest.T, v_back - new_back @ rest
        v_ahead, v_back = (v_ahead + v_ahead.T) / 2, (v_back + v_back.T) / 2
        if np.linalg.eigvalsh(v_ahead).min() <= 1e-9:
            break
        out.append((ahead, v_ahead))
    return out


def best_order(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The model of the lowest Bayesian information criterion among orders that have at least two steps for each coefficient of a channel."""
    return best_orders(r[None], np.array([n]))[0]


def best_orders(r: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The models of samples side by side: autocovariances (sample, lag, channel, channel) of ``n`` steps. The method of :func:`autoregressions`."""
    many, lags, p, _ = r.shape
    best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * many
    score, live = np.full(many, np.inf), np.arange(many)

    def turned(v: np.ndarray) -> np.ndarray:
        return np.swapaxes(v, -1, -2)

    def low(v: np.ndarray) -> np.ndarray:
        return np.linalg.eigvalsh(v).min(axis=-1)

    ahead, back, v_ahead, v_back = np.zeros((many, 0, p, p)), np.zeros((many, 0, p, p)), r[:, 0], r[:, 0]
    for m in range(lags - 1):
        on = (np.minimum(low(v_ahead), low(v_back)) > 1e-9) & (2 * (m + 1) * p <= n[live])
        live, ahead, back, v_ahead, v_back = live[on], ahead[on], back[on], v_ahead[on], v_back[on]
        if not len(live):
            break
        own = r[live]
        rest = own[:, m + 1] - sum((ahead[:, k] @ own[:, m - k] for k in range(m)), np.zeros((len(live), p, p)))
        new, new_back = turned(np.linalg.solve(v_back, turned(rest))), turned(np.linalg.solve(v_ahead, rest))
        ahead, back = np.concatenate([ahead - new[:, None] @ back[:, ::-1], new[:, None]], axis=1), np.concatenate([back - new_back[:, None] @ ahead[:, ::-1], new_back[:, None]], axis=1)
        v_ahead, v_back = v_ahead - new @ turned(rest), v_back - new_back @ rest
        v_ahead, v_back = (v_ahead + turned(v_ahead)) / 2, (v_back + turned(v_back)) / 2
        on = low(v_ahead) > 1e-9
        live, ahead, back, v_ahead, v_back = live[on], ahead[on], back[on], v_ahead[on], v_back[on]
        if not len(live):
            break
        got = n[live] * np.linalg.slogdet(v_ahead)[1] + (m + 1) * p * p * np.log(n[live])
        for k in np.flatnonzero(got < score[live]):
            best[live[k]], score[live[k]] = (ahead[k], v_ahead[k]), got[k]
    return best


def directed_measures(coef: np.ndarray, cov: np.ndarray, f: np.ndarray = FREQUENCIES) -> dict[str, np.ndarray]:
    """Mean and maximum over each band of every measure, as matrices (to, from); of one sample, or of several of one order along the first axis."""
    if cov.ndim == 2:
        return {k: v[0] for k, v in directed_measures(coef[None], cov[None], f).items()}
    many, order, p, _ = coef.shape
    power, inverse = np.einsum("sii->si", cov)[:, None], np.linalg.inv(cov)[:, None]
    step = max(1, CELLS // (many * p * p))

    def transfer(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phase = np.exp(-2j * np.pi * part[:, None] * np.arange(1, order + 1))
        a = np.eye(p) - (phase @ coef.reshape(many, order, p * p)).reshape(many, len(part), p, p)
        return a, np.linalg.inv(a)

    parts = [f[at : at + step] for at in range(0, len(f), step)]
    models = [transfer(part) for part in parts] if len(parts) == 1 else None
    gained = sum((np.abs((models[k] if models else transfer(part))[1]) ** 2).sum(axis=(1, 3)) for k, part in enumerate(parts))  # of each channel, from all and over all frequencies
    total = {k: np.zeros((many, p, p)) for k in STATS}
    for at, part in enumerate(parts):
        a, h = models[at] if models else transfer(part)
        a2, h2 = np.abs(a) ** 2, np.abs(h) ** 2
        g = np.conj(np.swapaxes(a, 2, 3)) @ inverse @ a
        own = np.einsum("sfii->sfi", g).real
        partial = np.abs(g) / np.sqrt(own[..., :, None] * own[..., None, :])
        weighed, scaled = h2 * power[:, :, None], a2 / power[..., None]
        values = {
            "dtf": np.sqrt(h2 / h2.sum(axis=3, keepdims=True)),
            "dcoh": np.sqrt(weighed / weighed.sum(axis=3, keepdims=True)),
            "pdcoh": np.sqrt(a2 / a2.sum(axis=2, keepdims=True)),
            "gpdcoh": np.sqrt(scaled / scaled.sum(axis=2, keepdims=True)),
            "ddtf": np.sqrt(h2 / gained[:, None, :, None]) * partial,
        }
        for tag, (low, high) in BANDS.items():
            inside = (part > low) & (part < high)
            n = ((f > low) & (f < high)).sum()
            if inside.any():
                for m, v in values.items():
                    total[f"{m}_multitaper_mean_fs-1_{tag}"] += v[:, inside].sum(axis=1) / n
                    name = f"{m}_multitaper_max_fs-1_{tag}"
                    total[name] = np.maximum(total[name], v[:, inside].max(axis=1))
    return total


def _solve(table: pa.Table) -> pa.Table:
    """All measures of samples from their lag moments."""
    first = group_starts(table, ["sample_id"])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
    names, there, (source, to) = local_codes(group, len(first), table["node_from"], table["node_to"])
    lags = (table.num_columns - len(PAIR)) // 2
    sums, counts = (np.stack([table[f"{k}{lag}"].to_numpy() for lag in range(lags)], axis=1).astype(float) for k in "sn")
    size, parts = there.sum(axis=1), []
    for p in np.unique(size[size > 1]):
        same = np.flatnonzero(size == p)
        step = max(1, int(4 * CELLS // (lags * p * p)))
        for lo in range(0, len(same), step):
            own = same[lo : lo + step]
            row = np.flatnonzero(np.isin(group, own))
            s, n = np.zeros((2, len(own), lags, p, p))
            place = np.searchsorted(own, group[row]), slice(None), to[row], source[row]
            s[place], n[place] = sums[row], counts[row]
            i, j = np.nonzero(~np.eye(p, dtype=bool))
            values = {k: v[:, i, j] for k, v in _measures(s, n).items()}
            nodes = np.nonzero(there[own])[1].reshape(len(own), p)
            ids, node = table["sample_id"].combine_chunks().take(pa.array(np.repeat(first[own], len(i)))), pa.array(names, pa.string())
            columns = {"sample_id": ids, "node_from": node.take(pa.array(nodes[:, j].ravel())), "node_to": node.take(pa.array(nodes[:, i].ravel()))}
            parts.append(pa.table(columns | {k: pa.array(v.ravel(), from_pandas=True) for k, v in values.items()}))
    if not parts:
        return pa.table({k: pa.array([], pa.string()) for k in PAIR} | {k: pa.array([], pa.float64()) for k in STATS})
    return pa.concat_tables(parts)


def _measures(s: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The measures (sample, to, from) of samples of as many channels, from sums and counts (sample, lag, to, from)."""
    many, lags, p, _ = s.shape
    values = {k: np.full((many, p, p), np.nan) for k in STATS}
    has = np.einsum("sii->si", n[:, 0]) > 0
    for kept in np.unique(has, axis=0):
        live = np.flatnonzero(kept)
        if len(live) < 2:
            continue
        own = np.flatnonzero((has == kept).all(axis=1))
        cut = np.ix_(own, range(lags), live, live)
        # shares of the steps at lag 0, so that longer lags shrink and a model of whole series is always stable
        steps, seen = n[np.ix_(own, [0], live, live)], n[cut]
        whole = n[own, 0].max(axis=(1, 2))
        expected = np.maximum(steps - np.arange(lags)[:, None, None], 1)
        models = best_orders(s[cut] / np.maximum(seen, 1) * np.minimum(1, expected / np.maximum(steps, 1)), whole.astype(np.int64))
        order = np.array([0 if m is None else len(m[0]) for m in models])
        for k in np.unique(order[order > 0]):
            at = np.flatnonzero(order == k)
            step = max(1, int(CELLS // (len(FREQUENCIES) * len(live) ** 2)))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                got = directed_measures(np.stack([models[m][0] for m in part]), np.stack([models[m][1] for m in part]))
                for name, v in got.items():
                    values[name][np.ix_(own[part], live, live)] = v
    return values


def spi_directed(panel: DataFrame, max_order: int = MAX_ORDER, block: int = 4096) -> DataFrame:
    """Directed transfer function, directed coherence, partial directed coherence (plain and generalised) and direct transfer function of every ordered pair."""
    schema = "sample_id string, node_from string, node_to string, " + ", ".join(f"`{k}` double" for k in STATS)
    solved = map_whole(wide_moments(panel, int(max_order), int(block)), ["sample_id"], _solve, schema)
    return melt_stats(solved, {k: F.col(f"`{k}`") for k in STATS})


def _one(measure: str):
    def fn(panel: DataFrame) -> DataFrame:
        return spi_directed(panel).where(F.col("spi").startswith(f"{measure}_multitaper"))

    fn.__doc__ = f"Band mean and maximum of {measure}."
    return fn


spi_dtf, spi_dcoh, spi_pdcoh, spi_gpdcoh, spi_ddtf = (_one(m) for m in MEASURES)
