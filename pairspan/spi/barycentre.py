"""Averages of two series under elastic alignment.

A barycentre starts as the mean of both series. In each round it is aligned with either series, and every point becomes the mean of the points that it is aligned with: by the one best
path, or by all paths in their shares under the soft minimum. The linear cost of fixed shares lies above the aligned cost and meets it at the present barycentre, so no round raises the cost. A
pair holds a few arrays of T x T numbers.

Pairs are aligned side by side: a step of the alignment is one operation over an anti-diagonal of all pairs at hand. A pair that rests makes room for the next, so the steps stay wide
although some pairs need many more rounds than others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.functions.batches import CELLS, map_arrays
from pairspan.operators.pairs import PAIR, melt_stats, pair_arrays

ROUNDS, TOL = 200, 1e-8
PASSES, FIRST_STEP, LAST_STEP = 50, 0.05, 0.005  # of the subgradient form: passes over both series, and the fall of its step
KINDS = ("dtw", "sgddtw", "softdtw")


def _diagonals(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for d in range(2 * n - 1):
        i = np.arange(max(0, d - n + 1), min(d, n - 1) + 1)
        out.append((i, d - i))
    return out


def accumulated(cost: np.ndarray, soft: bool) -> np.ndarray:
    """Least (or soft least) cost of a path to each cell, with a border of infinite cost before the first row and column."""
    b, n, _ = cost.shape
    r = np.full((b, n + 1, n + 1), np.inf)
    r[:, 0, 0] = 0.0
    for i, j in _diagonals(n):
        up, left, corner = r[:, i, j + 1], r[:, i + 1, j], r[:, i, j]
        low = np.minimum(np.minimum(up, left), corner)
        if soft:
            low = low - np.log(np.exp(low - up) + np.exp(low - left) + np.exp(low - corner))
        r[:, i + 1, j + 1] = cost[:, i, j] + low
    return r


def path_shares(r: np.ndarray) -> np.ndarray:
    """1 for the cells of the best path, back from the last; of equal ways the diagonal one, then the one over the row before."""
    b, n = len(r), r.shape[1] - 1
    out = np.zeros((b, n, n))
    i, j, rows = np.full(b, n), np.full(b, n), np.arange(b)
    while True:
        out[rows, i - 1, j - 1] = 1.0
        if ((i == 1) & (j == 1)).all():
            return out
        ways = np.stack([r[rows, i - 1, j - 1], r[rows, i - 1, j], r[rows, i, j - 1]])
        way = ways.argmin(axis=0)
        end = (i == 1) & (j == 1)
        i, j = np.where(end, i, i - (way != 2)), np.where(end, j, j - (way != 1))


def soft_shares(r: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Share of all paths, by the soft minimum, that visit each cell."""
    b, n = len(r), r.shape[1] - 1
    out = np.zeros((b, n + 1, n + 1))
    value, low = r[:, 1:, 1:], np.full((b, n + 1, n + 1), -np.inf)
    low[:, :n, :n] = value - cost  # the soft minimum over the ways into a cell
    out[:, n - 1, n - 1] = 1.0
    for i, j in reversed(_diagonals(n)[:-1]):
        here = value[:, i, j]
        out[:, i, j] = sum(out[:, p, q] * np.exp(low[:, p, q] - here) for p, q in ((i + 1, j), (i, j + 1), (i + 1, j + 1)))
    return out[:, :n, :n]


def alignment(z: np.ndarray, x: np.ndarray, soft: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cost of aligning z with x, and the shares of the cells."""
    cost = (z[:, :, None] - x[:, None, :]) ** 2
    r = accumulated(cost, soft)
    return r[:, -1, -1], soft_shares(r, cost) if soft else path_shares(r)


Space = dict[str, np.ndarray]  # memory that every round uses again


def _rows(space: Space, name: str, rows: int, b: int, kind: type = float) -> np.ndarray:
    held = space.get(name)
    if held is None or len(held) < rows * b:
        held = space[name] = np.empty(rows * b, kind)
    return held[: rows * b].reshape(rows, b)


def _gaps(z: np.ndarray, back: np.ndarray, d: int, lo: int, hi: int, out: np.ndarray) -> np.ndarray:
    """Squared distances on anti-diagonal ``d``, rows lo .. hi; ``back`` is the other series from its end."""
    n = len(z)
    np.subtract(z[lo : hi + 1], back[n - 1 - d + lo : n - d + hi], out=out)
    return np.multiply(out, out, out=out)


def hard_sums(z: np.ndarray, x: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of aligning the columns of ``z`` and ``x`` (time, pair) by the best path; for each place of z the number and sum of the points of x it is aligned with.

    Of equal ways into a cell the diagonal one comes first, then the one over the row before.
    """
    n, b = z.shape
    back = x[::-1].copy()
    way = _rows(space, "way", (2 * n - 1) * n, b, np.int8).reshape(2 * n - 1, n, b)  # into each cell: 0 diagonal, 1 from the row before, 2 from the column before
    r = [_rows(space, f"r{k}", n + 1, b) for k in range(3)]  # cell (i, j) is at i + 1 of the row for i + j
    temp, more, left_is_less = _rows(space, "temp", n, b), _rows(space, "more", n, b, bool), _rows(space, "less", n, b, bool)
    for v in r:
        v[:] = np.inf
    r[1][0] = 0.0
    for d in range(2 * n - 1):
        lo, hi = max(0, d - n + 1), min(d, n - 1)
        k = hi - lo + 1
        now, one, two = r[d % 3], r[(d - 1) % 3], r[(d - 2) % 3]
        up, left, corner, low = one[lo : hi + 1], one[lo + 1 : hi + 2], two[lo : hi + 1], temp[:k]
        np.greater(up, left, out=left_is_less[:k])
        np.minimum(up, left, out=low)
        np.greater(corner, low, out=more[:k])
        np.minimum(low, corner, out=low)
        code = np.add(left_is_less[:k].view(np.int8), 1, out=way[d, lo : hi + 1])
        np.multiply(code, more[:k].view(np.int8), out=code)
        own = now[lo + 1 : hi + 2]  # the row three anti-diagonals ago
        now[lo] = np.inf
        _gaps(z, back, d, lo, hi, own)
        own += low
    cost = r[(2 * n - 2) % 3][n].copy()
    count, total = np.zeros(n * b), np.zeros(n * b)
    way, flat = way.reshape(-1), x.reshape(-1)
    at, i, d = np.arange(b), np.full(b, n - 1), np.full(b, 2 * n - 2)
    while len(at):
        here = i * b + at
        count[here] += 1.0
        total[here] += flat[(d - i) * b + at]
        w = way[(d * n + i) * b + at]
        on = d > 0
        i, d = i - (w != 2), d - 1 - (w == 0)
        if not on.all():
            at, i, d = at[on], i[on], d[on]
    return cost, count.reshape(n, b), total.reshape(n, b)


def soft_sums(z: np.ndarray, x: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by the shares of all paths.

    Weights exp(-cost) of the paths into a cell are summed, scaled every few anti-diagonals. Sums below 1e-300 of the scale are taken as that; where paths of more than a share of 1e-20
    go through a cell of less than 1e-240, the pair is aligned by logarithms.
    """
    n, b = z.shape
    back, last, every = x[::-1].copy(), 2 * n - 2, 4
    into = [_rows(space, f"into{d}", min(d, last - d) + 1, b) for d in range(last + 1)]
    ahead = [_rows(space, f"ahead{d}", n + 1, b) for d in range(last + 1)]  # cell (i, j) is at i + 1
    scale: list[np.ndarray | None] = [None] * (last + 1)
    temp, log_scale, least, most = _rows(space, "temp", n, b), np.zeros(b), np.ones(b), np.zeros(b)
    for d in range(last + 1):
        lo, hi = max(0, d - n + 1), min(d, n - 1)
        s, now, w = into[d], ahead[d], temp[: hi - lo + 1]
        if d == 0:
            s[:] = 1.0
        else:
            np.add(ahead[d - 1][lo : hi + 1], ahead[d - 1][lo + 1 : hi + 2], out=s)
        if d > 1:
            corner = ahead[d - 2][lo : hi + 1]
            s += corner if scale[d - 1] is None else np.multiply(corner, scale[d - 1], out=w)
        np.maximum(s, 1e-300, out=s)
        _gaps(z, back, d, lo, hi, w)
        np.exp(np.negative(w, out=w), out=w)
        now[lo], now[min(hi + 2, n)] = 0.0, 0.0
        f = np.multiply(w, s, out=now[lo + 1 : hi + 2])
        if d % every == every - 1:
            top = f.max(axis=0)
            scale[d] = 1.0 / top
            f *= scale[d]
            log_scale += np.log(top)
            np.minimum(least, top, out=least)
    cost = -(np.log(ahead[last][n]) + log_scale)
    share, total = np.zeros((n, b)), np.zeros((n, b))
    after = [_rows(space, f"after{k}", n + 1, b) for k in range(3)]  # shares of an anti-diagonal by the weights that came into the cell, at i
    for d in range(last, -1, -1):
        lo, hi = max(0, d - n + 1), min(d, n - 1)
        e, now, one, two = temp[: hi - lo + 1], after[d % 3], after[(d + 1) % 3], after[(d + 2) % 3]
        if d == last:
            e[:] = 1.0
        else:
            np.add(one[lo : hi + 1], one[lo + 1 : hi + 2], out=e)
            if d < last - 1:
                corner = two[lo + 1 : hi + 2]
                e += corner if scale[d + 1] is None else np.multiply(corner, scale[d + 1], out=now[lo : hi + 1])
            e *= ahead[d][lo + 1 : hi + 2]
        np.maximum(most, np.divide(e, into[d], out=now[lo : hi + 1]).max(axis=0), out=most)
        now[hi + 1] = 0.0
        if lo:
            now[lo - 1] = 0.0
        share[lo : hi + 1] += e
        e *= back[n - 1 - d + lo : n - d + hi]
        total[lo : hi + 1] += e
    lost = np.flatnonzero(~((most < 1e220) & (least > 1e-40) & np.isfinite(cost)))
    step = max(1, CELLS // n**2)
    for k in range(0, len(lost), step):
        c = lost[k : k + step]
        cost[c], e = alignment(z[:, c].T, x[:, c].T, True)
        share[:, c], total[:, c] = e.sum(axis=2).T, np.einsum("bij,bj->ib", e, x[:, c].T)
    return cost, share, total


def barycentre(x: np.ndarray, y: np.ndarray, soft: bool, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """The average of each pair of rows, and the costs round by round."""
    sums = soft_sums if soft else hard_sums
    many, n = x.shape
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    z, costs = (x + y) / 2, []
    room, space = max(1, 2 * CELLS // n**2), {}
    live, after = np.arange(min(room, many)), min(room, many)
    done, before = np.zeros(many, int), np.full(many, np.inf)  # rounds of each pair, and its cost in the last
    while len(live):
        m = len(live)
        two = np.concatenate([z[:, live]] * 2, axis=1), np.concatenate([x[:, live], y[:, live]], axis=1)
        cost, share, total = sums(*two, space)
        cost = cost[:m] + cost[m:]
        while len(costs) <= done[live].max():
            costs.append(np.full(many, np.nan))
        for k in np.unique(done[live]):
            at = done[live] == k
            costs[k][live[at]] = cost[at]
        # a pair rests on its own, whatever pairs it is computed with
        on = (done[live] == 0) | (before[live] - cost > TOL * np.maximum(1, np.abs(cost)))
        before[live] = cost
        done[live] += 1
        own = live[on]
        z[:, own] = (total[:, :m] + total[:, m:])[:, on] / (share[:, :m] + share[:, m:])[:, on]
        own = own[done[own] < rounds]
        more = min(room - len(own), many - after)
        live, after = np.concatenate([own, np.arange(after, after + more)]), after + more
    for a, b in zip(costs, costs[1:], strict=False):
        b[np.isnan(b)] = a[np.isnan(b)]
    return np.ascontiguousarray(z.T), costs


def subgradient_barycentre(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The average by steps towards the points of one series at a time, in turn, with a step that falls evenly."""
    step, space = max(1, 2 * CELLS // x.shape[1] ** 2), {}
    out = [_subgradient(x[at : at + step].T.copy(), y[at : at + step].T.copy(), space).T for at in range(0, len(x), step)]
    return np.concatenate(out) if out else x.copy()


def _subgradient(x: np.ndarray, y: np.ndarray, space: Space) -> np.ndarray:
    z = (x + y) / 2
    for step, v in zip(np.linspace(FIRST_STEP, LAST_STEP, 2 * PASSES), [x, y] * PASSES, strict=True):
        _, count, total = hard_sums(z, v, space)
        z = z - step * 2 * (count * z - total)
    return z


def averages(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for kind, z in zip(KINDS, (barycentre(x, y, False)[0], subgradient_barycentre(x, y), barycentre(x, y, True)[0]), strict=True):
        out |= {f"{kind}_mean": z.mean(axis=1), f"{kind}_max": z.max(axis=1)}
    return out


def spi_bary_elastic(panel: DataFrame) -> DataFrame:
    """Mean and maximum of the barycentres by best paths, by subgradient steps and by soft alignment, plain and squared."""
    names = [f"{kind}_{how}" for kind in KINDS for how in ("mean", "max")]
    m = map_arrays(pair_arrays(panel), PAIR, ["x", "y"], averages, names, power=1)  # the averages choose the pairs that they align at once
    stats = {}
    for n in names:
        stats |= {f"bary_{n}": F.col(n), f"bary-sq_{n}": F.col(n) * F.col(n)}
    return melt_stats(m, stats)
