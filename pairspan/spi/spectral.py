"""Frequency-domain statistics.

Each series is transformed once (Fourier coefficients under sine tapers, Morlet coefficients or the
analytic signal); everything after that is Spark: pairs are joined as coefficient arrays, products
over tapers are summed inside the pair's row, and bands are aggregated over frequencies. Coefficients of two series are
compared only if both have the same steps; a pair with differing steps has NULL in every measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairspan.functions.batches import CELLS, lists_to_numpy, map_arrays
from pairspan.functions.numeric import pearson, ratio
from pairspan.operators.pairs import PAIR, aligned, grid_arrays, join_series, melt_stats, series_arrays
from pairspan.operators.shared import active, shared
from pairspan.session import cut_lineage

TAPERS = 5
MOST_TAPERS = 128
# The three frequency bands, as written in the names of the statistics.
BANDS = {"fmin-0_fmax-0-5": (0.0, 0.5), "fmin-0_fmax-0-25": (0.0, 0.25), "fmin-0-25_fmax-0-5": (0.25, 0.5)}
_VEC = T.ArrayType(T.DoubleType())
COEF = "array<struct<f: double, re: array<double>, im: array<double>>>"
SIGNAL = T.StructType([T.StructField("re", _VEC), T.StructField("im", _VEC)])


def sine_tapers(n: int, first: int = 1, last: int = TAPERS) -> np.ndarray:
    t = np.arange(1, n + 1)
    return np.stack([np.sqrt(2 / (n + 1)) * np.sin(np.pi * k * t / (n + 1)) for k in range(first, last + 1)])


def _by_length(values: pd.Series, fn, fields: list[str]) -> pd.DataFrame:
    """Apply ``fn`` to stacks of equally long series; NULL for series with missing values."""
    rows = [np.asarray([] if v is None else v, dtype=float) for v in values]
    out: list = [None] * len(rows)
    size = np.array([len(r) for r in rows])
    for n in np.unique(size):
        idx = [i for i in np.flatnonzero(size == n) if n > 2 and not np.isnan(rows[i]).any()]
        if idx:
            for i, v in zip(idx, fn(np.stack([rows[i] for i in idx]))):
                out[i] = v
    return pd.DataFrame({k: [None if v is None else v[k] for v in out] for k in fields})


def taper_transform(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies, and Fourier coefficients (b, frequency, taper) of each row under sine tapers."""
    n = m.shape[1]
    spec = np.fft.rfft(m[:, None, :] * sine_tapers(n)[None], axis=2)
    f = np.arange(spec.shape[2]) / n
    # the zero frequency and the folding frequency have no phase
    keep = np.flatnonzero((f > 0) & (f < 0.5))
    return f[keep], spec[:, :, keep].transpose(0, 2, 1)


def wavelet_transform(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients at 10 scales; the 'tapers' of a scale are its time points."""
    n = m.shape[1]
    scales = np.arange(1, 11) / 22
    gap = np.arange(-(n - 1), n)
    size = 1 << (3 * n).bit_length()
    spec = np.fft.fft(m, size, axis=1)
    out = np.empty((len(m), len(scales), n), dtype=complex)
    for i, f in enumerate(scales):  # convolution by Fourier transform: memory stays linear in n
        width = 6 / (2 * np.pi * f)
        wave = np.exp(-2j * np.pi * f * gap) * np.exp(-(gap**2) / (2 * width**2)) / np.sqrt(width)
        out[:, i] = np.fft.ifft(spec * np.fft.fft(wave, size), axis=1)[:, n - 1 : 2 * n - 1]
    return scales, out


def _morlet(m: np.ndarray) -> list:
    f, c = wavelet_transform(m)
    return [{"f": f, "re": list(v.real), "im": list(v.imag)} for v in c]


def _lists(values: pa.Array, rows: int, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), values)


def packed_coefficients(values: pa.Array, transform) -> pa.Array:
    """Coefficients of a few series, as flat Arrow lists; NULL for series with missing values or fewer than three."""
    rows = lists_to_numpy(values)
    kind = pa.list_(pa.struct([("f", pa.float64()), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))]))
    good = np.array([len(r) > 2 and not np.isnan(r).any() for r in rows], bool)
    size = np.array([len(r) for r in rows])
    order, parts = [np.flatnonzero(~good)], [pa.nulls(int((~good).sum()), kind)]
    for n in np.unique(size[good]):
        at = np.flatnonzero(good & (size == n))
        f, c = transform(np.stack([rows[i] for i in at]))
        b, nf, k = c.shape
        sides = [_lists(pa.array(np.ascontiguousarray(v).ravel()), b * nf, k) for v in (c.real, c.imag)]
        cells = pa.StructArray.from_arrays([pa.array(np.tile(f, b)), *sides], fields=list(kind.value_type))
        order.append(at)
        parts.append(_lists(cells, b, nf).cast(kind))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))


@shared(written=True)
def spectral_coefficients(panel: DataFrame, transform=taper_transform) -> DataFrame:
    """``sample_id, node, blk, steps, coef``: one small array of coefficients per series, and a hash of its steps.

    A few series are transformed and sent back at a time, so a worker's memory does not grow with the rows of a batch.
    """
    keys = ["sample_id", "node", "blk", "steps"]
    series = series_arrays(panel).select("sample_id", "node", "blk", F.xxhash64("ts").alias("steps"), "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            longest = max(1, pc.max(pc.list_value_length(rb.column(4))).as_py() or 1)
            step = max(1, CELLS // (10 * longest))
            for at in range(0, rb.num_rows, step):
                part = rb.slice(at, step)
                coef = packed_coefficients(part.column(4), transform)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], coef], names=[*keys, "coef"])

    schema = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys) + f", coef {COEF}"
    return series.mapInArrow(run, schema)


def coefficient_rows(panel: DataFrame) -> DataFrame:
    """One row per sample, node, taper and frequency."""
    c = spectral_coefficients(panel).select("sample_id", "node", F.inline("coef"))
    return c.select("sample_id", "node", "f", F.posexplode(F.arrays_zip("re", "im")).alias("taper", "c")).select(
        "sample_id", "node", (F.col("taper") + 1).alias("taper"), "f", F.col("c.re").alias("re"), F.col("c.im").alias("im")
    )


def _sum(expr: str) -> Column:
    return F.expr(f"aggregate(p, 0D, (s, c) -> s + {expr})")


@shared(written=False)
def pair_spectra(panel: DataFrame, directed: bool, transform=taper_transform) -> DataFrame:
    """One row per pair and frequency; ``p`` holds the cross products, one per taper."""
    coef = spectral_coefficients(panel, transform)
    joined = join_series(coef if active() else cut_lineage(coef), directed)  # both sides of the join read what is written once
    other = F.when(F.col("steps_a") == F.col("steps_b"), F.col("coef_b"))
    rows = joined.select(*PAIR, F.posexplode("coef_a").alias("at", "a"), other.alias("other"))
    rows = rows.select(*PAIR, "a", F.get("other", F.col("at")).alias("b"))
    product = (
        "transform(sequence(0, size(a.re) - 1), k -> named_struct("
        "'re', a.re[k] * b.re[k] + a.im[k] * b.im[k], 'im', a.im[k] * b.re[k] - a.re[k] * b.im[k]))"
    )
    power = "aggregate(zip_with({s}.re, {s}.im, (u, v) -> u * u + v * v), 0D, (s, v) -> s + v)"
    return rows.select(
        *PAIR, F.col("a.f").alias("f"), F.expr(product).alias("p"), F.expr(power.format(s="a")).alias("saa"), F.expr(power.format(s="b")).alias("sbb")
    )


def cross_spectrum(panel: DataFrame) -> DataFrame:
    """``S_ab`` per pair, taper and frequency."""
    s = pair_spectra(panel, False).select(*PAIR, "f", F.posexplode("p").alias("taper", "c"))
    return s.select(*PAIR, (F.col("taper") + 1).alias("taper"), "f", F.col("c.re").alias("re"), F.col("c.im").alias("im"))


def measures(spectra: DataFrame) -> DataFrame:
    """Every per-frequency measure from the cross products."""
    mag = "sqrt(c.re * c.re + c.im * c.im)"
    s = spectra.select(
        *PAIR, "f", F.size("p").alias("k"), "saa", "sbb",
        _sum("c.re").alias("re"), _sum("c.im").alias("im"),
        _sum(f"try_divide(c.re, {mag})").alias("ure"), _sum(f"try_divide(c.im, {mag})").alias("uim"),
        _sum("signum(c.im)").alias("sg"), _sum("abs(c.im)").alias("aim"), _sum("c.im * c.im").alias("im2"),
    )
    k, den = F.col("k"), F.sqrt(F.col("saa") * F.col("sbb"))
    plv2 = F.col("ure") * F.col("ure") + F.col("uim") * F.col("uim")
    return s.select(
        *PAIR, "f",
        ratio(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), den).alias("cohmag"),
        F.atan2("im", "re").alias("phase"),
        ratio(F.col("im"), den).alias("icoh"),
        ratio(F.col("re"), den).alias("cre"),
        (F.sqrt(plv2) / k).alias("plv"),
        (F.abs("sg") / k).alias("pli"),
        ratio(F.abs("im"), F.col("aim")).alias("wpli"),
        ((F.col("sg") * F.col("sg") / k - 1) / (k - 1)).alias("dspli"),
        ratio(F.col("im") * F.col("im") - F.col("im2"), F.col("aim") * F.col("aim") - F.col("im2")).alias("dswpli"),
        ((plv2 / k - 1) / (k - 1)).alias("ppc"),
    )


@shared(written=True)
def pair_measures(panel: DataFrame, directed: bool, transform=taper_transform) -> DataFrame:
    """Every measure of every pair and frequency."""
    return measures(pair_spectra(panel, directed, transform))


def _in_band(low: float, high: float) -> Column:
    return (F.col("f") > low) & (F.col("f") < high)


def band_stats(m: DataFrame, names: list[str]) -> DataFrame:
    """Mean and maximum over each band."""
    aggs, stats = [], {}
    for name in names:
        for tag, (low, high) in BANDS.items():
            inside = F.when(_in_band(low, high), F.col(name))
            for how, fn in (("mean", F.avg), ("max", F.max)):
                label = f"{name}_multitaper_{how}_fs-1_{tag}"
                aggs.append(fn(inside).alias(label))
                stats[label] = F.col(label)
    return melt_stats(m.groupBy(*PAIR).agg(*aggs), stats)


def _undirected(name: str):
    def fn(panel: DataFrame) -> DataFrame:
        return band_stats(measures(pair_spectra(panel, False)), [name])

    fn.__doc__ = f"Band mean and maximum of {name}."
    return fn


UNDIRECTED = ("cohmag", "phase", "icoh", "plv", "pli", "wpli", "dspli", "dswpli", "ppc")
spi_cohmag, spi_phase, spi_icoh, spi_plv, spi_pli, spi_wpli, spi_dspli, spi_dswpli, spi_ppc = (_undirected(n) for n in UNDIRECTED)


def slope_index(m: DataFrame, stem: str, how: tuple[str, ...]) -> DataFrame:
    """Phase slope index: imaginary part of conj(C(f)) * C(next f) over the band."""
    pair = Window.partitionBy(*PAIR).orderBy("f")  # a pair has a handful of frequencies
    nxt = m.select(*PAIR, "f", "cre", "icoh", F.lead("cre").over(pair).alias("cre1"), F.lead("icoh").over(pair).alias("im1"), F.lead("f").over(pair).alias("f1"))
    term = F.col("cre") * F.col("im1") - F.col("icoh") * F.col("cre1")
    aggs, stats = [], {}
    for tag, (low, high) in BANDS.items():
        inside = F.when(_in_band(low, high) & (F.col("f1") < high), term)
        for h in how:
            label = stem.format(how=h, band=tag)
            aggs.append((F.max(inside) if h == "max" else F.sum(inside)).alias(label))
            stats[label] = F.col(label)
    return melt_stats(nxt.groupBy(*PAIR).agg(*aggs), stats)


def spi_psi(panel: DataFrame) -> DataFrame:
    return slope_index(pair_measures(panel, True), "psi_multitaper_{how}_fs-1_{band}", ("mean",))


def spi_psi_wavelet(panel: DataFrame) -> DataFrame:
    m = measures(pair_spectra(panel, True, wavelet_transform))
    return slope_index(m, "psi_wavelet_{how}_fs-1_{band}_{how}", ("mean", "max"))


def spi_gd(panel: DataFrame) -> DataFrame:
    """Group delay: slope of phase over frequency, in samples."""
    m = pair_measures(panel, True)
    aggs, stats = [], {}
    for tag, (low, high) in BANDS.items():
        label = f"gd_multitaper_delay_fs-1_{tag}"
        ok = _in_band(low, high)
        n, f, p = F.count(F.when(ok, 1)), F.when(ok, F.col("f")), F.when(ok, F.col("phase"))
        slope = ratio(n * F.sum(f * p) - F.sum(f) * F.sum(p), n * F.sum(f * f) - F.sum(f) * F.sum(f))
        aggs.append((slope / (2 * np.pi)).alias(label))
        stats[label] = F.col(label)
    return melt_stats(m.groupBy(*PAIR).agg(*aggs), stats)


# ---- power envelopes -------------------------------------------------------------------------


def _analytic(m: np.ndarray) -> list:
    n = m.shape[1]
    spec = np.fft.fft(m, axis=1)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    a = np.fft.ifft(spec * gain, axis=1)
    return [{"re": v.real, "im": v.imag} for v in a]


@F.pandas_udf(SIGNAL)
def analytic_signal(values: pd.Series) -> pd.DataFrame:
    return _by_length(values, _analytic, SIGNAL.names)


def spi_pec(panel: DataFrame) -> DataFrame:
    """Correlation of power envelopes, plain or with the in-phase part removed first."""
    series = series_arrays(panel)
    ready = join_series(series.select("sample_id", "node", "blk", F.xxhash64("ts").alias("steps"), analytic_signal("vs").alias("h")), False)
    alike = ready.where("steps_a = steps_b").select(*PAIR, F.col("h_a").alias("a"), F.col("h_b").alias("b"))
    # series with differing steps are cut to the common ones first
    apart = join_series(series.withColumn("steps", F.xxhash64("ts")), False).where("steps_a <> steps_b").select(*PAIR, *aligned())
    both = alike.unionByName(apart.select(*PAIR, analytic_signal("x").alias("a"), analytic_signal("y").alias("b")))
    pts = both.select(*PAIR, F.inline(F.arrays_zip(F.col("a.re").alias("ar"), F.col("a.im").alias("ai"), F.col("b.re").alias("br"), F.col("b.im").alias("bi"))))
    ea = F.sqrt(F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai"))
    eb = F.sqrt(F.col("br") * F.col("br") + F.col("bi") * F.col("bi"))
    cross = F.abs(F.col("bi") * F.col("ar") - F.col("br") * F.col("ai"))
    env = pts.select(*PAIR, ea.alias("ea"), eb.alias("eb"), ratio(cross, ea).alias("oa"), ratio(cross, eb).alias("ob"))

    def log2(c: str) -> Column:
        return F.when(F.col(c) > 1e-12, 2 * F.ln(c))

    r = env.groupBy(*PAIR).agg(
        pearson(F.col("ea"), F.col("eb")).alias("plain"),
        ((pearson(F.col("ea"), F.col("oa")) + pearson(F.col("eb"), F.col("ob"))) / 2).alias("orth"),
        pearson(log2("ea"), log2("eb")).alias("log"),
        ((pearson(log2("ea"), log2("oa")) + pearson(log2("eb"), log2("ob"))) / 2).alias("orth_log"),
    )
    return melt_stats(
        r,
        {
            "pec": F.col("plain"),
            "pec_orth": F.col("orth"),
            "pec_log": F.col("log"),
            "pec_orth_log": F.col("orth_log"),
            "pec_orth_abs": F.abs("orth"),
            "pec_orth_log_abs": F.abs("orth_log"),
        },
    )


# ---- parametric spectral Granger causality ---------------------------------------------------


def _var_fit(x: np.ndarray, y: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares bivariate autoregression: coefficients (b, 2, order, 2) and residual covariance."""
    b, n = x.shape
    z = np.stack([x, y], axis=2)
    past = np.concatenate([z[:, order - k : n - k] for k in range(1, order + 1)], axis=2)
    now = z[:, order:]
    gram = np.swapaxes(past, 1, 2) @ past
    coef = np.linalg.pinv(gram) @ (np.swapaxes(past, 1, 2) @ now)
    res = now - past @ coef
    return coef.reshape(b, order, 2, 2), np.swapaxes(res, 1, 2) @ res / (n - order)


def _granger_spectrum(coef: np.ndarray, cov: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Influence of the first series on the second at each frequency."""
    order = coef.shape[1]
    phase = np.exp(-2j * np.pi * f[:, None] * np.arange(1, order + 1)[None])
    a = np.eye(2)[None, None] - np.einsum("fk,bkij->bfji", phase, coef)
    h = np.linalg.inv(a)
    s = h @ cov[:, None] @ np.conj(np.swapaxes(h, 2, 3))
    syy = s[:, :, 1, 1].real
    own = cov[:, 0, 0] - cov[:, 0, 1] ** 2 / cov[:, 1, 1]
    rest = syy - own[:, None] * np.abs(h[:, :, 1, 0]) ** 2
    return np.log(syy / np.where(rest > 0, rest, np.nan))


def spectral_granger(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    b, n = x.shape
    f = np.arange(1, 64) / 128
    by_order = {}
    bic = []
    for order in [*range(1, 11), 20]:
        if n - order < 4 * order + 2:
            by_order[order] = np.full((b, len(f)), np.nan)
            score = np.full(b, np.inf)
        else:
            coef, cov = _var_fit(x, y, order)
            det = np.linalg.det(cov)
            ok = det > 1e-12
            by_order[order] = np.where(ok[:, None], _granger_spectrum(coef, np.where(ok[:, None, None], cov, np.eye(2)), f), np.nan)
            score = np.where(ok, (n - order) * np.log(np.where(ok, det, 1.0)) + 4 * order * np.log(n - order), np.inf)
        if order <= 10:
            bic.append(score)
    best = np.argmin(np.stack(bic, axis=1), axis=1) + 1
    stack = np.stack([by_order[o] for o in range(1, 11)], axis=1)
    picked = {"1": by_order[1], "20": by_order[20], "None": stack[np.arange(b), best - 1]}
    out = {}
    for order, g in picked.items():
        for tag, (low, high) in BANDS.items():
            part = g[:, (f > low) & (f < high)]
            out[f"mean|{tag}|{order}"] = part.mean(axis=1)
            out[f"max|{tag}|{order}"] = part.max(axis=1)
    return out


SGC = [f"{h}|{t}|{o}" for o in ("1", "20", "None") for t in BANDS for h in ("mean", "max")]


def spi_sgc_parametric(panel: DataFrame) -> DataFrame:
    m = map_arrays(grid_arrays(panel, True), PAIR, ["x", "y"], spectral_granger, SGC, power=1)
    names = {}
    for c in SGC:
        how, tag, order = c.split("|")
        names[f"sgc_parametric_{how}_fs-1_{tag}_order-{order}"] = F.col(f"`{c}`")
    return melt_stats(m, names)


# ---- spectral Granger causality without a model ----------------------------------------------


def factor_spectra(s: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum-phase factors of spectral matrices on the whole circle of frequencies: ``s = h cov h*`` with ``h`` of stacks (b, n, 2, 2), ``cov`` (b, 2, 2), and which stacks converged.

    Newton's iteration: the correction of a factor is computed by frequency and cut to the causal half of its Fourier series by time.
    """
    b, n = s.shape[:2]
    eye = np.eye(2)
    start = np.linalg.cholesky(s.mean(axis=1).real)  # of lag 0
    psi = np.broadcast_to(start[:, None], s.shape).astype(complex)
    done = np.zeros(b, bool)
    for _ in range(rounds):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        inv = np.linalg.inv(psi[live])
        gap = inv @ s[live] @ np.conj(np.swapaxes(inv, 2, 3)) + eye
        lags = np.fft.ifft(gap, axis=1)
        lags[:, 0] = np.triu(lags[:, 0].real) - np.einsum("bii->bi", lags[:, 0].real)[:, :, None] * eye / 2
        if n % 2 == 0:
            lags[:, n // 2] /= 2
        lags[:, n // 2 + 1 :] = 0
        new = psi[live] @ np.fft.fft(lags, axis=1)
        moved = np.abs(new - psi[live]).max(axis=(1, 2, 3)) / np.abs(new).max(axis=(1, 2, 3))
        psi[live] = new
        done[live] = moved < tol
    first = np.fft.ifft(psi, axis=1)[:, 0].real
    return psi @ np.linalg.inv(first)[:, None], first @ np.swapaxes(first, 1, 2), done


def multitaper_matrices(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spectral matrices (b, n, 2, 2) of pairs of series at all n frequencies of the circle.

    Averaged over the root of n tapers, from ``TAPERS`` to ``MOST_TAPERS``: a log ratio of noisy spectra would be too high.
    """
    n = x.shape[1]
    z, k = np.stack([x, y], axis=1), min(max(TAPERS, round(n**0.5)), MOST_TAPERS)
    s = np.zeros((len(x), n, 2, 2), complex)
    for i in range(1, k + 1):
        spec = np.fft.fft(z * sine_tapers(n, i, i), axis=2)
        s += np.einsum("bif,bjf->bfij", spec, np.conj(spec)) / k
    return s


def nonparametric_granger(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Band mean and maximum of the influence of each series on the other."""
    s = multitaper_matrices(x, y)
    f = np.arange(x.shape[1]) / x.shape[1]
    out = {k: np.full(len(x), np.nan) for k in NPG}
    det = (s[:, :, 0, 0] * s[:, :, 1, 1] - s[:, :, 0, 1] * s[:, :, 1, 0]).real
    whole = np.flatnonzero((det > 1e-10 * (s[:, :, 0, 0] * s[:, :, 1, 1]).real).all(axis=1))  # channels that determine each other have no factor
    if not len(whole):
        return out
    h, cov, done = factor_spectra(s[whole])
    if not done.all():
        raise ArithmeticError(f"no convergence of {int((~done).sum())} spectral factors")
    for way, (i, j) in {"ab": (0, 1), "ba": (1, 0)}.items():
        own = cov[:, i, i] - cov[:, i, j] ** 2 / cov[:, j, j]
        power = s[whole][:, :, j, j].real
        rest = power - own[:, None] * np.abs(h[:, :, j, i]) ** 2
        g = np.log(power / np.where(rest > 0, rest, np.nan))
        for tag, (low, high) in BANDS.items():
            part = g[:, (f > low) & (f < high)]
            if part.shape[1]:
                out[f"{way}|mean|{tag}"][whole], out[f"{way}|max|{tag}"][whole] = part.mean(axis=1), part.max(axis=1)
    return out


NPG = [f"{way}|{how}|{tag}" for way in ("ab", "ba") for how in ("mean", "max") for tag in BANDS]


def spi_sgc_nonparametric(panel: DataFrame) -> DataFrame:
    """One factorisation for each pair of channels gives both directions; a pair with a missing step is NULL."""
    m = map_arrays(grid_arrays(panel, False), PAIR, ["x", "y"], nonparametric_granger, NPG, power=1)
    ways = []
    for way, (a, b) in {"ab": ("node_from", "node_to"), "ba": ("node_to", "node_from")}.items():
        values = [F.col(f"`{way}|{how}|{tag}`").alias(f"{how}|{tag}") for how in ("mean", "max") for tag in BANDS]
        ways.append(F.struct(F.col(a).alias("node_from"), F.col(b).alias("node_to"), *values))
    both = m.select("sample_id", F.inline(F.array(*ways)))
    return melt_stats(both, {f"sgc_nonparametric_{how}_fs-1_{tag}": F.col(f"`{how}|{tag}`") for how in ("mean", "max") for tag in BANDS})
