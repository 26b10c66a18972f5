"""Frequency-domain and model-fit pair statistics, with SQL that sums cosines and sines directly."""

from __future__ import annotations

from pairspan import fixtures as fx
from pairspan.functions.numeric import rounded
from pairspan.spi import misc, multichannel, spectral
from pairspan.workloads.registry import query
from pairspan.workloads.spi_time import KEYS, add, melt
from pairspan.workloads.sqltext import EV, PD, r6, with_

# Fourier sums of the tapered series: 14 frequencies strictly between 0 and 1/2, 5 tapers
_WAVE = """wave AS (SELECT k, j, t, sqrt(2.0 / 31) * sin(pi() * k * (t + 1) / 31) * cos(2 * pi() * j * t / 30) AS c,
   -sqrt(2.0 / 31) * sin(pi() * k * (t + 1) / 31) * sin(2 * pi() * j * t / 30) AS s
   FROM range(1, 6) a(k), range(1, 15) b(j), range(30) d(t)),
co AS (SELECT sample_id, node, k, j, sum(z * c) AS re, sum(z * s) AS im FROM z JOIN wave USING (t) GROUP BY 1, 2, 3, 4)"""


def _spectra(directed: bool) -> str:
    cond = "a.node <> b.node" if directed else "a.node < b.node"
    return f"""{_WAVE},
cs AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, a.k, a.j, a.re*b.re + a.im*b.im AS re, a.im*b.re - a.re*b.im AS im,
   a.re*a.re + a.im*a.im AS pa, b.re*b.re + b.im*b.im AS pb FROM co a JOIN co b ON a.sample_id = b.sample_id AND a.k = b.k AND a.j = b.j AND {cond}),
ms AS (SELECT sample_id, node_from, node_to, j, j / 30.0 AS f, sqrt(sum(re)*sum(re) + sum(im)*sum(im)) / sqrt(sum(pa)*sum(pb)) AS cohmag, atan2(sum(im), sum(re)) AS phase,
   sum(im) / sqrt(sum(pa)*sum(pb)) AS icoh, sum(re) / sqrt(sum(pa)*sum(pb)) AS cre,
   sqrt(pow(sum(re / sqrt(re*re+im*im)), 2) + pow(sum(im / sqrt(re*re+im*im)), 2)) / 5 AS plv, abs(sum(sign(im))) / 5 AS pli, abs(sum(im)) / sum(abs(im)) AS wpli,
   (pow(sum(sign(im)), 2) / 5 - 1) / 4 AS dspli, (pow(sum(im), 2) - sum(im*im)) / (pow(sum(abs(im)), 2) - sum(im*im)) AS dswpli,
   ((pow(sum(re / sqrt(re*re+im*im)), 2) + pow(sum(im / sqrt(re*re+im*im)), 2)) / 5 - 1) / 4 AS ppc FROM cs GROUP BY 1, 2, 3, 4)"""


_IN = {"fmin-0_fmax-0-5": "j BETWEEN 1 AND 14", "fmin-0_fmax-0-25": "j BETWEEN 1 AND 7", "fmin-0-25_fmax-0-5": "j BETWEEN 8 AND 14"}


def _bands(name: str) -> str:
    cols, stats = [], {}
    for i, (tag, cond) in enumerate(_IN.items()):
        for how, fn in (("mean", "avg"), ("max", "max")):
            cols.append(f"{fn}({name}) FILTER ({cond}) AS v{i}{how}")
            stats[f"{name}_multitaper_{how}_fs-1_{tag}"] = f"v{i}{how}"
    return f", {_spectra(False)}, bd AS (SELECT {KEYS}, {', '.join(cols)} FROM ms GROUP BY 1, 2, 3) " + melt(stats, "bd")


for _n in spectral.UNDIRECTED:
    add(f"spi_{_n}", getattr(spectral, f"spi_{_n}"), with_(EV, _bands(_n)))


@query("spectral_coefficients", with_(EV, f", {_WAVE} SELECT sample_id, node, CAST(k AS INTEGER) AS taper, {r6('j / 30.0', 'f')}, {r6('re', 're')}, {r6('im', 'im')} FROM co"))
def _(spark, sf):
    c = spectral.coefficient_rows(fx.event_z(spark, sf))
    return c.withColumns({n: rounded(n) for n in ("f", "re", "im")})


@query("cross_spectrum", with_(EV, f", {_spectra(False)} SELECT {KEYS}, CAST(k AS INTEGER) AS taper, {r6('j / 30.0', 'f')}, {r6('re', 're')}, {r6('im', 'im')} FROM cs"))
def _(spark, sf):
    c = spectral.cross_spectrum(fx.event_z(spark, sf))
    return c.withColumns({n: rounded(n) for n in ("f", "re", "im")})


_LEAD = "ld AS (SELECT *, cre * lead(icoh) OVER w - icoh * lead(cre) OVER w AS term, lead(j) OVER w AS j1 FROM ms WINDOW w AS (PARTITION BY sample_id, node_from, node_to ORDER BY j))"
_TOP = {"fmin-0_fmax-0-5": 14, "fmin-0_fmax-0-25": 7, "fmin-0-25_fmax-0-5": 14}
_PSI = ", ".join(f"sum(term) FILTER ({c} AND j1 <= {_TOP[t]}) AS v{i}" for i, (t, c) in enumerate(_IN.items()))
add(
    "spi_psi",
    spectral.spi_psi,
    with_(EV, f", {_spectra(True)}, {_LEAD}, bd AS (SELECT {KEYS}, {_PSI} FROM ld GROUP BY 1, 2, 3) " + melt({f"psi_multitaper_mean_fs-1_{t}": f"v{i}" for i, t in enumerate(_IN)}, "bd")),
)
_GD = ", ".join(f"regr_slope(phase, f) FILTER ({c}) / (2 * pi()) AS v{i}" for i, c in enumerate(_IN.values()))
add(
    "spi_gd",
    spectral.spi_gd,
    with_(EV, f", {_spectra(True)}, bd AS (SELECT {KEYS}, {_GD} FROM ms GROUP BY 1, 2, 3) " + melt({f"gd_multitaper_delay_fs-1_{t}": f"v{i}" for i, t in enumerate(_IN)}, "bd")),
)

# Morlet coefficients at f = m / 22; the band of a scale follows from m
_MORLET = """wv AS (SELECT m, g, cos(2*pi()*m/22*g) * exp(-g*g / (2*pow(6/(2*pi()*m/22), 2))) / sqrt(6/(2*pi()*m/22)) AS c,
   -sin(2*pi()*m/22*g) * exp(-g*g / (2*pow(6/(2*pi()*m/22), 2))) / sqrt(6/(2*pi()*m/22)) AS s FROM range(1, 11) a(m), range(-29, 30) b(g)),
mc AS (SELECT sample_id, node, m AS j, u.u AS k, sum(z * c) AS re, sum(z * s) AS im FROM z, range(30) u(u), wv WHERE wv.g = u.u - z.t GROUP BY 1, 2, 3, 4),
cs AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, a.j, a.re*b.re + a.im*b.im AS re, a.im*b.re - a.re*b.im AS im, a.re*a.re + a.im*a.im AS pa, b.re*b.re + b.im*b.im AS pb
   FROM mc a JOIN mc b ON a.sample_id = b.sample_id AND a.j = b.j AND a.k = b.k AND a.node <> b.node),
ms AS (SELECT sample_id, node_from, node_to, j, sum(im) / sqrt(sum(pa)*sum(pb)) AS icoh, sum(re) / sqrt(sum(pa)*sum(pb)) AS cre FROM cs GROUP BY 1, 2, 3, 4)"""
_WIN = {"fmin-0_fmax-0-5": (1, 10), "fmin-0_fmax-0-25": (1, 5), "fmin-0-25_fmax-0-5": (6, 10)}
_WCOLS = ", ".join(f"{fn}(term) FILTER (j >= {a} AND j1 <= {b}) AS v{i}{how}" for i, (a, b) in enumerate(_WIN.values()) for how, fn in (("mean", "sum"), ("max", "max")))
add(
    "spi_psi_wavelet",
    spectral.spi_psi_wavelet,
    with_(
        EV,
        f", {_MORLET}, {_LEAD}, bd AS (SELECT {KEYS}, {_WCOLS} FROM ld GROUP BY 1, 2, 3) "
        + melt({f"psi_wavelet_{how}_fs-1_{t}_{how}": f"v{i}{how}" for i, t in enumerate(_WIN) for how in ("mean", "max")}, "bd"),
    ),
)
add("spi_pec", spectral.spi_pec)
add("spi_sgc_parametric", spectral.spi_sgc_parametric, panel=fx.ship_z)
add("spi_sgc_nonparametric", spectral.spi_sgc_nonparametric)


@query(
    "lag_moments",
    with_(
        EV,
        f"""SELECT a.sample_id, a.node AS node_from, b.node AS node_to, k AS lag, {r6('coalesce(sum(a.z * b.z), 0)', 's')}, count(a.z * b.z) AS n
FROM z a CROSS JOIN range(11) l(k) JOIN z b ON a.sample_id = b.sample_id AND b.t = a.t + k GROUP BY 1, 2, 3, 4""",
    ),
)
def _(spark, sf):
    return multichannel.lag_moments(fx.event_z(spark, sf), block=16).withColumn("s", rounded("s"))


for _n in multichannel.MEASURES:
    add(f"spi_{_n}", getattr(multichannel, f"spi_{_n}"))

_SOFT = "sign(sxy / n) * greatest(abs(sxy / n) - {b}, 0)"
_BETA = {
    "Ridge": "sxy / (sxx + 1)", "Lasso": f"({_SOFT.format(b=1.0)}) / (sxx / n)", "ElasticNet": f"({_SOFT.format(b=0.5)}) / (sxx / n + 0.5)",
    "SGDRegressor": "sxy / (sxx + n * 1e-4::DOUBLE)", "BayesianRidge": "sxy / (sxx + weight / noise)",
}
_LEFT = "greatest(syy - 2 * (sxy / (sxx + weight / noise)) * sxy + pow(sxy / (sxx + weight / noise), 2) * sxx, 0)"
add(
    "spi_lmfit",
    misc.spi_lmfit,
    with_(
        "RECURSIVE " + PD.strip(),
        f""", m0 AS (SELECT sample_id, node_from, node_to, count(*) AS n, sum(x*x) AS sxx, sum(y*y) AS syy, sum(x*y) AS sxy FROM pd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3),
it AS (SELECT *, 0 AS round, n / (syy + 1e-12::DOUBLE) AS noise, 1.0::DOUBLE AS weight FROM m0
  UNION ALL SELECT sample_id, node_from, node_to, n, sxx, syy, sxy, round + 1,
    (n - noise * sxx / (weight + noise * sxx) + 2e-6::DOUBLE) / ({_LEFT} + 2e-6::DOUBLE), (noise * sxx / (weight + noise * sxx) + 2e-6::DOUBLE) / (pow(sxy / (sxx + weight / noise), 2) + 2e-6::DOUBLE)
    FROM it WHERE round < 300),
mom AS (SELECT * FROM it WHERE round = 300) """
        + melt({f"lmfit_{k}": f"(syy - 2 * ({b}) * sxy + ({b}) * ({b}) * sxx) / n" for k, b in _BETA.items()}, "mom"),
    ),
)
add("spi_coint_johansen", misc.spi_coint_johansen, panel=fx.ship_z)
add("spi_coint_aeg", misc.spi_coint_aeg, panel=fx.ship_z)
