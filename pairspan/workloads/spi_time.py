"""Time-domain pair statistics on the event panel, each against its definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairspan import fixtures as fx
from pairspan.functions.numeric import rounded
from pairspan.spi import barycentre, basic, causal, distance, infotheory, integration, local, process, robust, sparse
from pairspan.workloads.registry import query
from pairspan.workloads.sqltext import EV, PD, PU, r6, with_

KEYS = "sample_id, node_from, node_to"


def add(name: str, fn, sql: str | None = None, panel=fx.event_z) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(panel(spark, sf)).withColumn("value", rounded("value"))

    query(name, sql)(run)


def melt(stats: dict[str, str], source: str) -> str:
    """SQL in long form: one SELECT per statistic over ``source``."""
    return " UNION ALL ".join(f"SELECT '{n}' AS spi, {KEYS}, {r6(e, 'value')} FROM {source}" for n, e in stats.items())


# ---- linear ----------------------------------------------------------------------------------

_MOM = "mom AS (SELECT sample_id, node_from, node_to, count(*) AS n, sum(x*x) AS sxx, sum(y*y) AS syy, sum(x*y) AS sxy, corr(x, y) AS r FROM pu GROUP BY 1, 2, 3)"
_SHRINK = """cellv AS (SELECT a.sample_id, a.node AS i, b.node AS j, sum(a.z * b.z) / 30 AS s FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.t = b.t GROUP BY 1, 2, 3),
q AS (SELECT sample_id, sum(v * v) AS q2 FROM (SELECT sample_id, t, sum(z * z) AS v FROM z GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT c.sample_id, count(DISTINCT i) AS p, sum(CASE WHEN i = j THEN s END) AS tr, sum(s * s) AS s2, any_value(q2) AS q2 FROM cellv c JOIN q ON q.sample_id = c.sample_id GROUP BY 1),
rho AS (SELECT sample_id,
  least(1.0, (s2/(p*p) + (tr/p)*(tr/p)) / nullif(31 * (s2/(p*p) - (tr/p)*(tr/p)/p), 0)) AS oas,
  least((s2 - p*(tr/p)*(tr/p))/p, (q2/30 - s2)/(p*30)) / nullif((s2 - p*(tr/p)*(tr/p))/p, 0) AS lw FROM g)"""
_SH = f"{PU}, {_MOM}, {_SHRINK}"

add("spi_cov", basic.spi_cov, with_(PU, f", {_MOM} " + melt({"cov_EmpiricalCovariance": "r", "cov-sq_EmpiricalCovariance": "r * r"}, "mom")))
add("spi_cov_shrunk", basic.spi_cov_shrunk, with_(PU, f", {_MOM} " + melt({"cov_ShrunkCovariance": "0.9 * r", "cov-sq_ShrunkCovariance": "0.81 * r * r"}, "mom")))
for _n, _c in (("OAS", "oas"), ("LedoitWolf", "lw")):
    _v = f"(1 - {_c}) * sxy / 30"
    add(
        f"spi_cov_{_n.lower()}",
        getattr(basic, f"spi_cov_{_n.lower()}"),
        with_(_SH, melt({f"cov_{_n}": _v, f"cov-sq_{_n}": f"({_v}) * ({_v})"}, "(SELECT * FROM mom JOIN rho USING (sample_id))")),
    )
add("spi_prec", basic.spi_prec)
add("spi_graphical_lasso", sparse.spi_graphical_lasso)
add("spi_robust", robust.spi_robust, panel=fx.order_z)


@query(
    "fold_moments",
    with_(
        EV,
        f"""SELECT a.sample_id, a.node AS node_from, b.node AS node_to, CAST(floor(a.t * 5 / 30.0) AS INTEGER) AS fold, count(*) AS n, {r6('sum(a.z)', 'sx')}, {r6('sum(b.z)', 'sy')}, {r6('sum(a.z * b.z)', 'sxy')}
FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.t = b.t AND a.node <= b.node WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY 1, 2, 3, 4""",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Moments that cross-validated covariances are fitted from."""
    return sparse.fold_moments(fx.event_z(spark, sf)).withColumns({k: rounded(k) for k in ("sx", "sy", "sxy")})


_RANK = """rk AS (SELECT sample_id, node, t, rank() OVER (PARTITION BY sample_id, node ORDER BY signal)
  + (count(*) OVER (PARTITION BY sample_id, node, signal) - 1) / 2.0 AS r FROM ev),
sp AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, corr(a.r, b.r) AS r FROM rk a JOIN rk b ON a.sample_id = b.sample_id AND a.t = b.t AND a.node < b.node GROUP BY 1, 2, 3)"""
add("spi_spearman", basic.spi_spearman, with_(EV, f", {_RANK} " + melt({"spearmanr": "r", "spearmanr-sq": "r * r"}, "sp")))

_TAU = """su AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, a.t, a.signal AS x, b.signal AS y FROM ev a JOIN ev b ON a.sample_id = b.sample_id AND a.t = b.t WHERE a.node < b.node),
kt AS (SELECT a.sample_id, a.node_from, a.node_to, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(CAST(nullif(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y))), 0) AS DOUBLE)) AS r
 FROM su a JOIN su b ON a.sample_id = b.sample_id AND a.node_from = b.node_from AND a.node_to = b.node_to GROUP BY 1, 2, 3)"""
add("spi_kendall", basic.spi_kendall, with_(EV, f", {_TAU} " + melt({"kendalltau": "r", "kendalltau-sq": "r * r"}, "kt")))

_XC = """xc AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, b.t - a.t AS lag, sum(a.z * b.z) / 30 AS c FROM z a JOIN z b
  ON a.sample_id = b.sample_id AND a.node < b.node AND abs(a.t - b.t) < 7.5 GROUP BY 1, 2, 3, 4),
xs AS (SELECT sample_id, node_from, node_to, max(c) FILTER (abs(c) > 1.96 / sqrt(30)) AS ms, max(c * c) FILTER (abs(c) > 1.96 / sqrt(30)) AS ms2,
  avg(c) FILTER (abs(c) > 1.96 / sqrt(30)) AS us, avg(c * c) FILTER (abs(c) > 1.96 / sqrt(30)) AS us2, avg(c) AS ua, avg(c * c) AS ua2 FROM xc GROUP BY 1, 2, 3)"""
add(
    "spi_xcorr",
    basic.spi_xcorr,
    with_(EV, f", {_XC} " + melt({"xcorr_max_sig-True": "ms", "xcorr-sq_max_sig-True": "ms2", "xcorr_mean_sig-True": "us", "xcorr-sq_mean_sig-True": "us2", "xcorr_mean_sig-False": "ua", "xcorr-sq_mean_sig-False": "ua2"}, "xs")),
)

# ---- distance --------------------------------------------------------------------------------

add(
    "spi_pdist",
    distance.spi_pdist,
    with_(
        PU,
        """, d AS (SELECT sample_id, node_from, node_to, sqrt(sum((x-y)*(x-y))) AS e, sum(abs(x-y)) AS c, 1 - sum(x*y)/sqrt(sum(x*x)*sum(y*y)) AS k, max(abs(x-y)) AS h,
        sum(coalesce(abs(x-y)/nullif(abs(x)+abs(y), 0), 0)) AS a, sum(abs(x-y))/nullif(sum(abs(x+y)), 0) AS b FROM pu WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3) """
        + melt({"pdist_euclidean": "e", "pdist_cityblock": "c", "pdist_cosine": "k", "pdist_chebyshev": "h", "pdist_canberra": "a", "pdist_braycurtis": "b"}, "d"),
    ),
)
add(
    "spi_bary_euclidean",
    distance.spi_bary_euclidean,
    with_(
        PU,
        ", d AS (SELECT sample_id, node_from, node_to, avg((x+y)/2) AS a, max((x+y)/2) AS m FROM pu GROUP BY 1, 2, 3) "
        + melt({"bary_euclidean_mean": "a", "bary_euclidean_max": "m", "bary-sq_euclidean_mean": "a*a", "bary-sq_euclidean_max": "m*m"}, "d"),
    ),
)


def _tables(cell: str, extra: str = "", width: str = "") -> str:
    """Per-node T x T table ``k`` with row means (biased) and U-centred rows (unbiased)."""
    return f"""{extra} tab AS (SELECT a.sample_id, a.node, a.t AS i, b.t AS j, {cell} AS k FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.node = b.node {width}),
    cen AS (SELECT sample_id, node, i, j,
      k - avg(k) OVER (PARTITION BY sample_id, node, i) - avg(k) OVER (PARTITION BY sample_id, node, j) + avg(k) OVER (PARTITION BY sample_id, node) AS bi,
      CASE WHEN i = j THEN 0 ELSE o - sum(o) OVER (PARTITION BY sample_id, node, i) / 28 - sum(o) OVER (PARTITION BY sample_id, node, j) / 28
        + sum(o) OVER (PARTITION BY sample_id, node) / (29 * 28) END AS un FROM (SELECT *, CASE WHEN i = j THEN 0 ELSE k END AS o FROM tab)),
    dep AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, sum(a.un * b.un) / nullif(sqrt(sum(a.un * a.un) * sum(b.un * b.un)), 0) AS u,
      sum(a.bi * b.bi) / nullif(sqrt(sum(a.bi * a.bi) * sum(b.bi * b.bi)), 0) AS v
      FROM cen a JOIN cen b ON a.sample_id = b.sample_id AND a.i = b.i AND a.j = b.j AND a.node < b.node GROUP BY 1, 2, 3)"""


add("spi_dcorr", distance.spi_dcorr, with_(EV, ", " + _tables("abs(a.z - b.z)") + " " + melt({"dcorr": "u", "dcorr_biased": "v"}, "dep")))
add(
    "spi_hsic",
    distance.spi_hsic,
    with_(
        EV,
        ", "
        + _tables(
            "exp(-(a.z - b.z) * (a.z - b.z) / (2 * w.w * w.w))",
            "wid AS (SELECT a.sample_id, a.node, median(abs(a.z - b.z)) AS w FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.node = b.node AND a.t < b.t GROUP BY 1, 2 HAVING median(abs(a.z - b.z)) > 0),",
            "JOIN wid w ON w.sample_id = a.sample_id AND w.node = a.node",
        )
        + " "
        + melt({"hsic": "u", "hsic_biased": "v"}, "(SELECT p.sample_id, p.node_from, p.node_to, u, v FROM (SELECT DISTINCT sample_id, node_from, node_to FROM pu) p LEFT JOIN dep USING (sample_id, node_from, node_to))"),
    ).replace(EV.strip(), PU.strip()),
)
_LAGGED = """, lt AS (SELECT a.sample_id, a.node, lag, side, 30 - lag AS n, a.t - side * lag AS i, b.t - side * lag AS j, abs(a.z - b.z) AS o FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.node = b.node
  CROSS JOIN range(11) l(lag) CROSS JOIN range(2) s(side) WHERE least(a.t, b.t) >= side * lag AND greatest(a.t, b.t) - side * lag < 30 - lag),
lr AS (SELECT sample_id, node, lag, side, i, sum(o) AS r FROM lt GROUP BY 1, 2, 3, 4, 5), la AS (SELECT sample_id, node, lag, side, sum(r) AS total FROM lr GROUP BY 1, 2, 3, 4),
lu AS (SELECT lt.*, CASE WHEN lt.i = lt.j THEN 0 ELSE o - p.r / (n - 2) - q.r / (n - 2) + total / ((n - 1) * (n - 2)) END AS un FROM lt
  JOIN lr p ON p.sample_id = lt.sample_id AND p.node = lt.node AND p.lag = lt.lag AND p.side = lt.side AND p.i = lt.i
  JOIN lr q ON q.sample_id = lt.sample_id AND q.node = lt.node AND q.lag = lt.lag AND q.side = lt.side AND q.i = lt.j
  JOIN la ON la.sample_id = lt.sample_id AND la.node = lt.node AND la.lag = lt.lag AND la.side = lt.side),
ld AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, a.lag, count(a.o * b.o) AS held, sum(a.un * b.un) AS ab, sum(a.un * a.un) AS aa, sum(b.un * b.un) AS bb
  FROM lu a JOIN lu b ON a.sample_id = b.sample_id AND a.lag = b.lag AND a.i = b.i AND a.j = b.j AND a.side = 0 AND b.side = 1 AND a.node < b.node GROUP BY 1, 2, 3, 4),
lx AS (SELECT sample_id, node_from, node_to, lag, CASE WHEN held = 0 THEN NULL WHEN aa > 1e-12 AND bb > 1e-12 THEN ab / sqrt(aa * bb) ELSE 0 END * (30 - lag) / 30.0 AS v FROM ld),
ls AS (SELECT sample_id, node_from, node_to, sum(v) FILTER (lag <= 1) AS m1, sum(v) AS m10 FROM lx GROUP BY 1, 2, 3) """
add("spi_dcorrx", distance.spi_dcorrx, with_(EV, _LAGGED + melt({"dcorrx_maxlag-1": "m1", "dcorrx_maxlag-10": "m10"}, "ls")))
add("spi_dtw", distance.spi_dtw)
add("spi_softdtw", distance.spi_softdtw)
add("spi_lcss", distance.spi_lcss)

# ---- causal ----------------------------------------------------------------------------------

_SD = "sd AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, a.t, a.signal AS x, b.signal AS y FROM ev a JOIN ev b ON a.sample_id = b.sample_id AND a.t = b.t WHERE a.node <> b.node)"
_CDS = """bn AS (SELECT sample_id, node, t, least(floor((signal - lo) / nullif((hi - lo) / 13, 0)), 12) AS b FROM (SELECT *, min(signal) OVER w AS lo, max(signal) OVER w AS hi FROM ev WINDOW w AS (PARTITION BY sample_id, node))),
cl AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, a.b AS bx, b.b AS by, count(*) AS n FROM bn a JOIN bn b ON a.sample_id = b.sample_id AND a.t = b.t AND a.node <> b.node WHERE a.b IS NOT NULL AND b.b IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY sample_id, node_from, node_to, bx) AS p FROM cl),
nb AS (SELECT sample_id, node_from, node_to, count(DISTINCT bx) AS k FROM cl GROUP BY 1, 2, 3),
py AS (SELECT s.sample_id, s.node_from, s.node_to, s.by, sqrt(greatest(0, sum(p*p)/any_value(k) - (sum(p)/any_value(k)) * (sum(p)/any_value(k)))) AS sd FROM sh s JOIN nb USING (sample_id, node_from, node_to) GROUP BY 1, 2, 3, 4),
cd AS (SELECT sample_id, node_from, node_to, sum(sd) / 13 AS v FROM py GROUP BY 1, 2, 3)"""
add("spi_cds", causal.spi_cds, with_(EV, f", {_CDS} " + melt({"cds": "v"}, "cd")))
_IGCI = f"""{_SD}, ms AS (SELECT *, (x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0) AS p, (y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0) AS q FROM sd WINDOW w AS (PARTITION BY sample_id, node_from, node_to)),
fw AS (SELECT sample_id, node_from, node_to, ln(abs(dq) / abs(dp)) AS s FROM (SELECT *, p - lag(p) OVER w AS dp, q - lag(q) OVER w AS dq FROM ms WINDOW w AS (PARTITION BY sample_id, node_from, node_to ORDER BY p, q)) WHERE dp <> 0 AND dq <> 0),
f AS (SELECT sample_id, node_from, node_to, avg(s) AS s FROM fw GROUP BY 1, 2, 3),
ig AS (SELECT pr.sample_id, pr.node_from, pr.node_to, a.s - b.s AS v FROM (SELECT DISTINCT sample_id, node_from, node_to FROM sd) pr LEFT JOIN f a USING (sample_id, node_from, node_to)
  LEFT JOIN f b ON b.sample_id = pr.sample_id AND b.node_from = pr.node_to AND b.node_to = pr.node_from)"""
add("spi_igci", causal.spi_igci, with_(EV, f", {_IGCI} " + melt({"igci": "v"}, "ig")))
add("spi_reci", causal.spi_reci)
add("spi_ccm", causal.spi_ccm)

# ---- information -----------------------------------------------------------------------------

LN2PIE = "ln(2 * pi() * exp(1))"
_POSITIVE = "CASE WHEN {e} > 0 THEN ln({e}) END"


# harmonic sums for every count that can occur
_PSI = "psi AS (SELECT n, coalesce((SELECT sum(1.0 / i) FROM range(1, 64) r(i) WHERE i < n), 0)::DOUBLE - 0.5772156649015329 AS v FROM range(1, 64) k(n))"


def _entropy_ctes(tag: str, source: str, dims: list[str], kind: str) -> str:
    """H of the listed columns of ``source`` per pair, by 4th neighbour or by box counts."""
    dist = "greatest(" + ", ".join(f"abs(a.{d} - b.{d})" for d in dims) + ")" if len(dims) > 1 else f"abs(a.{dims[0]} - b.{dims[0]})"
    join = f"{source} a JOIN {source} b ON a.sample_id = b.sample_id AND a.node_from = b.node_from AND a.node_to = b.node_to"
    if kind == "kernel":
        return f"""{tag}c AS (SELECT a.sample_id, a.node_from, a.node_to, a.t, avg(CASE WHEN {dist} <= 0.5 THEN 1.0 ELSE 0.0 END) AS p FROM {join} GROUP BY 1, 2, 3, 4),
        {tag} AS (SELECT sample_id, node_from, node_to, -avg(ln(p)) AS h FROM {tag}c GROUP BY 1, 2, 3)"""
    return f"""{tag}k AS (SELECT sample_id, node_from, node_to, t, e, n FROM (SELECT a.sample_id, a.node_from, a.node_to, a.t, {dist} AS e,
          row_number() OVER (PARTITION BY a.sample_id, a.node_from, a.node_to, a.t ORDER BY {dist}) AS rk,
          count(*) OVER (PARTITION BY a.sample_id, a.node_from, a.node_to, a.t) + 1 AS n FROM {join} AND a.t <> b.t) WHERE rk = 4),
        {tag} AS (SELECT sample_id, node_from, node_to, (SELECT v FROM psi WHERE psi.n = any_value(k.n)) - (SELECT v FROM psi WHERE n = 4)
          + {len(dims)} * avg(CASE WHEN e > 0 THEN ln(2 * e) END) AS h FROM {tag}k k GROUP BY 1, 2, 3)"""


def _joint_sql(name: str, conditional: bool) -> str:
    joint = f"0.5 * (2 * {LN2PIE} + {_POSITIVE.format(e='(sxx * syy / (29 * 29) * (1 - r * r))')})"
    own = f"0.5 * ({LN2PIE} + {_POSITIVE.format(e='(sxx / 29)')})"
    parts = [melt({f"{name}_gaussian": f"{joint} - {own}" if conditional else joint}, "mom")]
    ctes = [_MOM, _PSI]
    for kind, label in (("kozachenko", "kozachenko"), ("kernel", "kernel_W-0.5")):
        ctes.append(_entropy_ctes(f"j{kind}", "pu", ["x", "y"], kind))
        if conditional:
            ctes.append(_entropy_ctes(f"o{kind}", "pu", ["x"], kind))
            src = f"(SELECT j.sample_id, j.node_from, j.node_to, j.h - o.h AS v FROM j{kind} j JOIN o{kind} o ON j.sample_id = o.sample_id AND j.node_from = o.node_from AND j.node_to = o.node_to)"
        else:
            src = f"(SELECT *, h AS v FROM j{kind})"
        parts.append(melt({f"{name}_{label}": "v"}, src))
    return with_(PU, ", " + ", ".join(ctes) + " " + " UNION ALL ".join(parts))


add("spi_je", infotheory.spi_je, _joint_sql("je", False))
add("spi_ce", infotheory.spi_ce, _joint_sql("ce", True))


def _terms_sql(family: str, directed: bool) -> dict[str, str]:
    """SQL of the neighbour and box forms of a family given by entropy terms."""
    suffix, blocks = infotheory.TERM_FAMILIES[family]
    stem = family.rstrip("0123456789")
    src = "pd" if directed else "pu"
    out = {}
    for kind, label in (("kozachenko", "kozachenko"), ("kernel", "kernel_W-0.5")):
        ctes, adds = [_PSI], []
        for k, (terms, hist) in enumerate(blocks):
            lags = sorted({lag for _, vs in terms for _, lag in vs})
            cols = ", ".join(f"lag(x, {g}) OVER w AS x{g}, lag(y, {g}) OVER w AS y{g}" for g in lags)
            ctes.append(f"e{k} AS (SELECT * FROM (SELECT sample_id, node_from, node_to, t, {cols} FROM {src} WINDOW w AS (PARTITION BY sample_id, node_from, node_to ORDER BY t)) WHERE t >= {hist})")
            for m, (weight, vs) in enumerate(terms):
                ctes.append(_entropy_ctes(f"h{k}_{m}", f"e{k}", [f"{s}{g}" for s, g in vs], kind))
                adds.append(f"SELECT {KEYS}, {weight} * h AS h FROM h{k}_{m}")
        n = len(blocks) if family in infotheory.AVERAGED else 1
        total = f"tot AS (SELECT {KEYS}, sum(h) / {n} AS v FROM ({' UNION ALL '.join(adds)}) GROUP BY ALL)"
        out[kind] = with_(PD if directed else PU, ", " + ", ".join(ctes) + f", {total} " + melt({f"{stem}_{label}{suffix}": "v"}, "tot"))
    return out


for _fam, _dir in (("cce", True), ("di", True), ("si", False), ("xme1", True)):
    for _kind, _sql in _terms_sql(_fam, _dir).items():
        add(
            f"spi_{_fam}_{_kind}",
            lambda p, f=_fam, d=_dir, k=_kind: infotheory._by_terms(p, f, d, [k]),
            _sql,
        )
add("spi_cce", infotheory.spi_cce)
add("spi_xme", infotheory.spi_xme)
add("spi_di", infotheory.spi_di)
add("spi_si", infotheory.spi_si)


def _mi_sql(stem: str, lag: int) -> str:
    """Neighbour and box mutual information; the exclusion window is found per series."""
    pts = f"(SELECT a.sample_id, a.node AS node_from, b.node AS node_to, b.t, a.z AS x, b.z AS y FROM z a JOIN z b ON a.sample_id = b.sample_id AND b.t = a.t + {lag} WHERE a.node < b.node)"
    acf = """ac AS (SELECT a.sample_id, a.node, b.t - a.t AS l, sum(a.z * b.z) / 29 AS c FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.node = b.node AND b.t >= a.t AND b.t - a.t BETWEEN 1 AND 14 GROUP BY 1, 2, 3),
    dt AS (SELECT sample_id, node, coalesce(min(l) FILTER (c < exp(-1)), 15) AS l FROM ac GROUP BY 1, 2)"""
    dist = "round(greatest(abs(a.x - b.x), abs(a.y - b.y)), 9)"
    far = {"kraskov": "a.t <> b.t", "dce": "abs(a.t - b.t) > greatest(u.l, v.l)"}
    win = " JOIN dt u ON u.sample_id = a.sample_id AND u.node = a.node_from JOIN dt v ON v.sample_id = a.sample_id AND v.node = a.node_to"
    on = "q a JOIN q b ON a.sample_id = b.sample_id AND a.node_from = b.node_from AND a.node_to = b.node_to"
    n = 30 - lag
    ctes = [f"q AS {pts}", acf, _PSI, "gm AS (SELECT sample_id, node_from, node_to, corr(x, y) AS r FROM q GROUP BY 1, 2, 3)"]
    parts = [melt({f"{stem}_gaussian": f"-0.5 * {_POSITIVE.format(e='(1 - r * r)')}"}, "gm")]
    for kind, label in (("kraskov", f"{stem}_kraskov_NN-4"), ("dce", f"{stem}_kraskov_NN-4_DCE")):
        ctes.append(f"""{kind}e AS (SELECT sample_id, node_from, node_to, t, e FROM (SELECT a.sample_id, a.node_from, a.node_to, a.t, {dist} AS e,
          row_number() OVER (PARTITION BY a.sample_id, a.node_from, a.node_to, a.t ORDER BY {dist}) AS rk FROM {on}{win} WHERE {far[kind]}) WHERE rk = 4),
        {kind}n AS (SELECT a.sample_id, a.node_from, a.node_to, a.t, sum(CASE WHEN round(abs(a.x - b.x), 9) < k.e THEN 1 ELSE 0 END) + 1 AS nx, sum(CASE WHEN round(abs(a.y - b.y), 9) < k.e THEN 1 ELSE 0 END) + 1 AS ny
          FROM {on}{win} JOIN {kind}e k ON k.sample_id = a.sample_id AND k.node_from = a.node_from AND k.node_to = a.node_to AND k.t = a.t WHERE {far[kind]} GROUP BY 1, 2, 3, 4),
        {kind}v AS (SELECT c.sample_id, c.node_from, c.node_to, CASE WHEN count(*) = {n} THEN (SELECT v FROM psi WHERE n = 4) + (SELECT v FROM psi WHERE n = {n}) - avg(px.v + py.v) END AS v
          FROM {kind}n c JOIN psi px ON px.n = nx JOIN psi py ON py.n = ny GROUP BY 1, 2, 3)""")
        parts.append(melt({label: "v"}, f"(SELECT g.sample_id, g.node_from, g.node_to, v FROM gm g LEFT JOIN {kind}v USING (sample_id, node_from, node_to))"))
    ctes.append(f"""bx AS (SELECT a.sample_id, a.node_from, a.node_to, a.t, avg(CASE WHEN {dist} <= 0.25 THEN 1.0 ELSE 0.0 END) AS pxy,
      avg(CASE WHEN abs(a.x - b.x) <= 0.25 THEN 1.0 ELSE 0.0 END) AS px, avg(CASE WHEN abs(a.y - b.y) <= 0.25 THEN 1.0 ELSE 0.0 END) AS py FROM {on} GROUP BY 1, 2, 3, 4),
      bv AS (SELECT sample_id, node_from, node_to, avg(ln(pxy / (px * py))) AS v FROM bx GROUP BY 1, 2, 3)""")
    parts.append(melt({f"{stem}_kernel_W-0.25": "v"}, "bv"))
    return with_(EV, ", " + ", ".join(ctes) + " " + " UNION ALL ".join(parts))


add("spi_mi", infotheory.spi_mi, _mi_sql("mi", 0))
add("spi_tlmi", infotheory.spi_tlmi, _mi_sql("tlmi", 1))


def _te_sql() -> str:
    acf = _mi_sql("mi", 0).split("q AS (")[1].split("), ac AS")[1].split("psi AS")[0]
    ctes = ["ac AS" + acf.rstrip().rstrip(","), _PSI]
    parts = []
    ctes.append("""te AS (SELECT * FROM (SELECT sample_id, node_from, node_to, t, y AS y0, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(x, 1) OVER w AS x1 FROM pd
      WINDOW w AS (PARTITION BY sample_id, node_from, node_to ORDER BY t)))""")
    for tag, k, dce, label in (("a", 2, True, "te_kraskov_NN-4_DCE_k-2_kt-1_l-1_lt-1"), ("b", 1, True, "te_kraskov_NN-4_DCE_k-1_kt-1_l-1_lt-1"), ("c", 1, False, "te_kraskov_NN-4_k-1_kt-1_l-1_lt-1")):
        past = "round(greatest(abs(a.y1 - b.y1), abs(a.y2 - b.y2)), 9)" if k == 2 else "round(abs(a.y1 - b.y1), 9)"
        far = "abs(a.t - b.t) > greatest(u.l, v.l)" if dce else "a.t <> b.t"
        on = f"""te a JOIN te b ON a.sample_id = b.sample_id AND a.node_from = b.node_from AND a.node_to = b.node_to AND a.t >= {k} AND b.t >= {k}
          JOIN dt u ON u.sample_id = a.sample_id AND u.node = a.node_from JOIN dt v ON v.sample_id = a.sample_id AND v.node = a.node_to"""
        ctes.append(f"""{tag}d AS (SELECT a.sample_id, a.node_from, a.node_to, a.t, round(abs(a.y0 - b.y0), 9) AS dy, round(abs(a.x1 - b.x1), 9) AS dx, {past} AS dp FROM {on} WHERE {far}),
        {tag}e AS (SELECT sample_id, node_from, node_to, t, e FROM (SELECT sample_id, node_from, node_to, t, greatest(dy, dx, dp) AS e,
          row_number() OVER (PARTITION BY sample_id, node_from, node_to, t ORDER BY greatest(dy, dx, dp)) AS rk FROM {tag}d) WHERE rk = 4),
        {tag}n AS (SELECT d.sample_id, d.node_from, d.node_to, d.t, sum(CASE WHEN greatest(dy, dp) < e THEN 1 ELSE 0 END) + 1 AS ny, sum(CASE WHEN greatest(dx, dp) < e THEN 1 ELSE 0 END) + 1 AS nx,
          sum(CASE WHEN dp < e THEN 1 ELSE 0 END) + 1 AS np FROM {tag}d d JOIN {tag}e e ON d.sample_id = e.sample_id AND d.node_from = e.node_from AND d.node_to = e.node_to AND d.t = e.t GROUP BY 1, 2, 3, 4),
        {tag}v AS (SELECT c.sample_id, c.node_from, c.node_to, CASE WHEN count(*) = {30 - k} THEN (SELECT v FROM psi WHERE n = 4) - avg(py.v + px.v - pp.v) END AS v
          FROM {tag}n c JOIN psi px ON px.n = nx JOIN psi py ON py.n = ny JOIN psi pp ON pp.n = np GROUP BY 1, 2, 3)""")
        parts.append(melt({label: "v"}, f"(SELECT g.sample_id, g.node_from, g.node_to, v FROM (SELECT DISTINCT sample_id, node_from, node_to FROM pd) g LEFT JOIN {tag}v USING (sample_id, node_from, node_to))"))
    return with_(PD, ", " + ", ".join(ctes) + " " + " UNION ALL ".join(parts))


add("spi_te_kraskov", infotheory.spi_te_kraskov, _te_sql())
add(
    "spi_te_kernel",
    infotheory.spi_te_kernel,
    with_(
        PD,
        """, te AS (SELECT * FROM (SELECT sample_id, node_from, node_to, t, y AS y0, lag(y, 1) OVER w AS y1, lag(x, 1) OVER w AS x1 FROM pd WINDOW w AS (PARTITION BY sample_id, node_from, node_to ORDER BY t)) WHERE t >= 1),
    bx AS (SELECT a.sample_id, a.node_from, a.node_to, a.t,
      avg(CASE WHEN greatest(abs(a.y0 - b.y0), abs(a.y1 - b.y1), abs(a.x1 - b.x1)) <= 0.25 THEN 1.0 ELSE 0.0 END) AS p3, avg(CASE WHEN abs(a.y1 - b.y1) <= 0.25 THEN 1.0 ELSE 0.0 END) AS p1,
      avg(CASE WHEN greatest(abs(a.y0 - b.y0), abs(a.y1 - b.y1)) <= 0.25 THEN 1.0 ELSE 0.0 END) AS py, avg(CASE WHEN greatest(abs(a.y1 - b.y1), abs(a.x1 - b.x1)) <= 0.25 THEN 1.0 ELSE 0.0 END) AS px
      FROM te a JOIN te b ON a.sample_id = b.sample_id AND a.node_from = b.node_from AND a.node_to = b.node_to GROUP BY 1, 2, 3, 4),
    bv AS (SELECT sample_id, node_from, node_to, avg(ln(p3 * p1 / (py * px))) AS v FROM bx GROUP BY 1, 2, 3) """
        + melt({"te_kernel_W-0.25_k-1": "v"}, "bv"),
    ),
)


def _symbolic_sql() -> str:
    ctes, parts = [_SD], []
    for k in (1, 10):
        vals = ", ".join(f"{{'v': lag(y, {k - j}) OVER w, 'j': {j}}}" for j in range(k + 1))
        ctes.append(f"""s{k} AS (SELECT * FROM (SELECT sample_id, node_from, node_to, t, list_sort([{vals}]) AS p, sign(lead(y, 1) OVER w - y) >= 0 AS f, sign(x - lag(x, 1) OVER w) >= 0 AS q FROM sd
          WINDOW w AS (PARTITION BY sample_id, node_from, node_to ORDER BY t)) WHERE t >= {k} AND t < 29),
        r{k} AS (SELECT sample_id, node_from, node_to, [e.j for e in p]::VARCHAR AS p, f, q FROM s{k}),
        c{k} AS (SELECT sample_id, node_from, node_to, p, f, q, count(*) AS n FROM r{k} GROUP BY ALL),
        v{k} AS (SELECT sample_id, node_from, node_to, sum(h) / {29 - k} AS v FROM (
          SELECT {KEYS}, n * ln(n) AS h FROM c{k}
          UNION ALL SELECT {KEYS}, m * ln(m) FROM (SELECT {KEYS}, p, sum(n) AS m FROM c{k} GROUP BY ALL)
          UNION ALL SELECT {KEYS}, -m * ln(m) FROM (SELECT {KEYS}, p, f, sum(n) AS m FROM c{k} GROUP BY ALL)
          UNION ALL SELECT {KEYS}, -m * ln(m) FROM (SELECT {KEYS}, p, q, sum(n) AS m FROM c{k} GROUP BY ALL)) GROUP BY 1, 2, 3)""")
        parts.append(melt({f"te_symbolic_k-{k}_kt-1_l-1_lt-1": "v"}, f"v{k}"))
    return with_(EV, ", " + ", ".join(ctes) + " " + " UNION ALL ".join(parts))


add("spi_te_symbolic", infotheory.spi_te_symbolic, _symbolic_sql())
add(
    "spi_gc_gaussian",
    infotheory.spi_gc_gaussian,
    with_(
        PD,
        """, g AS (SELECT a.sample_id, a.node_from, a.node_to, corr(a.y, b.y) AS a, corr(a.x, b.y) AS b, corr(a.x, a.y) AS c FROM pd a JOIN pd b
      ON a.sample_id = b.sample_id AND a.node_from = b.node_from AND a.node_to = b.node_to AND b.t = a.t + 1 GROUP BY 1, 2, 3) """
        + melt({"gc_gaussian_k-1_kt-1_l-1_lt-1": "0.5 * ln((1 - a*a) * (1 - c*c) / (1 + 2*a*b*c - a*a - b*b - c*c))"}, "g"),
    ),
)
add("spi_gc_gaussian_auto", infotheory.spi_gc_gaussian_auto, panel=fx.ship_z)

add("spi_bary_elastic", barycentre.spi_bary_elastic)

add("spi_te_kraskov_auto", infotheory.spi_te_kraskov_auto)

# ---- Gaussian processes ----------------------------------------------------------------------

add("spi_gpfit", process.spi_gpfit)
add("spi_anm", process.spi_anm)

# ---- neighbourhoods --------------------------------------------------------------------------

for _n in ("mgc", "mgcx", "hhg"):
    add(f"spi_{_n}", getattr(local, f"spi_{_n}"))

# ---- integrated information ------------------------------------------------------------------

add("spi_phi", integration.spi_phi)
_STEP = ", ".join([f"{r6(f'sum({c})', c)}" for c in integration.SIDES] + [f"{r6(f'sum({a} * {b})', f'{a}_{b}')}" for a, b in integration.PRODUCTS])


@query(
    "step_moments",
    with_(
        EV,
        f"""SELECT {KEYS}, count(*) AS n, {_STEP} FROM (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, a.z AS x0, b.z AS y0, a1.z AS x1, b1.z AS y1
FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.t = b.t AND a.node < b.node JOIN z a1 ON a1.sample_id = a.sample_id AND a1.node = a.node AND a1.t = a.t + 1
JOIN z b1 ON b1.sample_id = b.sample_id AND b1.node = b.node AND b1.t = b.t + 1) WHERE x0 + y0 + x1 + y1 IS NOT NULL GROUP BY 1, 2, 3""",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of two channels at a step and the next."""
    m = integration.step_moments(fx.event_z(spark, sf))
    return m.select(*KEYS.split(", "), "n", *[rounded(c).alias(c) for c in m.columns if c not in (*KEYS.split(", "), "n")])
