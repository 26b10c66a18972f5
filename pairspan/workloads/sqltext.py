"""Shared WITH clauses for the comparison SQL (run by DuckDB on the same tables)."""

EV = """
ev AS (
  SELECT u.sample_id, u.grp, u.subject, n.node, d.t, round(coalesce(b.q, 0.0), 2) AS signal
  FROM (SELECT DISTINCT user_id, CAST(user_id AS VARCHAR) AS sample_id, CAST(user_id % 4 AS VARCHAR) AS grp,
               CAST(user_id % 29 AS VARCHAR) AS subject FROM events) u
  CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS node) n
  CROSS JOIN (SELECT unnest(range(30))::INTEGER AS t) d
  LEFT JOIN (SELECT user_id, event_type, day(ts) - 1 AS t, sum(value) AS q FROM events GROUP BY 1, 2, 3) b
    ON b.user_id = u.user_id AND b.event_type = n.node AND b.t = d.t),
z AS (
  SELECT *, (signal - avg(signal) OVER w) / nullif(stddev_samp(signal) OVER w, 0) AS z
  FROM ev WINDOW w AS (PARTITION BY sample_id, node)),
meta AS (SELECT DISTINCT sample_id, grp, subject FROM ev)
"""

# points of undirected (pu) and directed (pd) pairs
PU = EV + """,
pu AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, a.t, a.z AS x, b.z AS y
       FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.t = b.t WHERE a.node < b.node)
"""
PD = EV + """,
pd AS (SELECT a.sample_id, a.node AS node_from, b.node AS node_to, a.t, a.z AS x, b.z AS y
       FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.t = b.t WHERE a.node <> b.node)
"""

SPI = EV + """,
prs AS (SELECT a.sample_id, a.grp, a.subject, a.node AS node_from, b.node AS node_to,
               avg(a.z * b.z) AS c, avg(abs(a.z - b.z)) AS d
        FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.t = b.t GROUP BY 1, 2, 3, 4, 5),
lagp AS (SELECT a.sample_id, a.grp, a.subject, a.node AS node_from, b.node AS node_to, avg(a.z * b.z) AS c
         FROM z a JOIN z b ON a.sample_id = b.sample_id AND b.t = a.t + 1 GROUP BY 1, 2, 3, 4, 5),
spi AS (SELECT 'cov' AS spi, sample_id, grp, subject, node_from, node_to, c AS value FROM prs
  UNION ALL SELECT 'cityblock', sample_id, grp, subject, node_from, node_to, d FROM prs
  UNION ALL SELECT 'lag1', sample_id, grp, subject, node_from, node_to, c FROM lagp
  UNION ALL SELECT 'constant', sample_id, grp, subject, node_from, node_to, CAST(1 AS DOUBLE) FROM prs
  UNION ALL SELECT 'significant', sample_id, grp, subject, node_from, node_to, c FROM prs
            WHERE abs(c) > 1.96 / sqrt(30) AND node_from <> node_to
  UNION ALL SELECT 'unlisted', sample_id, grp, subject, node_from, node_to, d FROM prs),
spi_info AS (SELECT * FROM (VALUES ('cov', 'Undirected', 'basic', 'M01'), ('cityblock', 'Undirected', 'distance', 'M01'),
  ('lag1', 'Directed', 'basic', 'M02'), ('constant', 'Undirected', 'misc', NULL),
  ('significant', 'Undirected', 'distance', 'M02')) v(spi, directionality, category, module))
"""

SHIP = """
base AS (
  SELECT n_name AS sample_id, r_name AS grp, concat_ws('_', l_returnflag, l_linestatus) AS node,
         (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, sum(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4),
grid AS (
  SELECT s.sample_id, s.grp, n.node, x.t
  FROM (SELECT DISTINCT sample_id, grp FROM base) s
  CROSS JOIN (SELECT unnest(['A_F', 'A_O', 'N_F', 'N_O', 'R_F', 'R_O']) AS node) n
  CROSS JOIN (SELECT unnest(range(84)) AS t) x),
mts AS (
  SELECT g.sample_id, g.grp, g.node, g.t, round(coalesce(b.q, 0.0), 2) AS signal
  FROM grid g LEFT JOIN base b ON g.sample_id = b.sample_id AND g.node = b.node AND g.t = b.t),
mz AS (SELECT *, (signal - avg(signal) OVER w) / nullif(stddev_samp(signal) OVER w, 0) AS z
       FROM mts WINDOW w AS (PARTITION BY sample_id, node))
"""

# accuracy tables: supplier = statistic, line status = problem, year = resample, month = permutation
PERF = """
hit AS (SELECT concat('S', l_suppkey) AS spi, l_linestatus AS problem, year(l_shipdate) AS resample,
               month(l_shipdate) AS perm, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS ok
        FROM lineitem),
acc AS (SELECT spi, problem, resample, avg(ok) AS accuracy FROM hit GROUP BY 1, 2, 3),
nul AS (SELECT spi, problem, perm, avg(ok) AS null_accuracy FROM hit GROUP BY 1, 2, 3),
means AS (SELECT problem, spi, round(avg(accuracy), 9) AS mean_accuracy, round(stddev_samp(accuracy), 9) AS sd_accuracy
          FROM acc GROUP BY 1, 2),
dim AS (SELECT concat('S', s_suppkey) AS spi, CASE WHEN s_acctbal >= 0 THEN r_name END AS category, n_name AS module
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
pooled AS (SELECT problem, round(null_accuracy, 9) AS null_accuracy FROM nul),
pv AS (SELECT m.problem, m.spi, m.mean_accuracy, m.sd_accuracy,
              1 - (SELECT count(*) FROM pooled p WHERE p.problem = m.problem AND m.mean_accuracy > p.null_accuracy)::DOUBLE
                  / (SELECT count(*) FROM pooled p WHERE p.problem = m.problem) AS p_value
       FROM means m),
pvals AS (SELECT *, least(1.0, p_value * count(*) OVER (PARTITION BY problem)) AS p_bonferroni FROM pv)
"""


def r6(expr: str, name: str, digits: int = 6) -> str:
    """Rounded output column, free of negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"
