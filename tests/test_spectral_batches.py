"""Spectral coefficients are made a few series at a time."""

import numpy as np
from pyspark.sql import functions as F

from pairspan.spi import spectral


def test_few_series_at_a_time(spark, monkeypatch):
    rng, most = np.random.default_rng(5), []
    rows = [(f"s{i}", "a", t, float(v)) for i in range(3000) for t, v in enumerate(rng.normal(size=20 + i % 2))]
    rows += [("gap", "a", t, None if t == 3 else 1.0 * t) for t in range(20)] + [("two", "a", t, 1.0 * t) for t in range(2)]
    panel = spark.createDataFrame(rows, "sample_id string, node string, t int, z double").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def counted(m):
        seen.add(1)
        if len(m) > spectral.CELLS // (10 * m.shape[1]):
            raise MemoryError(f"{len(m)} series at once")
        return spectral.taper_transform(m)

    got = {r.sample_id: r.coef for r in spectral.spectral_coefficients(panel, counted).collect()}
    assert len(got) == 3002 and got["gap"] is None and got["two"] is None and seen.value > 2
    for i in (0, 1, 2999):
        x = np.array([r[3] for r in rows if r[0] == f"s{i}"])
        f, c = spectral.taper_transform(x[None])
        assert np.allclose([v.f for v in got[f"s{i}"]], f)
        assert np.allclose([np.array(v.re) + 1j * np.array(v.im) for v in got[f"s{i}"]], c[0])


def test_both_sides_read_one_table(spark, panel):
    """The transform of a pair's two sides runs once: the joined plan holds no Python."""
    plan = spectral.pair_spectra(panel, True)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan
