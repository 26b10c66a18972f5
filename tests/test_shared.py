"""Running all statistics together: shared tables and joint passes change no value."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairspan.functions.batches import map_arrays
from pairspan.operators.pairs import PAIR, grid_arrays, pair_arrays
from pairspan.operators.sets import union_many
from pairspan.operators.shared import active, sharing
from pairspan.plans import catalog


def values(df):
    return {(r.spi, r.sample_id, r.node_from, r.node_to): r.value for r in df.collect()}


def test_all_families_together_equal_single_runs(spark, panel):
    together = values(catalog.spi_all(panel))
    single = values(union_many([catalog.FAMILIES[f][0](panel) for f in catalog.FAMILIES]))
    assert set(together) == set(single)
    for k, v in single.items():
        assert together[k] == (pytest.approx(v, abs=1e-9, rel=1e-7) if v is not None else None), k
    assert active() is None


def test_each_kind_of_table_is_made_and_passed_once(panel):
    with sharing(panel) as tables:
        for f in catalog.FAMILIES.values():
            f[0](panel)
        kinds = {k for k in tables.kernels}
        n = sum(len(k) for k in tables.kernels.values())
        assert {k[0] for k in kinds} == {"pair_arrays", "grid_arrays"}
        assert len(kinds) <= 8 < 20 <= n  # tables by direction and value, kernels of all families


def test_kernels_learned_first_then_answered(panel):
    def double(x, y):
        return {"v": 2 * x.sum(1)}

    plain = sorted(tuple(r) for r in map_arrays(pair_arrays(panel), PAIR, ["x", "y"], double, ["v"]).collect())
    with sharing(panel) as tables:
        first = map_arrays(pair_arrays(panel), PAIR, ["x", "y"], double, ["v"])
        map_arrays(pair_arrays(panel), PAIR, ["y"], lambda y: {"w": y.min(1)}, ["w"])
        assert first.where("v IS NOT NULL").count() == 0 and first.columns == [*PAIR, "v"]
        assert pair_arrays(panel) is pair_arrays(panel) and grid_arrays(panel) is not grid_arrays(panel, True)
        tables.run()
        again = map_arrays(pair_arrays(panel), PAIR, ["x", "y"], double, ["v"])
        assert sorted(tuple(r) for r in again.collect()) == plain
        with pytest.raises(RuntimeError):
            map_arrays(pair_arrays(panel), PAIR, ["x", "y"], double, ["v"])
    other = panel.where(F.col("sample_id") == "s1")
    with sharing(panel):
        assert map_arrays(pair_arrays(other), PAIR, ["x", "y"], double, ["v"]).where("v IS NOT NULL").count() == 3


def test_statistics_without_kernels_are_built_once(panel, monkeypatch):
    calls = {}

    def counted(name, fn):
        def call(p):
            calls[name] = calls.get(name, 0) + 1
            return fn(p)

        return call

    names = ["cov", "cov_oas", "prec", "kendall", "cds"]
    monkeypatch.setattr(catalog, "FAMILIES", {n: (counted(n, catalog.FAMILIES[n][0]), catalog.FAMILIES[n][1]) for n in names})
    assert {r.spi for r in catalog.spi_all(panel).select("spi").distinct().collect()} >= {"kendalltau", "cds"}
    assert calls == {"cov": 1, "cov_oas": 1, "prec": 1, "kendall": 2, "cds": 1}
