import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pairspan.session import local_session

    return local_session("4", "tests")


@pytest.fixture(scope="session")
def panel(spark):
    """Four samples: ordinary, constant channel, lagged copy, and one that lacks a channel."""
    import numpy as np

    from pairspan.operators.windows import zscore_series

    rng = np.random.default_rng(7)
    rows = []
    for s in ("s1", "s2", "s3", "s4"):
        base = rng.normal(size=40)
        series = {"a": base, "b": rng.normal(size=40), "c": rng.normal(size=40)}
        if s == "s2":
            series["b"] = np.full(40, 3.0)
        if s == "s3":
            series["b"] = np.concatenate([[0.0], base[:-1]])
        if s == "s4":
            del series["c"]
        rows += [(s, n, t, float(v)) for n, vs in series.items() for t, v in enumerate(vs)]
    return zscore_series(spark.createDataFrame(rows, "sample_id string, node string, t int, signal double")).cache()
