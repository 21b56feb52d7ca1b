import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session
    return local_session(4, "6g")


@pytest.fixture(scope="session")
def bars(spark):
    """Two irregular minute series with gaps, one much longer than the other."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    parts = []
    for sym, n in (("a", 160), ("b", 37)):
        t = np.sort(rng.choice(np.arange(n * 2), n, replace=False))
        c = 50 + np.cumsum(rng.normal(size=n))
        o = c + rng.normal(scale=0.3, size=n)
        h, lo = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
        v = np.where(rng.random(n) < 0.1, 0.0, rng.integers(1, 100, n)).astype(float)
        parts.append(pd.DataFrame({"symbol": sym, "ts": pd.Timestamp("2026-01-01") + pd.to_timedelta(t, unit="min"),
                                   "open": o, "high": h, "low": lo, "close": c, "volume": v}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def bar_frame(spark, bars):
    return spark.createDataFrame(bars.sample(frac=1.0, random_state=1))  # shuffled input order
