"""The band as a grouped map over spans of time against all pairs."""

import tracemalloc

import numpy as np
import pytest

from chunkwright.operators import attention


@pytest.mark.parametrize("per", [4, 64])
def test_spans_against_all_pairs(spark, per):
    rng = np.random.default_rng(per)
    rows = [(g, float(t), rng.normal(size=3).tolist()) for g, n in (("a", 150), ("b", 1)) for t in rng.integers(0, 600, n)]
    rows += [("c", 7.0, [1.0, 2.0, 3.0])] * 80  # denser than a span of four rows may be
    got = attention.band_in_groups(spark.createDataFrame(rows, "g string, t double, v array<double>"), "g", "t", "v", per=per).collect()
    unit = [np.array(v) / (np.linalg.norm(v) + 1e-10) for _, _, v in rows]
    want = [(g, t, v, sum(unit[i] @ unit[j] * np.exp(-abs(t - s) / 45) for j, (h, s, _) in enumerate(rows) if h == g and abs(t - s) <= 90)) for i, (g, t, v) in enumerate(rows)]
    assert len(got) == len(want)
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-9) for a, b in zip(sorted(map(tuple, got)), sorted(want), strict=True))


def test_band_holds_tiles_only():
    """4,000 rows within one band took a square of all of them."""
    when, x = np.linspace(0, 90, 4000), np.ones((4000, 2))
    tracemalloc.start()
    attention.band_of(when, x, np.arange(4000), 45.0, 90.0, tile=64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
