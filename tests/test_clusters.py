"""k-means against numpy over all rows at once, and the same tokens at any number of partitions."""

import numpy as np
import pyarrow as pa
import pytest

from chunkwright.operators import clusters, features


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    at = rng.normal(size=(7, 5)) * 4
    return [(i, [float(v) for v in at[i % 7] + rng.normal(size=5)]) for i in range(400)]


def brute(x, k, seed=42, rounds=20):
    dims, top = x.shape[1], np.abs(x).max()
    factor = (2.0 ** ((51 - dims.bit_length()) // 2) - 1) / top
    q = np.rint(x * factor).astype(np.int64)
    centres = clusters.seeds(q, k, seed)
    for _ in range(rounds):
        near = np.array([int(np.argmin([sum(int(a - b) ** 2 for a, b in zip(r, c, strict=True)) for c in centres])) for r in q])
        new = np.array([[(2 * int(q[near == j, d].sum()) + int((near == j).sum())) // (2 * int((near == j).sum())) for d in range(dims)] if (near == j).any() else centres[j] for j in range(len(centres))])
        if np.array_equal(new, centres):
            break
        centres = new
    return [int(np.argmin([sum(int(a - b) ** 2 for a, b in zip(r, c, strict=True)) for c in centres])) for r in q]


def test_same_tokens_at_any_partitioning(spark, points):
    want = dict(enumerate(brute(np.array([v for _, v in points]), 9)))
    for parts in (1, 4, 64):
        df = spark.createDataFrame(points, "id int, v array<double>").repartition(parts)
        got, found = features.cluster_tokens(df, "v", 9)
        assert {r["id"]: r["token_id"] for r in got.collect()} == want and found.centres.shape == (9, 5)
    assert len(set(want.values())) == 9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), None]), (4, []), (5, [1.0, 2.0]), (6, [9.0, 9.0, 9.0])]
    got, found = features.cluster_tokens(spark.createDataFrame(rows, "id int, v array<float>"), "v", 5)
    token = {r["id"]: r["token_id"] for r in got.collect()}
    assert token[2] is None and token[1] == token[5] != token[6] and token[3] == token[4] and len(found.centres) == 3
    none, found = features.cluster_tokens(spark.createDataFrame([(1, None)], "id int, v array<float>"), "v")
    assert found is None and none.collect()[0]["token_id"] is None


def test_fixed_point_of_slices():
    a = pa.array([[1.0], None, [2.0, 3.0], []], pa.list_(pa.float64()))
    assert clusters.fixed(a.slice(1, 3), 2, 10.0).tolist() == [[0, 0], [20, 30], [0, 0]]
