"""Hard negatives against all scores at once, over rows with nulls, odd vectors, repeated ids, ties and small blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chunkwright.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, tag string, part double, v string"


def brute(rows, positives=5, negatives=10):
    good = []
    for i, vec, label in rows:
        if label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            good.append((i, [math.floor(256 * x) for x in vec], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for i, vec, label in good:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(vec, w, strict=False)), j, other == label) for j, w, other in good if j != i]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, pid, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and 30 * ps <= 100 * s[0] <= 90 * ps][:negatives]
            out += [(i, pid, rank, nid, ps, ns) for rank, (ns, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def rows():
    rng = random.Random(11)
    half = lambda: rng.randrange(-8, 24) / 8  # noqa: E731  many equal scores
    made = [(i, [half() for _ in range(7)], rng.randrange(3)) for i in range(320)]
    made += [(100, [half() for _ in range(7)], 1), (200, *made[200][1:]), (None, made[5][1], 0), (None, made[6][1], 1)]
    made += [(400, None, 1), (500, made[1][1], None), (600, [1.0, None, 1.0], 1), (601, [1.0, float("nan")], 1), (602, [float("inf")], 2), (700, [], 1), (800, [2.0, 1.5], 2), (-100, made[9][1], 0)]
    return made


@pytest.mark.parametrize("shape", [((2, 40), 3), ((256, 2048), 32)])
def test_against_all_scores(spark, shape):
    made = rows()
    df = spark.createDataFrame([(*r, "x", 1.0, "y") for r in made], SCHEMA).repartition(3)
    heights, dims = shape
    got = hard_negatives.mine(hard_negatives.scaled(df), F.col("vec_id") % 100 == 0, heights=heights, dims=dims)
    want = brute(made)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) > 100


def test_large_components(spark):
    big = spark.createDataFrame([(0, [3e6, 5e6], 1), (1, [4e6, 1e6], 1), (2, [2e6, 1e6], 2)], "vec_id bigint, embedding array<float>, label int")
    got = hard_negatives.mine(hard_negatives.scaled(big, relabel=None), F.col("vec_id") == 0)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2, 17 * 10**12 << 16, 11 * 10**12 << 16)]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(hard_negatives.scaled(big.withColumn("embedding", F.array(F.lit(1e30))), relabel=None), F.col("vec_id") == 0).collect()


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(hard_negatives.scaled(empty), F.col("vec_id") % 100 == 0).count() == 0
