"""One group of all rows, cut into many ranges, gives what a window over the whole group gives; attention against all pairs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwright.operators import attention, scan, temporal

MOST = 20


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    rows = [(1 if i % 17 else 2, float(t), rng.randrange(40) / 10) for i, t in enumerate(sorted(rng.sample(range(0, 2000, 5), 300)))]
    return spark.createDataFrame(rows, "g int, t double, score double").repartition(4).cache()


def rows_of(df):
    return sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


STEPS = {
    "highpass": lambda d, m: temporal.highpass(d, "g", "t", "score", 0.6, 0.4, most=m),
    "top_k": lambda d, m: temporal.top_k(d, "g", "t", "score", F.lit(37), most=m),
    "islands": lambda d, m: temporal.merge_islands(d, "g", "t", 5.0, 6.0, most=m),
    "one_island": lambda d, m: temporal.merge_islands(d, "g", "t", 5.0, 500.0, most=m),
    "cap": lambda d, m: temporal.cap_segments(d.select("g", F.col("t").alias("start_time"), (F.col("t") + F.col("score")).alias("end_time"), F.lit(900.0).alias("d")), "g", "d", most=m),
    "cuts": lambda d, m: temporal.cut_plan(d.select("g", F.col("t").alias("start_time"), (F.col("t") + 3).alias("end_time")), "g", most=m),
    "redundancy": lambda d, m: temporal.redundancy(d.select("g", F.col("t").alias("start_time"), (F.col("t") + 9).alias("end_time")), "g", most=m),
    "overlap": lambda d, m: temporal.interval_overlap(*(d.where(f"score {op} 2").select("g", F.col("t").alias("start_time"), (F.col("t") + 11).alias("end_time")) for op in (">", "<=")), "g", most=m),
    "ramp": lambda d, m: temporal.intro_ramp(d, "g", "t", 400.0, 0.5, most=m),
}


@pytest.mark.parametrize("step", STEPS)
def test_cut_group_as_whole(scored, step):
    got, want = rows_of(STEPS[step](scored, MOST)), rows_of(STEPS[step](scored, scan.MOST))
    assert got == want and got


def test_running_budget_splits_one_key(spark):
    rows = spark.createDataFrame([(5 if i % 3 else None, i % 7, i) for i in range(200)], "k int, size int, id int").repartition(4)
    got, want = (temporal.running_budget(rows, "k", "size", 400, most=m).orderBy("before", "k", "size", "id").collect() for m in (16, 1 << 16))
    assert got == want and 100 < len(got) < 200
    assert [r["before"] for r in got] == [sum(x["size"] for x in got[:i]) for i in range(len(got))]


def all_pairs(rows, tau=45.0, band=90.0):
    t, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-10
    apart = np.abs(t[:, None] - t[None, :])
    return (np.where(apart <= band, np.exp(-apart / tau), 0) * (x @ x.T)).sum(1)


@pytest.mark.parametrize("dims", [3, 19])
def test_band_attention_against_all_pairs(spark, dims):
    rng = np.random.default_rng(dims)
    times = rng.choice(np.concatenate([np.arange(-500, 900, 5), [100.0] * 150, rng.uniform(0, 60, 150)]), 400)
    rows = [(1, float(t), [float(v) for v in rng.normal(size=dims).astype(np.float32)], i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows + [(None, 1.0, [1.0] * dims, -1), (1, None, [1.0] * dims, -2), (1, 2.0, None, -3)], "g int, t double, v array<float>, id int").repartition(3)
    want = dict(zip([r[3] for r in rows], all_pairs(rows), strict=True))
    for most in (25, scan.MOST):
        got = {r["id"]: r["local"] for r in attention.band_attention(df, "g", "t", "v", most=most).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-7


def test_many_rows_at_one_time(spark):
    df = spark.range(10_000).select(F.lit(1).alias("g"), F.lit(10.0).alias("t"), F.array((F.col("id") % 2 + 1).cast("float"), F.lit(1.0).cast("float")).alias("v"), "id")
    began = time.perf_counter()
    got = attention.band_attention(df, "g", "t", "v").agg(F.count("*").alias("n"), F.min("local").alias("a"), F.max("local").alias("b")).first()
    assert time.perf_counter() - began < 60
    cross = 3 / (2**0.5 * 5**0.5)
    assert got["n"] == 10_000 and got["a"] == pytest.approx(5000 * (1 + cross)) == got["b"]


def test_hybrid_attention_of_a_cut_group(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(1, 5.0 * i, float(rng.uniform()), [float(v) for v in rng.normal(size=4)]) for i in range(90)], "g int, t double, score double, v array<double>").repartition(3)
    got, want = (rows_of(attention.hybrid_attention(df, "g", "t", "score", "v", most=m)) for m in (25, scan.MOST))
    assert got == want and len(got) == 90


def test_no_rows(spark):
    none = spark.createDataFrame([], "g int, t double, score double, v array<double>")
    assert attention.hybrid_attention(none, "g", "t", "score", "v").count() == 0
    assert temporal.highpass(none, "g", "t", "score").count() == 0
