"""Scans give the same rows whether a group is one window partition or cut into many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from chunkwright.operators import scan


def table(spark, n=240, groups=(1,), seed=5, ties=40):
    rng = random.Random(seed)
    rows = [(g, float(rng.randrange(ties)), None if rng.random() < 0.05 else round(rng.gauss(0, 50), 3), rng.randrange(1 << 60), i) for i, g in enumerate(rng.choices(groups, k=n))]
    return spark.createDataFrame(rows, "g int, t double, v double, h bigint, _n bigint").withColumnRenamed("_n", "clash").repartition(5)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)
    at = lambda d: sorted((tuple(None if r[c] is None else round(r[c], 6) for c in names) for r in d.collect()), key=repr)
    assert at(a) == at(b)


GROUPS = [(1,), (1, 1, 1, 1, 2, None)]


@pytest.mark.parametrize(("groups", "before"), [(GROUPS[0], True), (GROUPS[1], False)])
def test_running(spark, groups, before):
    rows = table(spark, groups=groups)
    values = {"s": (F.col("v"), "sum"), "c": (F.col("v"), "count"), "x": (F.col("h"), "xor"), "m": (F.col("v"), "max")}
    same(scan.running(rows, ["g"], ["t"], values, before, most=40), scan.running(rows, ["g"], ["t"], values, before))


@pytest.mark.parametrize("groups", GROUPS)
def test_shifted(spark, groups):
    rows = table(spark, groups=groups)
    values = {"a": ("v", -1, 0.0), "b": ("v", 1, -1.0), "c": ("h", 1, None)}
    same(scan.shifted(rows, ["g"], [F.desc("t")], values, most=40), scan.shifted(rows, ["g"], [F.desc("t")], values))


def test_no_group_is_one_group(spark):
    rows = table(spark)
    one = rows.withColumn("g", F.lit(7))
    same(scan.running(rows.drop("g"), [], ["t"], {"s": (F.col("v"), "sum")}, most=40), scan.running(one.drop("g"), [], ["t"], {"s": (F.col("v"), "sum")}))


@pytest.mark.parametrize("groups", GROUPS)
def test_totals(spark, groups):
    rows = table(spark, groups=groups)
    totals = {"n": F.count(F.lit(1)), "hi": F.max("v")}
    same(scan.with_totals(rows, ["g"], totals, most=40), scan.with_totals(rows, ["g"], totals))


@pytest.mark.parametrize(("groups", "column"), [(GROUPS[0], "t"), (GROUPS[1], "v")])
def test_exact_places_and_quantiles(spark, groups, column):
    rows = table(spark, n=400, groups=groups)
    by = {}
    for r in rows.collect():
        if r[column] is not None:
            by.setdefault(r["g"], []).append(r[column])
    for most in (40, scan.MOST):
        got = {r["g"]: (r["p60"], r["n"]) for r in scan.at_places(rows, ["g"], column, {"p60": lambda n: scan.place_of(0.6, n)}, most, splits=8).collect()}
        assert got == {g: (sorted(v)[max(1, -(-6 * len(v) // 10)) - 1], len(v)) for g, v in by.items()}
        got = {r["g"]: r["edge"] for r in scan.quantile(rows, ["g"], column, 0.8, most=most).collect()}
        for g, v in by.items():
            v.sort()
            at = 0.8 * (len(v) - 1)
            assert got[g] == pytest.approx(v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at)))


def test_nothing_and_nulls(spark):
    rows = table(spark)
    for most in (40, scan.MOST):
        none = rows.withColumn("v", F.lit(None).cast("double"))
        assert [r.asDict() for r in scan.quantile(none, ["g"], "v", 0.5, most=most).collect()] == [{"g": 1, "edge": None}]
    empty = rows.limit(0)
    assert scan.running(empty, ["g"], ["t"], {"s": (F.col("v"), "sum")}).count() == 0
    assert scan.quantile(empty, ["g"], "v", 0.5).count() == 0
