"""Quoted CSV in many splits against Python's csv module."""

import csv
import random

import pytest

from chunkwright.sources import quoted
from chunkwright.sources.files import headered_csv, write_csv


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "97")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_fields_that_span_lines_and_splits(spark, tmp_path, small_splits):
    rng = random.Random(5)
    bits = ["a", "é", '"', ",", "\n", "\n\n", "long words ", " ", '""']
    want = set()
    for f in range(3):
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            w = csv.writer(out, lineterminator="\r\n" if f == 1 else "\n")
            w.writerow(["k", "text", "n"])
            for i in range(60):
                text = "x" + "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60 if i % 20 == 0 else 6))) + "x"
                w.writerow([f * 100 + i, text, rng.choice([i, "", "none"])])
                want.add((f * 100 + i, text))
    df = quoted.read_csv(spark, str(tmp_path), "k int, text string, n int")
    rows = df.collect()
    assert {(r["k"], r["text"]) for r in rows} == want and len(rows) == 180
    assert {type(r["n"]) for r in rows} == {int, type(None)}
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_round_trip(spark, tmp_path, small_splits):
    rows = [(i, [None, "", "plain", 'say "hi", so', "two\nlines\n\nmore", "é,"][i % 6]) for i in range(50)]
    write_csv(spark.createDataFrame(rows, "k int, x string").repartition(2), f"{tmp_path}/t")
    got, whole = quoted.read_csv(spark, f"{tmp_path}/t", "k int, x string"), headered_csv(spark, f"{tmp_path}/t", "k int, x string")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert {r for r in rows if r[1]} == {tuple(r) for r in got.collect() if r["x"]}


def test_open_quote_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,x\n1,"never closed\n2,b\n')
    assert quoted.records(spark, str(tmp_path)).count() == 2
    (tmp_path / "a.csv").write_text("k,x\n")
    assert quoted.read_csv(spark, str(tmp_path), "k int, x string").count() == 0
