"""Ordered texts from pieces, and sharpness in columns."""

import random

import numpy as np
import pytest

from chunkwright.operators import features, text


def test_pieces_make_the_whole_group(spark):
    rng = random.Random(1)
    rows = [(1 if i % 9 else None, rng.choice([None, *range(40)]), rng.choice([None, "", "é", "ab", "long " * 5])) for i in range(300)] + [(3, 1, None)]
    df = spark.createDataFrame(rows, "g int, k int, x string").repartition(5)
    want = {}
    for g, k, x in rows:
        want.setdefault(g, []).append((k is not None, k or 0, x is not None, x or ""))
    want = {g: " ".join(x for *_, there, x in sorted(v) if there) for g, v in want.items()}
    for size, most in ((20, 40), (text.PIECE, 1 << 20)):
        assert {r["g"]: r["text"] for r in text.ordered_concat(df, "g", "k", "x", size=size, most=most).collect()} == want
    pieces = text.ordered_pieces(df.where("g = 1"), "g", "k", "x", size=20, most=40).orderBy("piece").collect()
    assert len(pieces) > 20 and " ".join(r["text"] for r in pieces) == want[1] and max(len(r["text"].encode()) for r in pieces) < 80


def test_too_long_a_value_is_refused(spark):
    df = spark.createDataFrame([(1, i, "x" * 10) for i in range(9)] + [(2, 0, "y")], "g int, k int, x string")
    with pytest.raises(Exception, match="ordered_pieces"):
        text.ordered_concat(df, "g", "k", "x", size=20, limit=50).collect()


def test_sharpness_as_numpy_has_it(spark):
    rng = np.random.default_rng(2)
    for shape in ((4, 6), (2, 2), (1, 5), (5, 1)):
        image = rng.integers(0, 256, shape)
        df = spark.createDataFrame([(1, image.ravel().tolist()), (2, None), (3, [])], "id int, p array<int>")
        got = {r["id"]: r["blur_score"] for r in features.sharpness(df, "p", shape[1]).collect()}
        assert got[1] == pytest.approx(features.laplacian_variance(image)) and got[2] == got[3] == 0
