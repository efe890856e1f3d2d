"""Byte-pair training from a dictionary of pieces against one merge at a time over the whole stream."""

import random
from collections import Counter

import numpy as np
import pytest

from chunkwright.operators import bytepairs, text

WORDS = "low lower newest wide é the of river stone bridge garden window".split()


def one_at_a_time(stream, vocab):
    ids, merges = np.frombuffer(stream, np.uint8).astype(np.int64), {}
    while text.FIRST_MERGE + len(merges) < vocab and (pair := bytepairs.best_pair(ids)) is not None:
        merges[pair] = text.FIRST_MERGE + len(merges)
        ids = bytepairs.merge_pair(ids, *pair, merges[pair])
    return merges


def corpus(kind):
    rng = random.Random(kind)
    if kind == "words":
        return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(60, 200))) for _ in range(40)] + [None, ""]
    if kind == "runs":  # pieces of more than seven bytes, some of one byte alone
        return ["".join(rng.choice(["a" * rng.randrange(1, 30), "b", "ab" * 9, chr(rng.randrange(200, 400))]) for _ in range(60)) for _ in range(30)]
    return ["wxyz, " * rng.randrange(30, 60) + rng.choice(["yz", "."]) for _ in range(30)]  # wx, xy and others share a count


def trained(spark, made, merges, monkeypatch, newline=True, blocks=False):
    monkeypatch.setattr(bytepairs, "SMALL", 0)
    if not blocks:
        monkeypatch.setattr(bytepairs, "stream_blocks", lambda *_: pytest.fail("the text was put into blocks"))
    df = spark.createDataFrame(list(enumerate(made)), "k int, line string").repartition(3)
    got = text.train_bpe(df, "k", "line", text.FIRST_MERGE + merges, newline)
    stream = "".join(x + "\n" * newline for x in made if x is not None).encode()
    assert list(got.items()) == list(one_at_a_time(stream, text.FIRST_MERGE + merges).items()) and len(got) == merges


@pytest.mark.parametrize(("kind", "merges", "newline"), [("words", 15, True), ("words", 6, False), ("runs", 6, True), ("ties", 4, True)])
def test_a_text_is_not_gone_through_again_for_each_round(spark, monkeypatch, kind, merges, newline):
    trained(spark, corpus(kind), merges, monkeypatch, newline)


def test_small_slices_and_full_tables(spark, monkeypatch):
    for name, value in (("STEP", 64), ("HELD", 8), ("DENSE", 0)):
        monkeypatch.setattr(bytepairs, name, value)
    trained(spark, corpus("words"), 8, monkeypatch)


def test_merges_over_line_ends_go_through_blocks(spark, monkeypatch):
    trained(spark, [f"{x}" for x in "ab" * 40] + ["ab"] * 9, 5, monkeypatch, blocks=True)


def test_ties_that_the_first_lines_leave_open_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(bytepairs, "EARLY", (1,))
    trained(spark, ["q"] + corpus("ties"), 4, monkeypatch, blocks=True)


def test_lower_floors_follow(spark, monkeypatch):
    """A merge of h with each letter takes two of the frequent pairs of bytes, so that they don't last; then come those of the alphabet."""
    rng = random.Random(4)
    made = ["".join("h" + rng.choice("abcdefgijklmno") for _ in range(150)) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2 for _ in range(12)]
    cuts, cut = [], bytepairs.dictionary
    monkeypatch.setattr(bytepairs, "dictionary", lambda *a: cuts.append(a[2].sum()) or cut(*a))
    trained(spark, made, 16, monkeypatch)
    assert len(cuts) > 1 and cuts == sorted(cuts)


def test_pairs_of_lines_and_between_them(spark):
    made = ["", "ab", "b", "", "ba ab", "a"] * 5
    for newline in (True, False):
        df = spark.createDataFrame([(bytearray(x.encode()),) for x in made], "_line binary").repartition(2)
        inside, between = bytepairs.seams(df, newline)
        want, stream = Counter(), "".join(x + "\n" * newline for x in made).encode()
        for x in made:
            b = (x + "\n" * newline).encode()
            want.update(l << 8 | r for l, r in zip(b, b[1:], strict=False))  # noqa: E741
        assert {k: inside[k] for k in np.flatnonzero(inside)} == want
        whole = Counter(l << 8 | r for l, r in zip(stream, stream[1:], strict=False))  # noqa: E741
        assert all(inside[k] <= n <= inside[k] + between[k] for k, n in whole.items())


def test_pairs_of_pieces_count_as_often_as_the_piece():
    ids, n = np.array([1, 2, 2, 9, 2, 2, 2, 9, 1, 2, 9], np.uint16), np.array([5, 1 << 54, 1], np.int64)
    for width in (10, 3000):
        codes, times = bytepairs.weighed(ids, n, 9, width)
        assert dict(zip(codes.tolist(), times.tolist(), strict=True)) == {width + 2: 6, 2 * width + 2: 5 + (1 << 55)}
