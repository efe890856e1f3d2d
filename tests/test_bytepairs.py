"""Byte-pair training in blocks against one merge at a time over the whole stream; encoding by a queue."""

import random

import numpy as np
import pytest

from chunkwright.operators import bytepairs, text


def one_at_a_time(stream, vocab):
    ids, merges = np.frombuffer(stream, np.uint8).astype(np.int64), {}
    while text.FIRST_MERGE + len(merges) < vocab and (pair := bytepairs.best_pair(ids)) is not None:
        merges[pair] = text.FIRST_MERGE + len(merges)
        ids = bytepairs.merge_pair(ids, *pair, merges[pair])
    return merges


def lines(kind, rng):
    if kind == "runs":
        return ["a" * rng.randrange(0, 40) + rng.choice(["", "b", "bb"]) for _ in range(12)]
    if kind == "ties":
        return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9))) for _ in range(25)]
    return [" ".join(rng.choice("low lower newest wide é the of".split()) for _ in range(rng.randrange(0, 9))) for _ in range(30)] + [None, ""]


@pytest.mark.parametrize(("kind", "block", "newline"), [("runs", 5, False), ("runs", 3, True), ("ties", 4, True), ("words", 7, False)])
def test_blocks_against_the_whole_stream(spark, kind, block, newline):
    made = lines(kind, random.Random(block))
    df = spark.createDataFrame(list(enumerate(made)), "k int, line string").repartition(4)
    stream = "".join(x + "\n" * newline for x in made if x is not None).encode()
    want = one_at_a_time(stream, text.FIRST_MERGE + 12)
    got = text.train_bpe(df, "k", "line", text.FIRST_MERGE + 12, newline, block)
    assert list(got.items()) == list(want.items()) and got


def test_no_corpus(spark):
    assert text.train_bpe(spark.createDataFrame([], "k int, line string"), "k", "line", 300) == {}


def test_batches_are_what_one_at_a_time_gives():
    rng = random.Random(3)
    for _ in range(60):
        ids = np.array([rng.randrange(6) for _ in range(rng.randrange(2, 80))], np.int64)
        keys, first, n = bytepairs.pairs_of(ids)
        counts = sorted(((int(k) >> 32, int(k) & 0xFFFFFFFF, int(c)) for k, c in zip(keys, n, strict=True)), key=lambda x: (-x[2], first[list(keys).index(x[0] << 32 | x[1])]))
        chosen, step = bytepairs.batch_of(counts, True), ids
        for k, pair in enumerate(chosen):
            assert bytepairs.best_pair(step) == pair
            step = bytepairs.merge_pair(step, *pair, 100 + k)


def test_queue_gives_the_ids_of_merging_in_order():
    rng = random.Random(8)
    stream = " ".join(rng.choice(["low", "lower", "newest", "aaaa", "aaa", "éé", "x"]) for _ in range(400))
    merges = one_at_a_time(stream.encode(), text.FIRST_MERGE + 80)
    for _ in range(200):
        t = "".join(rng.choice(["low", "er", "a", "aa", " ", "né", "est", "x"]) for _ in range(rng.randrange(0, 30)))
        assert text.encode_queue(t, merges) == text.encode_ids(t, merges) == text.encode_fast(t, merges)


def test_a_round_takes_pairs_that_share_a_side():
    """Pairs (a, b) and (a, c) don't meet; a round took one of them at a time."""
    counts = [(1, 2, 9), (1, 3, 8), (4, 3, 7), (3, 5, 6), (6, 7, 5)]
    assert bytepairs.batch_of(counts, True) == [(1, 2), (1, 3), (4, 3)]


def test_tables_of_pairs_are_the_sorted_pairs():
    rng = np.random.default_rng(2)
    for size in (2, 3, 50, 200_000):
        ids = rng.integers(0, 40, size).astype(np.uint16)
        ids[-min(size, 9) :] = 41  # stands in the end alone
        n, first = bytepairs.table_of(ids, 42)
        keys, at, m = bytepairs.pairs_of(ids)
        codes = (keys >> 32) * 42 + (keys & 0xFFFFFFFF)
        assert (np.flatnonzero(n) == codes).all() and (n[codes] == m).all() and (first[codes] == at).all()


def test_more_tokens_than_a_table_holds(spark, monkeypatch):
    made = lines("words", random.Random(1))
    df = spark.createDataFrame(list(enumerate(made)), "k int, line string")
    want = text.train_bpe(df, "k", "line", text.FIRST_MERGE + 5, True, 9)
    monkeypatch.setattr(bytepairs, "DENSE", 0)
    assert text.train_bpe(df, "k", "line", text.FIRST_MERGE + 5, True, 9) == want
