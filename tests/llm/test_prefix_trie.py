"""The trie against a version that holds every beginning in a dict, over turns with nulls, ties, copies and a conversation of many turns."""

import random
import zlib
from hashlib import sha256

import pytest

from chunkwright.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, c string, depth double, digest string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(family, [])[:h] + turns[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = {}
    kids = {}
    for seq in members:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)

    for seq in sorted(members, key=len, reverse=True):
        below = kids.get(seq, [])
        ends = sorted(c for c in members[seq] if rebuilt[c] == seq)
        out[seq] = (
            min(members[seq]), len(seq), min(members[seq[:-1]]) if seq else None, len(members[seq]), len(below), sum(out[k][5] for k in below) or 1,
            sum(out[k][6] for k in below) + (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0), sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def rows():
    rng = random.Random(3)
    made = []
    for c in [*range(0, 40), *range(-120, -90), *range(200, 230), 5000, 1 << 40]:
        start = rng.choice("abc")
        for k in range(rng.randrange(1, 9)):
            made.append((c, rng.choice([None, k, k, 2]) if c % 7 == 0 else k, rng.choice(["user", None]), start + rng.choice(["", "x", "é" * 3]) if k else start))
    made += [(77, k, "user", f"t{k % 3}") for k in range(150)] + [(78, k, "user", f"t{k % 3}") for k in range(140)]
    made += [(c, 0, "system", "hello") for c in range(300, 360)] * 2
    made += [(c, k, "u", t) for c in range(400, 460) for k, t in enumerate("abcdefgh")]
    made += [(None, 0, "u", "lost"), (501, 0, None, None), (501, 0, None, None)]
    return made


@pytest.mark.parametrize("most", [64, 1 << 20])
def test_against_all_beginnings(spark, most):
    made = rows()
    df = spark.createDataFrame([(*r, "x", 1.0, "y") for r in made], SCHEMA).repartition(3)
    got = prefix_trie.trie(prefix_trie.with_family_heads(df, most), most)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(made)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.with_family_heads(empty)).count() == 0
