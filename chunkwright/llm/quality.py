"""Operator 6, quality rules: document statistics, fixed base rules, then gradient-boosted trees over the statistics.

The trees are fitted here on a bounded sample of labelled rows, flattened into numpy node arrays, and walked for
all rows of a slice at once. Features named in `MONOTONE` may only lower or only raise the score.

Rows: a null or empty text has no words and fails the base rules; long texts are counted whole. Repeated rows are
scored alike; of labelled rows that share an identifier one is fitted on. An empty table gives no rows. Only doc_id
and text are read, whatever other columns are called. Without any usable labels the trees are empty and the base
rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import buffer, mix, slices, span_hashes, words

#: Labelled rows that are fitted on at most; which ones follows from a hash of doc_id.
SAMPLE = 20_000
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words", "distinct_share"]
#: -1: more of it never raises the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each row has."""
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again, and whether it occurred before (in order of place)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, before


def statistics(col: pa.Array) -> dict[str, np.ndarray]:
    """Counts and features of each text of a column."""
    data, offsets = buffer(col)
    n = len(offsets) - 1
    begin, end, row = words(data, offsets)
    n_words = np.bincount(row, minlength=n)
    lead = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    word_chars = _per_row(lead & inside, offsets)
    n_symbols = _per_row(SYMBOLS[data], offsets)
    with np.errstate(over="ignore"):
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))
        # lines
        cut = data == 10
        heads = np.union1d(offsets[:-1], np.flatnonzero(cut) + 1)
        heads = heads[heads < len(data)]
        tails = np.append(heads[1:], len(data))[: len(heads)]
        tails = tails - cut[tails - 1]
        has = np.searchsorted(begin, tails) > np.searchsorted(begin, heads)
        heads, tails = heads[has], tails[has]
        line_row = np.searchsorted(offsets, heads, side="right") - 1
        _, before = _repeated(span_hashes(data, heads, tails) ^ salt[line_row])
        n_lines = np.bincount(line_row, minlength=n)
        n_dup = np.bincount(line_row[before], minlength=n)
        # five-word windows
        word = span_hashes(data, begin, end)
        again_word, seen = _repeated(word ^ salt[row])
        distinct = n_words - np.bincount(row[seen], minlength=n)
        repeat = np.zeros(n, np.int64)
        if len(word) >= 5:
            m = len(word) - 4
            window = np.zeros(m, np.uint64)
            for k in range(5):
                window = mix(window + word[k : k + m])
            place = np.flatnonzero(row[4:] == row[:-4])
            again, _ = _repeated(window[place] ^ salt[row[place]])
            marks = np.zeros(len(word) + 1, np.int32)
            at = place[again]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + 5, -1)
            repeat = np.bincount(row[np.cumsum(marks[:-1]) > 0], minlength=n)
    chars = np.maximum(word_chars, 1)
    upper = _per_row((data >= 65) & (data <= 90), offsets)
    digit = _per_row((data >= 48) & (data <= 57), offsets)
    mark = _per_row((data == 33) | (data == 63) | (data == 124) | (data == 44) | (data == 46), offsets)
    some = np.maximum(n_words, 1)
    features = [np.log1p(n_words), word_chars / some, n_symbols / chars, n_dup / np.maximum(n_lines, 1), repeat / some, upper / chars, digit / chars, mark / some, np.log1p(n_words / np.maximum(n_lines, 1)), distinct / some]
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": repeat, "features": np.column_stack(features).astype(np.float64)}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass
class Trees:
    """All trees as node arrays: node k goes to left[k] if x[feature[k]] <= threshold[k], else to right[k]; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                if (f < 0).all():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: int = 20, ridge: float = 1.0, monotone: dict[str, int] | None = None) -> Trees:
    """Boost logistic-loss trees on histograms; a constrained split's children keep to either side of their middle value."""
    signs = np.array([(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES])
    nodes: list[list[float]] = []
    roots: list[int] = []
    if not len(y) or y.min() == y.max():
        return Trees(*(np.zeros(0, int) for _ in range(5)), np.zeros(0, int), 20.0 if not len(y) or y.max() else -20.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, 0.0])
        g, h = grad[rows], hess[rows]
        clip = lambda v: min(max(v, low), high)
        own = clip(-g.sum() / (h.sum() + ridge))
        best = None
        if level < depth and len(rows) >= 2 * least:
            gain_of = lambda a, b: a * a / (b + ridge)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = code[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g, h, None))
                gr, hr = g.sum() - gs, h.sum() - hs
                gain = gain_of(gs, hs) + gain_of(gr, hr) - gain_of(g.sum(), h.sum())
                vl, vr = np.clip(-gs / (hs + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                ok = (ns >= least) & (len(rows) - ns >= least) & ((vr - vl) * signs[j] >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, vl[k], vr[k])
        if best is None:
            nodes[me][4] = rate * own
            return me
        _, j, k, vl, vr = best
        mid = (vl + vr) / 2
        goes = code[rows, j] <= k
        bounds = {0: ((low, high), (low, high)), -1: ((mid, high), (low, mid)), 1: ((low, mid), (mid, high))}[int(signs[j])]
        left = grow(rows[goes], level + 1, *bounds[0])
        right = grow(rows[~goes], level + 1, *bounds[1])
        nodes[me] = [j, edges[j][k], left, right, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        a = np.array(nodes[first:])
        one = Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int) - first, a[:, 3].astype(int) - first, a[:, 4], np.array([0]), 0.0)
        s = one.score(x)
        margin += np.log(s / (1 - s))
    a = np.array(nodes)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), bias)


def sample_ids(labels: DataFrame, column: str, bound: int, keep=None) -> DataFrame:
    """At most `bound` labelled identifiers (doc_id, label), chosen by a hash; conflicting labels are averaged and rounded."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.round(F.avg(column)).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Trees:
    """Fit on at most `bound` labelled documents, one row of each identifier; they alone come to the driver."""
    chosen = sample_ids(labels, "quality", bound)
    # At most `bound` rows of 12 bytes: safe to broadcast whatever the input.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = statistics(part.column(1))["features"]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "label": part.column(2), "x": pa.array(list(x), pa.list_(pa.float64()))})

    found = rows.select("doc_id", "text", "label").mapInArrow(features, "doc_id bigint, label int, x array<double>")
    got = sorted(found.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label")).collect(), key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in got], float))


def judge(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept and score (probability of good quality)."""
    model = train(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            s = statistics(part.column(1))
            failed, score = base_failed(s), model.score(s["features"])
            cols = [part.column(0), *(pa.array(s[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
