"""Operator 2, toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Tokens get log-odds (toxic against clean) with an informative Dirichlet prior: the pooled shares, with a mass in
proportion to the labelled documents. So do beginnings of `STEM` bytes; a token whose own log-odds aren't
significant takes those of its beginning, and counts as neutral if these aren't either. Every token pays a small
drift, so that clean text scores negative. A linear scan finds all maximal scoring segments of a text. Karlin-Altschul
statistics of the clean learning rows, lambda from the scores of their tokens and K from the best segment of each
of them, turn a segment's score into its expected number of chance occurrences in a text of that length; a
segment is significant below `EXPECT`. A logistic curve over these calibrated values, fitted on the learning
rows, gives the score.

Rows: null and empty texts have no segment and get the score of such texts; long ones are scanned whole, in linear
time. Repeated rows are scored alike; of labelled rows that share an identifier one is learned from. An empty
table gives no rows. Only doc_id and text are read, whatever other columns are called. Without labels of both
kinds every score is the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import buffer, materialise, slices, span_hashes
from chunkwright.llm.quality import sample_ids

#: Labelled rows learned from at most, chosen by a hash of doc_id; bytes of a token's beginning.
SAMPLE, STEM = 20_000, 5
#: Prior mass as a share of the labelled documents; documents that a token stands in at least.
PRIOR, LEAST_DOCS = 0.2, 3
#: z-score below which a token is neutral (or half of what a token of all toxic and no clean documents has, if that is less);
#: drift per token; expected chance segments.
LEAST_Z, DRIFT, EXPECT = 3.0, 0.5, 0.1

_token = np.zeros(256, dtype=bool)
_token[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, row) of runs of letters and digits."""
    inside = _token[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside & np.concatenate([[True], ~inside[:-1]])[: len(inside)] | inside & edge[:-1]
    last = inside & np.concatenate([~inside[1:], [True]])[: len(inside)] | inside & edge[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, row, hash) of runs of letters and digits; hashes ignore ASCII case."""
    begin, end, row = spans(data, offsets)
    return begin, end, row, span_hashes(_lower[data], begin, end)


def stems(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the tokens' beginnings."""
    return span_hashes(_lower[data], begin, np.minimum(end, begin + STEM))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in linear time: only positive scores open candidates."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # begin, end, sum before, sum behind
    before: list[int] = []  # for each candidate: the nearest earlier one with a lower sum before it, or -1

    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, float(total[i]), float(total[i + 1])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = before[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                before.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], before[j:]
    return [(a, b, r - left) for a, b, left, r in found]


def _look_up(names: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Weight of each wanted hash, 0 for unknown ones; names are sorted."""
    if not len(names):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, weights[at], 0.0)


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of tokens, sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of beginnings, sorted
    stem_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    decay: float = 1.0  # Karlin-Altschul lambda
    scale: float = 1.0  # and K
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))  # logistic weights, the last is the constant

    def weigh(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, score) of all tokens of a column, the bounds of its rows among them, and the rows' byte offsets."""
        data, offsets = buffer(col)
        begin, end, row, hashes = tokens(data, offsets)
        own = _look_up(self.hashes, self.weights, hashes)
        score = np.where(own != 0, own, _look_up(self.stems, self.stem_weights, stems(data, begin, end))) - DRIFT
        return begin, end, score, np.searchsorted(row, np.arange(len(offsets))), offsets

    def scan(self, col: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Calibrated features of each text, and its significant segments as (begin byte, end byte, score)."""
        begin, end, score, bounds, offsets = self.weigh(col)
        n = len(offsets) - 1
        x = np.zeros((n, 2))
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        for i in _with_positive(score, bounds).tolist():
            a, b = bounds[i], bounds[i + 1]
            edge = np.log(self.scale * (b - a) / EXPECT)  # what lambda times the score must exceed
            kept = [(p, q, self.decay * s - edge) for p, q, s in segments(score[a:b]) if self.decay * s > edge]
            if kept:
                x[i] = np.log1p(max(e for _, _, e in kept)), np.log1p(sum(e for _, _, e in kept))
                found[i] = [(int(begin[a + p] - offsets[i]), int(end[a + q - 1] - offsets[i]), e) for p, q, e in kept]
        return x, found

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.curve[:2] + self.curve[2])))


def _with_positive(score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows with a token of positive score."""
    return np.unique(np.searchsorted(bounds, np.flatnonzero(score > 0), side="right") - 1)


def _decay(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * value)) = 1; 1.0 if the mean isn't negative or nothing is positive."""
    if not len(values) or (values @ shares) >= 0 or values.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda t: float((shares * np.exp(np.minimum(t * values, 700))).sum()) - 1
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _significant(table: DataFrame, docs1: int, docs0: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log-odds) of what differs significantly between toxic and clean documents.

    Documents, not occurrences, are the independent draws; the prior is the pooled share of documents times its mass.
    """
    mass_all = PRIOR * (docs1 + docs0)
    mass = F.lit(PRIOR) * (F.col("tox_docs") + F.col("clean_docs"))
    odds = lambda c, n: F.log((F.col(c) + mass) / (F.lit(float(n) + mass_all) - F.col(c) - mass + 1e-9))
    perfect = np.log((1 + PRIOR) * docs1 / (mass_all - PRIOR * docs1 + 1e-9)) - np.log(PRIOR * docs1 / (docs0 + mass_all - PRIOR * docs1))
    least = min(LEAST_Z, perfect / np.sqrt(1 / ((1 + PRIOR) * docs1) + 1 / (PRIOR * docs1)) / 2)
    scored = table.withColumn("odds", odds("tox_docs", docs1) - odds("clean_docs", docs0)).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("tox_docs") + mass) + 1 / (F.col("clean_docs") + mass)))
    kept = scored.where((F.abs("z") >= least) & (F.col("tox_docs") + F.col("clean_docs") >= LEAST_DOCS)).select("token", "odds").collect()
    hashes = np.array([r["token"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["odds"] for r in kept], float)[order]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = SAMPLE) -> Model:
    """Learn token log-odds and the calibration from at most `bound` labelled documents that `learn` admits.

    What comes to the driver follows from that bound: the tokens that are significant among these documents, and
    two numbers for each of them.
    """
    chosen = sample_ids(labels, "toxic", bound, learn)
    # At most `bound` rows of 12 bytes: safe to broadcast whatever the input.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r")).select("doc_id", "r.text", "r.label")
    rows = materialise(rows, "labelled")
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    docs1, docs0 = found.get(1, 0), found.get(0, 0)
    if not docs1 or not docs0:
        share = docs1 / max(1, docs1 + docs0)
        return Model(curve=np.array([0.0, 0.0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = buffer(part.column(1))
            label = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            begin, end, row, hashes = tokens(data, offsets)
            for level, keys in enumerate((hashes, stems(data, begin, end))):
                names, which = np.unique(keys, return_inverse=True)
                pairs = np.unique(which.astype(np.int64) * len(label) + row)
                of, doc = pairs // len(label), label[pairs % len(label)]
                counts = [pa.array(np.bincount(of[m], minlength=len(names)).astype(np.int64)) for m in (doc, ~doc)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), level, np.int32)), pa.array(names.view(np.int64)), *counts], ["level", "token", "tox_docs", "clean_docs"])

    table = rows.mapInArrow(count, "level int, token bigint, tox_docs bigint, clean_docs bigint")
    table = materialise(table.groupBy("level", "token").agg(*[F.sum(c).alias(c) for c in ("tox_docs", "clean_docs")]), "tokens")
    model = Model()
    model.hashes, model.weights = _significant(table.where("level = 0"), docs1, docs0)
    model.stems, model.stem_weights = _significant(table.where("level = 1"), docs1, docs0)

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of clean rows: how many tokens have which score (length null), and each row's best segment and length (n null)."""
        for part in slices(batches, "text"):
            _, _, score, bounds, _ = model.weigh(part.column(0))
            best = np.zeros(len(bounds) - 1)
            for i in _with_positive(score, bounds).tolist():
                best[i] = max(s for _, _, s in segments(score[bounds[i] : bounds[i + 1]]))
            values, n = np.unique(score, return_counts=True)
            nothing = pa.nulls(len(values), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64)), nothing], ["value", "n", "length"])
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.nulls(len(best), pa.int64()), pa.array(np.diff(bounds).astype(np.int64))], ["value", "n", "length"])

    seen = rows.where("label = 0").select("text").mapInArrow(chance, "value double, n bigint, length bigint")
    seen = materialise(seen, "chance")
    tally = seen.where("n is not null").groupBy("value").agg(F.sum("n").alias("n")).collect()
    values, n = np.array([r["value"] for r in tally]), np.array([r["n"] for r in tally], float)
    # what the clean sample doesn't show isn't impossible: each weight counts half a token more
    known = np.unique(np.concatenate([model.weights, model.stem_weights, [0.0]])) - DRIFT
    values, n = np.append(values, known), np.append(n, np.full(len(known), 0.5))
    model.decay = _decay(values, n / n.sum())
    # K by maximum likelihood: a row of N tokens exceeds the score S by chance with probability 1 - exp(-K N exp(-lambda S)).
    best = seen.where("length is not null").agg(F.sum((F.col("value") > 0).cast("int")), F.sum(F.col("length") * F.exp(F.lit(-model.decay) * F.col("value")))).first()
    model.scale = max(1, best[0] or 0) / max(best[1] or 0.0, 1.0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x, _ = model.scan(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x[:, 0]), pa.array(x[:, 1]), part.column(2)], ["doc_id", "a", "b", "label"])

    got = rows.mapInArrow(scan, "doc_id bigint, a double, b double, label int").groupBy("a", "b", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    got.sort()
    x = np.repeat(np.array([[r["a"], r["b"]] for r in got]), [r["n"] for r in got], axis=0)
    y = np.repeat(np.array([r["label"] for r in got], float), [r["n"] for r in got])
    model.curve = _logistic(x, y)
    return model


def assess(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, score, predicted, and its significant passages as byte ranges with calibrated scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for part in slices(batches, "text"):
            x, spans = model.scan(part.column(1))
            score = model.score(x)
            passages = [[{"begin": a, "end": b, "score": s} for a, b, s in own] for own in spans]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(passages, kind)], ["doc_id", "score", "predicted", "passages"])

    schema = "doc_id bigint, score double, predicted int, passages array<struct<begin:bigint,end:bigint,score:double>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold; all columns stay."""
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x, _ = model.scan(part.column(place))
            yield part.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(keep, docs.schema)
