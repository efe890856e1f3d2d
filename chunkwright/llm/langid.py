"""Operator 9, language identification: nearest centroid over normalised TF-IDF vectors of byte trigrams.

Each language has several centroids from spherical k-means over its sample; a text takes the language of the
centroid with the highest cosine. `rejected` marks texts that are farther from that centroid than 99 in 100 of
the sample's own texts of the language are from theirs. `lang` is the nearest language, `und` when rejected; `nearest` ignores rejection
(a caller who must name a language takes that one).

Rows: a null text, or one without a letter, is `und` with score 0; long texts are read whole. Repeated rows are
judged alike, and a text counts once in a sample. An empty table gives no rows. With no learnable row every text
is `und`. Only doc_id, text and lang are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import buffer, slices

DIMS = 1 << 14
#: Sampled texts per language (in expectation); a language costs CENTROIDS vectors of DIMS floats, 196 KB, in the model.
SAMPLE_PER_LANG = 500
CENTROIDS = 3
#: Share of a language's own sample that is farther from its centroids than what is accepted.
BEYOND = 0.01
UNDETERMINED = "und"

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[[b for b in range(128) if not chr(b).isalpha()]] = 32
_letter = regex.compile(r"\p{L}")


def grams(data: np.ndarray) -> np.ndarray:
    """Feature of the trigram at each byte (two fewer than bytes); -1 where it holds no letter."""
    low = _fold[data]
    low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 0x20
    if len(low) < 3:
        return np.zeros(0, np.int32)
    code = low[:-2].astype(np.uint32) | low[1:-1].astype(np.uint32) << np.uint32(8) | low[2:].astype(np.uint32) << np.uint32(16)
    hashed = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)
    hashed[code == 0x202020] = -1
    return hashed


def vectors(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, counts) of each text; a text is padded with a space on either side."""
    data, offsets = buffer(col)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        padded = np.full(b - a + 2, 32, np.uint8)
        padded[1:-1] = data[a:b]
        own = grams(padded)
        counts = np.bincount(own[own >= 0], minlength=DIMS)
        at = np.flatnonzero(counts)
        yield at, counts[at]


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # features x centroids, unit columns times nothing else
    idf: np.ndarray
    reach: np.ndarray  # lowest cosine accepted, by centroid

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(nearest language, cosine, rejected) of each text."""
        near, cosine, rejected = [], [], []
        for at, counts in vectors(col):
            v = np.log1p(counts).astype(np.float32) * self.idf[at]
            norm = float(np.sqrt(v @ v))
            if not norm or not self.langs:
                near.append(self.langs[0] if self.langs else UNDETERMINED), cosine.append(0.0), rejected.append(True)
                continue
            sims = v @ self.centroids[at] / norm
            k = int(sims.argmax())
            near.append(self.langs[k])
            cosine.append(min(1.0, max(0.0, float(sims[k]))))
            rejected.append(cosine[-1] < self.reach[k])
        return near, np.array(cosine), np.array(rejected, bool)


def _cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; rows of x are unit vectors."""
    seeds = [int((x @ x.mean(0)).argmax())]
    closest = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(closest.argmin()))
        closest = np.maximum(closest, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, learn: Column, per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> Model:
    """Learn from (doc_id, text, lang) rows that `learn` admits: about `per_lang` different texts of each language, dealt by a hash of the text."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    shares = rows.groupBy("lang").agg((F.lit(float(per_lang)) / F.count(F.lit(1))).alias("share"))
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    # One row for each language. Copies of a text are drawn together and then are one, so that what comes to the driver keeps its bound.
    chosen = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [(a.astype("<u2").tobytes(), np.minimum(c, 65535).astype("<u2").tobytes()) for a, c in vectors(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a for a, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())], ["lang", "h", "at", "n"])

    got = chosen.select("lang", "h", "text").mapInArrow(run, "lang string, h bigint, at binary, n binary").collect()
    got.sort(key=lambda r: (r["lang"], r["h"]))
    got = [(r["lang"], np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<u2")) for r in got if r["at"]]
    df = np.zeros(DIMS)
    for _, at, _ in got:
        df[at] += 1
    idf = np.log((1 + len(got)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    names, columns, reach = [], [], []
    for lang in sorted({g[0] for g in got}):
        own = [(at, n) for g, at, n in got if g == lang]
        x = np.zeros((len(own), DIMS), np.float32)
        for i, (at, n) in enumerate(own):
            x[i, at] = np.log1p(n) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _cluster(x, centroids)
        best = (x @ c.T).max(1)
        names += [lang] * len(c)
        columns.append(c)
        reach += [float(np.quantile(best, BEYOND))] * len(c)
    if not names:
        return Model([], np.zeros((DIMS, 0), np.float32), idf, np.zeros(0))
    return Model(names, np.ascontiguousarray(np.concatenate(columns).T), idf, np.array(reach))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, nearest, lang, score (cosine to the nearest centroid), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS columns of DIMS floats for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            near, score, rejected = shared.value.predict(part.column(1))
            texts = part.column(1)
            data, offsets = buffer(texts)
            some = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
            sums = np.concatenate([[0], np.cumsum(some)])
            letter = sums[offsets[1:]] > sums[offsets[:-1]]
            for i in np.flatnonzero(~letter):
                letter[i] = bool(_letter.search(texts[i].as_py() or ""))
            near = [n if x else UNDETERMINED for n, x in zip(near, letter, strict=True)]
            lang = [UNDETERMINED if r else n for n, r in zip(near, rejected, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near, pa.string()), pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(rejected | ~letter)], ["doc_id", "nearest", "lang", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, nearest string, lang string, score double, rejected boolean")
