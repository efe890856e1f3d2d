"""Operator 3, benchmark decontamination: rare n-gram seeds lead to candidate passages, Smith-Waterman scores them.

A seed is, at each word of an item, the shortest of the `GRAMS` n-grams whose chance of standing at a place of
the corpus, under independent words with their corpus frequencies, is at most `RARE`. Frequencies are counted
over all documents. Copies of a passage do not make its seeds common: the bound is on words, not on the n-gram. An item that
has no rare n-gram (a short one, or one of common words alone) has its whole word sequence as its seed: it is found where it stands word for word.
Every seed hit opens a window around its diagonal; windows of the same item that overlap are one. The item is
aligned locally with the window (words equal: +2, different: -1, gap: -1); score / (2 * item words) is the score.

The items are held in memory by every task, `CHUNK_BYTES` of them at a time; a larger benchmark takes several
passes over the documents. Per pass, text is scanned twice: once for frequencies, once for hits.

Rows: null and empty texts and items match nothing; long texts are searched whole, and only windows around seeds are
aligned. Repeated rows each get their own hits, and repeated items theirs; a null doc_id stays null. Of ties the earliest
passage is given. An empty table gives no rows (an empty benchmark leaves all documents clean). `contaminated` reads doc_id and text
alone, whatever other columns are called; `clean` carries them all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import buffer, mix, slices
from chunkwright.llm.toxicity import tokens

GRAMS, RARE = (3, 5, 8), 1e-8
LEAST = 0.5
CHUNK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


def _grams(word: np.ndarray, n: int) -> np.ndarray:
    out = np.full(max(0, len(word) - n + 1), np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out + word[k : k + len(out)])
    return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word ids: (score, begin, end) with the place in the window."""
    width = len(window) + 1
    steps = np.arange(width) * -GAP
    score, start = np.zeros(width, np.int64), np.arange(width)
    best = (0, 0, 0)
    # scores and starts travel in one number, so that a maximum carries its start along
    base = 1 << 32
    packed = score * base - start
    for w in item.tolist():
        same = window == w
        step = np.where(same, MATCH, MISMATCH)
        diagonal = packed[:-1] + step * base
        fresh = -np.arange(width, dtype=np.int64)
        now = np.maximum(packed + GAP * base, fresh)
        now[1:] = np.maximum(now[1:], diagonal)
        now = np.maximum.accumulate(now + steps * base) - steps * base
        now = np.maximum(now, fresh)
        packed = now
        k = int(packed.argmax())
        high = (int(packed[k]) + base - 1) // base
        if high > best[0]:
            best = (high, high * base - int(packed[k]), k)
    return best


@dataclass
class Items:
    ids: list  # item identifiers
    words: list[np.ndarray]  # word hashes of each item
    seeds: dict[int, tuple[np.ndarray, np.ndarray, list]]  # n: sorted hashes, bitmap, (item, place) lists

    @classmethod
    def of(cls, ids: list, texts: list[str], frequency: dict[int, float]) -> Items:
        data, offsets = buffer(pa.array(texts, pa.string()))
        _, _, row, word = tokens(data, offsets)
        lists = [word[row == i] for i in range(len(ids))]
        found: dict[int, dict[int, list]] = {n: defaultdict(list) for n in GRAMS}
        for i, own in enumerate(lists):
            logs = np.log([frequency.get(int(w), 0.0) or 1e-12 for w in own]) if len(own) else np.zeros(0)
            sums = np.concatenate([[0.0], np.cumsum(logs)])
            grams, seeded = {n: _grams(own, n) for n in GRAMS}, False
            for p in range(len(own)):
                for n in GRAMS:
                    if p + n <= len(own) and sums[p + n] - sums[p] <= np.log(RARE):
                        found[n][int(grams[n][p])].append((i, p))
                        seeded = True
                        break
            if len(own) and not seeded:
                found.setdefault(len(own), defaultdict(list))[int(_grams(own, len(own))[0])].append((i, 0))
        seeds = {}
        for n, by in found.items():
            hashes = np.array(sorted(by), np.uint64)
            marks = np.zeros(1 << 20, bool)
            marks[hashes >> np.uint64(44)] = True
            seeds[n] = hashes, marks, [by[int(h)] for h in hashes]
        return cls(ids, lists, seeds)

    def hits(self, col: pa.Array, least: float = LEAST) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, begin word, end word): the best passage of each item in each text, if it reaches `least`."""
        data, offsets = buffer(col)
        _, _, row, word = tokens(data, offsets)
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        near: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, (hashes, marks, places) in self.seeds.items():
            if not len(hashes) or len(word) < n:
                continue
            grams = _grams(word, n)
            at = np.flatnonzero(marks[grams >> np.uint64(44)])
            at = at[row[at] == row[at + n - 1]]
            k = np.minimum(np.searchsorted(hashes, grams[at]), len(hashes) - 1)
            ok = hashes[k] == grams[at]
            for p, s in zip(at[ok].tolist(), k[ok].tolist(), strict=True):
                for item, q in places[s]:
                    near[int(row[p]), item].append(p - q)
        out = []
        for (r, item), diagonals in sorted(near.items()):
            own = self.words[item]
            slack = len(own) // 2 + 4
            low, high = int(bounds[r]), int(bounds[r + 1])
            windows: list[list[int]] = []
            for d in sorted(set(diagonals)):
                a, b = max(low, d - slack), min(high, d + len(own) + slack)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            best = max(((*align(own, word[a:b]), a) for a, b in windows), key=lambda x: (x[0], -x[3]))
            score = best[0] / (MATCH * len(own))
            if score >= least:
                out.append((r, item, score, best[3] + best[1] - low, best[3] + best[2] - low))
        return out


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, float]:
    """Share of each word of a sorted vocabulary among all words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros(len(vocabulary), np.int64), 0
        for part in slices(batches, "text"):
            word = tokens(*buffer(part.column(0)))[3]
            total += len(word)
            if len(vocabulary):
                k = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
                sums += np.bincount(k[vocabulary[k] == word], minlength=len(vocabulary))
        if total:
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(sums[some], total))], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    total = counts.pop(-1, 0)
    return {int(vocabulary[k]): n / total for k, n in counts.items()}


def load(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in chunks that fit in memory, each with its seeds."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-size // CHUNK_BYTES)
    for c in range(chunks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        texts = [r["text"] for r in rows]
        vocabulary = np.unique(tokens(*buffer(pa.array(texts, pa.string())))[3])
        yield Items.of([r["item_id"] for r in rows], texts, _frequencies(docs, vocabulary))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Per document and item it holds a copy of: doc_id, item_id, score, begin_word, end_word."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, score double, begin_word bigint, end_word bigint"
    out = spark.createDataFrame([], schema)
    for items in load(docs, benchmark):
        shared = spark.sparkContext.broadcast(items)  # at most CHUNK_BYTES of text

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                found = shared.value.hits(part.column(1), least)
                if found:
                    doc_ids = part.column(0).to_pylist()
                    rows = [(doc_ids[r], shared.value.ids[i], s, a, b) for r, i, s, a, b in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "begin_word", "end_word"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(find, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents without those that hold a copy of an item; all columns stay."""
    for items in load(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        place = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                mask = np.ones(part.num_rows, bool)
                mask[[r for r, *_ in shared.value.hits(part.column(place), least)]] = False
                yield part.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
