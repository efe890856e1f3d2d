"""Large JSON objects, {"key": value, ...}, read and written in pieces.

A file is cut into byte ranges. Whether a range begins inside a string, and how deep, follows from all bytes before it: one pass takes each
range's parity of quotes and its change of depth for either case, running values along a file's ranges (one row each) choose, and a second
pass cuts out the entries that begin in each range. An entry that crosses the end of its range is read on to its own end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwright.sources.stores import kept, opened

RANGE = 32 << 20
QUOTE, SLASH, COMMA, OPEN, CLOSE = (ord(c) for c in '"\\,{}')
CHANGE = np.zeros(256, np.int64)
CHANGE[[OPEN, ord("[")]], CHANGE[[CLOSE, ord("]")]] = 1, -1


def _slashes_before(source, at: int) -> int:  # noqa: ANN001
    """How many backslashes stand directly before a place."""
    found = 0
    while at > 0:
        begin = max(0, at - 4096)
        source.seek(begin)
        part = source.read(at - begin)
        own = len(part) - len(part.rstrip(b"\\"))
        found += own
        if own < len(part):
            break
        at = begin
    return found


def _quotes(data: np.ndarray, slashes: int) -> np.ndarray:
    """Marks of the quotes that aren't escaped."""
    place = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != SLASH, place, -1))
    before = np.r_[-1, other[:-1]]  # the last byte before each place that is no backslash
    run = place - 1 - before + np.where(before < 0, slashes, 0)
    return (data == QUOTE) & (run % 2 == 0)


def _states(data: np.ndarray, slashes: int, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(outside of strings, depth after) of each byte."""
    quotes = _quotes(data, slashes)
    outside = ((int(inside) + np.cumsum(quotes)) % 2 == 0) & ~quotes
    return outside, depth + np.cumsum(np.where(outside, CHANGE[data], 0))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            system, name = opened(r["path"])
            with system.open_input_file(name) as source:
                slashes = _slashes_before(source, r["from"])
                source.seek(r["from"])
                data = np.frombuffer(source.read(r["size"]), np.uint8)
            deltas = [int(_states(data, slashes, bool(k), 0)[1][-1]) for k in (0, 1)]
            out.append((r["path"], r["from"], int(_quotes(data, slashes).sum()) % 2, *deltas))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], ["path", "from", "odd", "out_delta", "in_delta"])


def _bounds(data: np.ndarray, outside: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that begin an entry (the object's brace, commas between entries), and places that end one (those commas, the closing brace)."""
    comma = outside & (data == COMMA) & (depth == 1)
    return np.flatnonzero(comma | (outside & (data == OPEN) & (depth == 1))), np.flatnonzero(comma | (outside & (data == CLOSE) & (depth == 0)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            system, name = opened(r["path"])
            texts: list[bytes] = []
            with system.open_input_file(name) as source:
                at, inside, depth = r["from"], bool(r["inside"]), r["depth"]
                slashes = _slashes_before(source, at)
                source.seek(at)
                raw = source.read(r["size"])
                data = np.frombuffer(raw, np.uint8)
                outside, deep = _states(data, slashes, inside, depth)
                begins, ends = _bounds(data, outside, deep)
                stops = ends[np.minimum(np.searchsorted(ends, begins, side="right"), max(0, len(ends) - 1))] if len(ends) else np.zeros(len(begins), np.int64)
                for b, e in zip(begins.tolist(), stops.tolist(), strict=True):
                    if e > b:
                        texts.append(raw[b + 1 : e])
                        continue
                    held = [raw[b + 1 :]]  # the last entry goes on in the ranges after this one
                    at = r["from"] + len(raw)
                    inside, depth = bool((int(inside) + _quotes(data, slashes).sum()) % 2), int(deep[-1])
                    while True:
                        slashes = _slashes_before(source, at)
                        source.seek(at)
                        more = source.read(1 << 20)
                        if not more:
                            raise ValueError(f"{r['path']} ends inside an entry")
                        part = np.frombuffer(more, np.uint8)
                        outside, deep = _states(part, slashes, inside, depth)
                        _, last = _bounds(part, outside, deep)
                        held.append(more[: int(last[0])] if len(last) else more)
                        if len(last):
                            break
                        inside, depth, at = bool((int(inside) + _quotes(part, slashes).sum()) % 2), int(deep[-1]), at + len(more)
                    texts.append(b"".join(held))
            texts = [t for t in texts if t.strip()]
            for k in range(0, len(texts), 1024):
                yield pa.RecordBatch.from_arrays([pa.array([b"{" + t + b"}" for t in texts[k : k + 1024]], pa.binary()).cast(pa.string())], ["entry"])


def entries(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(entry): each entry of the JSON objects at a path as an object of its own, in text. Files must be in a store that Arrow opens."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = listed.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("from"), F.lit(size).cast("bigint").alias("size"))
    ranges = kept(ranges)
    n = max(1, ranges.count())
    measured = ranges.repartition(n, "path", "from").mapInArrow(_measured, "path string, from bigint, odd int, out_delta bigint, in_delta bigint")
    along = Window.partitionBy("path").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    known = measured.withColumn("inside", F.coalesce(F.bit_xor("odd").over(along), F.lit(0)))
    known = known.withColumn("delta", F.when(F.col("inside") == 1, F.col("in_delta")).otherwise(F.col("out_delta")))
    known = known.select("path", "from", F.lit(size).cast("bigint").alias("size"), "inside", F.coalesce(F.sum("delta").over(along), F.lit(0)).alias("depth"))
    return kept(known).repartition(n, "path", "from").mapInArrow(_cut, "entry string")


def write_objects(rows: DataFrame, path: str, key: str, value: str, one_file: bool = False) -> None:
    """Rows as entries of JSON objects, one object per task's file, an entry a line; in one file where a single one is wanted (then one task streams all rows)."""
    whole = F.to_json(F.create_map(F.col(key).cast("string"), F.col(value)))
    lines = rows.where(F.col(key).isNotNull()).select(F.substring(whole, 2, 1 << 30).alias("line"))
    lines = lines.select(F.expr("left(line, length(line) - 1)").alias("value"))

    def braces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([("," if begun or k else "{") + t for k, t in enumerate(texts)], pa.string())], ["value"])
                begun = True
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array(["}"])], ["value"])

    (lines.coalesce(1) if one_file else lines).mapInArrow(braces, "value string").write.text(path)
