"""Helpers shared by the training-data operators: shared folders, Arrow slices, text buffers and hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder's URI in the place every executor shares.

    The session's spark.checkpoint.dir names that place; only where it is unset and everything runs in one process
    (tests) a temporary folder is made once for this process. On a cluster a folder of one machine would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="chunkwright-"))
        base = _fallback[0]
    return f"{base.rstrip('/')}/cw-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and plain path behind a URI (file, hdfs, s3, gs ...)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"/{uri}")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a text or binary column holds about `most` bytes at once (a longer row stands alone).

    Between batches and at the end the worker, which lives on for later tasks, gives back what it doesn't use.
    """
    for batch in batches:
        trim()
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(lengths(col))
        begin = 0
        while begin < n:
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
        del batch, col
    trim()


def trim() -> None:
    """Return free memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each value; null counts 0."""
    out = pc.fill_null(pc.binary_length(col), 0)
    return out.to_numpy(zero_copy_only=False).astype(np.int64)


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls as empty; offsets start at 0 and have one more entry than rows."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    """A string column over given bytes without a copy."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated aranges: for each i the numbers starts[i] .. starts[i] + counts[i] - 1."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - before, counts)


#: ASCII white space: the separators of words.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space: (begin, end) in the buffer and the row of each word."""
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    begin = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, begin, side="right") - 1
    return begin, end, row


_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _C1
        x = (x ^ (x >> np.uint64(29))) * _C2
        return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of the buffer, from sums of scrambled (byte, place) pairs; spans may not overlap."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    place = ranges(np.zeros(len(begin), np.int64), size)
    code = data[ranges(begin, size)].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(8))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix(code + np.uint64(1)), np.cumsum(size) - size)
    return mix(sums + size.astype(np.uint64))
