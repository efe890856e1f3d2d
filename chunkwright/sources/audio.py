"""Wav files by sample ranges: a file's header is read first, its samples by as many tasks as they need."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.sources.stores import kept, opened

#: Bytes of samples that a task reads at once.
RANGE = 8 << 20
HEADS = "path string, rate int, channels int, width int, floats boolean, begin bigint, frames bigint, error string"
CHUNKS = "file string, start_time float, sample_rate int, samples array<float>, error string"


def wav_head(source, length: int) -> tuple[int, int, int, bool, int, int]:  # noqa: ANN001
    """(rate, channels, bytes a sample, whether samples are 32-bit floats, where they begin, frames) from a file's RIFF chunks; what lies between them is passed over."""
    source.seek(0)
    kind, _, form = struct.unpack("<4sI4s", source.read(12))
    if kind != b"RIFF" or form != b"WAVE":
        raise ValueError("no RIFF WAVE header")
    at, shape = 12, None
    while at + 8 <= length:
        source.seek(at)
        name, size = struct.unpack("<4sI", source.read(8))
        if name == b"fmt ":
            tag, channels, rate, _, block, _ = struct.unpack("<HHIIHH", source.read(16))
            if tag not in (1, 3, 0xFFFE) or not channels or block % channels or block // channels not in ((4,) if tag == 3 else (1, 2, 4)) or not rate:
                raise ValueError(f"samples of format {tag}, {block} bytes a frame")
            shape = rate, channels, block // channels, tag == 3
        elif name == b"data":
            if shape is None:
                raise ValueError("samples before their format")
            # a stream's header may promise more than there is
            return *shape, at + 8, min(size, length - at - 8) // (shape[1] * shape[2])
        at += 8 + size + size % 2
    raise ValueError("no samples")


def samples_of(raw: bytes, channels: int, width: int, floats: bool = False) -> np.ndarray:
    """Mono samples in -1 .. 1 of PCM bytes or 32-bit floats; channels are averaged."""
    if floats:
        x = np.frombuffer(raw, "<f4")
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return x if channels == 1 else x.reshape(-1, channels).mean(axis=1)  # a mean loses the sign of zero


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                system, name = opened(path)
                with system.open_input_file(name) as source:
                    rows.append((path, *wav_head(source, length), None))
            except Exception as e:  # noqa: BLE001  any broken file becomes a row of its own
                rows.append((path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], [c.split()[0] for c in HEADS.split(", ")])


def _read(seconds: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = (pa.string(), pa.float32(), pa.int32(), pa.list_(pa.float32()), pa.string())
        for batch in batches:
            for r in batch.to_pylist():
                name = r["path"].rsplit("/", 1)[-1]
                if r["error"] is not None:
                    rows = [(name, None, None, None, r["error"])]
                else:
                    size, frame = int(r["rate"] * seconds), r["channels"] * r["width"]
                    first, stop = r["from"] * size, min(r["frames"], (r["from"] + r["many"]) * size)
                    system, path = opened(r["path"])
                    with system.open_input_file(path) as source:
                        source.seek(r["begin"] + first * frame)
                        x = samples_of(source.read((stop - first) * frame), r["channels"], r["width"], r["floats"])
                    x = np.pad(x, (0, -len(x) % size)).reshape(-1, size)
                    rows = [(name, (r["from"] + i) * size / r["rate"], r["rate"], row, None) for i, row in enumerate(x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def wav_chunks(spark: SparkSession, folder: str, seconds: float = 5.0, most: int = RANGE) -> DataFrame:
    """Chunks of all wav files of a folder, the last of a file padded with zeros; a file that can't be read gives one row with its error.

    Listing reads no content. A header is read by itself, and chunks are dealt in ranges of `most` bytes, so that neither a task nor a row holds a file. Files
    must be in a store that Arrow opens.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "length")
    heads = kept(listed.mapInArrow(_heads, HEADS))
    size = F.floor(F.col("rate") * seconds)
    count = F.ceil(F.col("frames") / size)
    many = F.greatest(F.lit(1), F.floor(F.lit(most) / (size * F.col("channels") * F.col("width"))))
    good = heads.where("error is null and frames > 0").withColumns({"many": many, "_count": count})
    tasks = good.agg(F.sum(F.ceil(F.col("_count") / F.col("many"))), F.count(F.lit(1))).first()
    dealt = good.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1, F.col("many"))).alias("from")).drop("_count")
    broken = heads.where("error is not null").withColumns({"many": F.lit(1).cast("bigint"), "from": F.lit(0).cast("bigint")})
    # small files share tasks, ranges of large ones don't
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tasks[0] or 0) - int(tasks[1] or 0))
    return dealt.unionByName(broken).repartition(n, "path", "from").mapInArrow(_read(seconds), CHUNKS)


def write_wavs(rows: DataFrame, folder: str, file: str, samples: str, rate: int, floats: bool = False) -> DataFrame:
    """(file): each row's samples (-1 .. 1), in steps of 16 bits, as a mono file of 16-bit integers, or of 32-bit floats, which keep a negative zero. NaN counts as the highest step. A task that runs again writes the same bytes to the same name."""

    kind, width = (3, 4) if floats else (1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = x.values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) if x.is_valid else np.zeros(0)
                steps = np.fmax(np.fmin(np.rint(values * 32768), 32767), -32768)
                raw = ((steps / 32768).astype("<f4") if floats else steps.astype("<i2")).tobytes()
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, kind, 1, rate, width * rate, width, 8 * width, b"data", len(raw)) + raw)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["file"])

    return rows.select(F.col(file).cast("string").alias("file"), F.transform(samples, lambda x: x.cast("float")).alias("samples")).mapInArrow(run, "file string")
