"""Signals to features: chunks, MFCC vectors, scaling, cluster tokens, and image sharpness."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.scalar import basename, chunked, laplacian, variance
from chunkwright.operators import clusters

CHUNKS = "file string, start_time float, sample_rate int, samples array<float>, error string"


def chunk_signal(samples: np.ndarray, size: int) -> np.ndarray:
    """Rows of `size` samples, the last padded with zeros."""
    rows = -(-len(samples) // size)
    return np.pad(samples, (0, rows * size - len(samples))).reshape(rows, size)


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1 .. 1 and the sample rate of a PCM file; channels are averaged."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2147483648
    else:
        raise ValueError(f"{width} bytes per sample")
    return x.reshape(-1, channels).mean(axis=1), rate


def audio_chunks(files: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Chunks of wav files from a binaryFile scan; a file that can't be read gives one row with its error."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    x, rate = read_wav(bytes(content))
                    size = int(rate * seconds)
                    rows = [(name, i * size / rate, rate, row, None) for i, row in enumerate(chunk_signal(x, size))]
                except Exception as e:  # noqa: BLE001  any broken file becomes a row of its own
                    rows = [(name, None, None, None, f"{type(e).__name__}: {e}")]
                for at in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[at : at + 64], columns=["file", "start_time", "sample_rate", "samples", "error"])

    return files.select("path", "content").mapInPandas(cut, CHUNKS)


def chunk_arrays(rows: DataFrame, key: str, values: str, size: int) -> DataFrame:
    """(key, pos, chunk): array columns cut into padded chunks, without Python."""
    return rows.select(key, F.posexplode(chunked(values, size)).alias("pos", "chunk"))


@lru_cache
def _mel(rate: int, n_fft: int, filters: int) -> np.ndarray:
    """Triangular filters, evenly spread on the mel scale from 0 to half the rate: (bins, filters)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, filters + 2) / 2595) - 1)
    edge = np.floor((n_fft + 1) * hz / rate)
    k = np.arange(n_fft // 2 + 1)[:, None]
    left, mid, right = edge[:-2], edge[1:-1], edge[2:]
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = (k - left) / (mid - left), (right - k) / (right - mid)
    return np.where((k >= left) & (k < mid), up, np.where((k >= mid) & (k < right), down, 0.0))


@lru_cache
def _cosines(size: int, kept: int) -> np.ndarray:
    """Orthonormal DCT-II, first rows: (size, kept)."""
    n, k = np.arange(size)[:, None], np.arange(kept)[None, :]
    basis = np.cos(np.pi * (n + 0.5) * k / size) * np.sqrt(2 / size)
    basis[:, 0] = np.sqrt(1 / size)
    return basis


def mfcc_vector(samples: np.ndarray | None, rate: int = 16000, coefficients: int = 13, filters: int = 26, n_fft: int = 512, db_factor: float = 20.0) -> np.ndarray:
    """Mean MFCC of a signal; zeros for an empty one."""
    if samples is None or len(samples) == 0:
        return np.zeros(coefficients)
    x = np.asarray(samples, float)
    x = np.append(x[0], x[1:] - 0.97 * x[:-1])
    size, hop = round(0.025 * rate), round(0.01 * rate)
    frames = max(1, int(np.ceil(abs(len(x) - size) / hop)))
    x = np.pad(x, (0, max(0, frames * hop + size - len(x))))
    cut = np.lib.stride_tricks.sliding_window_view(x, size)[: frames * hop : hop] * np.hamming(size)
    power = np.abs(np.fft.rfft(cut, n_fft)) ** 2 / n_fft
    banks = power @ _mel(rate, n_fft, filters)
    banks = db_factor * np.log10(np.where(banks == 0, np.finfo(float).eps, banks))
    return (banks @ _cosines(filters, coefficients)).mean(axis=0)


def mfcc(rate: int = 16000, coefficients: int = 13):  # noqa: ANN201
    """A column function samples -> array<float>; what can't be computed is zeros."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for samples in part:
                try:
                    v = mfcc_vector(samples, rate, coefficients)
                except (ValueError, TypeError):
                    v = np.zeros(coefficients)
                out.append(v.astype(np.float32))
            yield pd.Series(out)

    return run


def mfcc_vectors(chunks: DataFrame, rate: int = 16000) -> DataFrame:
    """(file, start_time, mfcc) of chunks that have this sample rate."""
    good = chunks.where(F.col("samples").isNotNull() & (F.col("sample_rate") == rate)) if "sample_rate" in chunks.columns else chunks
    return good.select("file", "start_time", mfcc(rate)("samples").alias("mfcc"))


def standard_scale(rows: DataFrame, features: str, out: str = "scaled") -> DataFrame:
    """Each dimension over its sample standard deviation (0 stays 0)."""
    vectors = rows.withColumn("_v", array_to_vector(features))
    model = StandardScaler(inputCol="_v", outputCol="_s", withStd=True, withMean=False).fit(vectors)
    return model.transform(vectors).withColumn(out, vector_to_array("_s")).drop("_v", "_s")


def cluster_count(n: int) -> int:
    """Clusters for n rows: half the rows' root, 20 to 80."""
    return min(max(int((n / 2) ** 0.5), 20), 80)


def cluster_tokens(rows: DataFrame, features: str, k: int | None = None, seed: int = 42, out: str = "token_id") -> tuple[DataFrame, clusters.Clusters | None]:
    """Adds the cluster of each vector, and gives the clusters: the same ones however rows are partitioned. A null vector has no cluster."""
    found = clusters.fit(rows, features, k or cluster_count(rows.where(F.col(features).isNotNull()).count()), seed)
    return rows.withColumn(out, found.token(features) if found else F.lit(None).cast("int")), found


def laplacian_variance(gray: np.ndarray | None) -> float:
    """Sharpness of a gray image: variance of its 3 x 3 Laplacian with mirrored edges; 0 for none."""
    if gray is None or gray.ndim != 2 or not gray.size:
        return 0.0
    g = np.pad(gray.astype(float), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def sharpness(images: DataFrame, pixels: str, width: int, out: str = "blur_score", edge: float = 100.0) -> DataFrame:
    """Adds the sharpness of gray images that are arrays of pixels, row by row, and `status`; nothing leaves the JVM. A null image scores 0."""
    stencil = images.withColumn("_laplacian", laplacian(F.when(F.size(pixels) > 0, F.col(pixels)), width))
    scored = stencil.withColumn(out, F.coalesce(variance("_laplacian"), F.lit(0.0))).drop("_laplacian")
    return scored.withColumn("status", F.when(F.col(out) > edge, "SHARP").otherwise("BLURRY"))


def read_pgm(data: bytes) -> np.ndarray | None:
    """A binary gray (P5) or colour (P6) portable image as gray levels; None if it is neither."""
    try:
        kind, width, height, _, rest = data.split(None, 4) if data[:2] in (b"P5", b"P6") else (b"", 0, 0, 0, b"")
        if not kind:
            return None
        head = data[: len(data) - len(rest)].rstrip()
        body = data[len(head) + 1 :]
        shape = (int(height), int(width))
        if kind == b"P5":
            return np.frombuffer(body, np.uint8, shape[0] * shape[1]).reshape(shape)
        rgb = np.frombuffer(body, np.uint8, 3 * shape[0] * shape[1]).reshape(*shape, 3)
        return np.round(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    except ValueError:
        return None


def blur_scores(images: DataFrame, decode=read_pgm) -> DataFrame:  # noqa: ANN001
    """(image_name, blur_score, status) of a binaryFile scan of images; unreadable ones score 0."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: laplacian_variance(decode(bytes(b)))).astype(float)

    scored = images.select(basename("path").alias("image_name"), score("content").alias("blur_score"))
    return scored.withColumn("status", F.when(F.col("blur_score") > 100, "SHARP").otherwise("BLURRY"))


def frame_requests(chunks: DataFrame, middle: float = 2.5) -> DataFrame:
    """Which frame of which video to grab for each chunk."""
    from chunkwright.functions.scalar import as_double, frame_name

    t = as_double("start_time")
    named = chunks.withColumn("start_time", t).where(t.isNotNull()).withColumn("file", F.replace(F.col("file"), F.lit(".wav"), F.lit(".mp4")))
    return named.select("file", "start_time", (F.col("start_time") + middle).alias("grab_at"), frame_name(F.replace(F.col("file"), F.lit(".mp4"), F.lit("")), "start_time").alias("image_name"))
