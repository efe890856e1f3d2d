"""k-means whose result doesn't depend on how rows are partitioned.

Vectors become integers (fixed point), so that sums and inner products are exact and their order doesn't matter. Seeds are drawn by k-means++ from a
bounded sample, the rows of the least hash; each round adds up every cluster's members over tasks, which send one row of sums per cluster and dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.operators import scan

#: Rows that seeds are drawn from.
SAMPLE = 8192
#: Vectors that a task holds as numbers at once.
SLICE = 4096


@dataclass(frozen=True)
class Clusters:
    """Centres in fixed point: [cluster, dimension], and the factor that made components integers."""

    centres: np.ndarray
    factor: float

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row of fixed-point vectors; of equally near ones the first."""
        # all numbers stay below 2^53, so that floating point is exact
        c = self.centres.astype(np.float64)
        return ((c * c).sum(1)[None, :] - 2 * (x.astype(np.float64) @ c.T)).argmin(1)

    def token(self, features: str) -> Column:
        """A column of cluster numbers; null where there is no vector."""

        @F.arrow_udf("int")
        def assign(vectors: pa.Array) -> pa.Array:
            out = []
            for at in range(0, len(vectors), SLICE):
                part = vectors.slice(at, SLICE)
                out.append(pa.array(self.nearest(fixed(part, self.centres.shape[1], self.factor)).astype(np.int32), mask=part.is_null().to_numpy(zero_copy_only=False)))
            return pa.concat_arrays(out) if out else pa.array([], pa.int32())

        return assign(F.transform(features, lambda x: x.cast("double")))

    def vectors(self) -> np.ndarray:
        return self.centres / self.factor


def fixed(vectors: pa.Array, dims: int, factor: float) -> np.ndarray:
    """Rows of integers, rounded; nulls, NaN and what a short vector lacks are 0, and components beyond `dims` don't count."""
    sizes = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count:
        sizes = np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    values = np.nan_to_num(vectors.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), dims), np.int64)
    good = place < dims
    out[row[good], place[good]] = np.rint(values[good] * factor)
    return out


def seeds(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over different rows of integers: each next one with a chance in proportion to its squared distance from those so far."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = None
    while len(chosen) < min(k, len(x)):
        apart = ((x - x[chosen[-1]]) ** 2).sum(1)
        far = apart if far is None else np.minimum(far, apart)
        mass = np.cumsum((far >> max(0, int(far.max()).bit_length() - 40)) + (far > 0))
        chosen.append(int(np.searchsorted(mass, rng.integers(mass[-1]), side="right")))
    return x[chosen]


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different vectors of the least hashes, up to SAMPLE."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            held = pa.Table.from_batches([*(held.to_batches() if held else []), batch])
            _, first = np.unique(held.column("h").to_numpy(), return_index=True)
            held = held.take(pa.array(first[:SAMPLE])).combine_chunks()
    if held:
        yield from held.to_batches()


def moved(centres: np.ndarray, sums: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Centres at the means of their members, from (cluster, dimension, sum, n); without members they stay."""
    out = centres.copy()
    for c, d, total, n in sums:
        out[c, d] = (2 * total + n) // (2 * n)  # rounded, in integers
    return out


def fit(rows: DataFrame, features: str, k: int, seed: int = 42, rounds: int = 20) -> Clusters | None:
    """Clusters of the vectors; fewer than k where fewer different vectors are in the sample. None without vectors."""
    table = scan.kept(rows.where(F.col(features).isNotNull()).select(F.transform(features, lambda x: x.cast("double")).alias("v")))
    finite = F.filter(F.transform("v", lambda x: F.abs(x)), lambda x: x < F.lit(float("inf")))
    dims, top = table.agg(F.max(F.size("v")), F.max(F.array_max(finite))).first()
    if not dims:
        return None
    bits = (51 - int(dims).bit_length()) // 2
    factor = (2.0**bits - 1) / max(float(top or 0), 1e-300)
    factor = factor if np.isfinite(factor) else 1.0
    # copies of one vector count once: a task passes on no more than SAMPLE different ones
    few = table.select(F.xxhash64("v").alias("h"), "v").mapInArrow(_least, "h bigint, v array<double>").dropDuplicates(["h"])
    sample = few.orderBy("h").limit(SAMPLE).toArrow().column("v").combine_chunks()
    found = Clusters(seeds(fixed(sample, dims, factor), k, seed), factor)
    for _ in range(rounds):
        held = table.sparkSession.sparkContext.broadcast(found)  # k times dims numbers

        def gather(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            model = held.value
            sums, n = np.zeros_like(model.centres), np.zeros(len(model.centres), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    x = fixed(batch.column(0).slice(at, SLICE), model.centres.shape[1], model.factor)
                    near = model.nearest(x)
                    np.add.at(sums, near, x)
                    n += np.bincount(near, minlength=len(n))
            c, d = np.nonzero(np.broadcast_to(n[:, None] > 0, sums.shape))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(sums[c, d]), pa.array(n[c])], ["c", "d", "total", "n"])

        sums = table.mapInArrow(gather, "c int, d int, total bigint, n bigint").groupBy("c", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        centres = moved(found.centres, [tuple(r) for r in sums])
        if np.array_equal(centres, found.centres):
            break
        found = Clusters(centres, factor)
    return found
