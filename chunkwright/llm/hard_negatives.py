"""Hard negatives for retrieval training: for anchors and their nearest rows of the same label, the nearest rows of other labels within a window.

Scores are inner products of all anchors with all rows, as a matrix product in two dimensions: rows and anchors are cut into blocks, and
vectors into chunks of dimensions. A task multiplies one chunk of an anchor block with the same chunk of a row block; the partial tiles of
64-bit scores are shuffled by (anchor block, row block) and added; a tile is then cut down to its best rows for each anchor (and, for negatives,
for each positive's window) before those of all tiles meet in a window with a rank limit. Memory is that of a few tiles at any size.

Blocks hold rows in order of label. Positives come from pairs of blocks that share a label and negatives from pairs that have two different ones, so
that the product is done about once.

Rows: those with a null label, a null vector, or a null or non-finite component take no part. Shorter vectors count as if filled with zeros. Rows of the anchor's own vec_id are
no other rows; each row of a repeated vec_id is a row, and an anchor, of its own. Rows without a vec_id come last among equal scores and are never
anchors. Scores must fit 64 bits: scaled components beyond that raise an error. Columns of other names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.llm.common import materialise
from chunkwright.operators import scan

ANCHORS, ROWS, DIMS = 256, 2048, 32
#: Place of a row without vec_id among equal scores.
LAST = np.iinfo(np.int64).max
BLOCK = "block bigint, chunk int, labels array<bigint>, n int, width int, data binary, ids binary, marks binary, tags binary"


def scaled(rows: DataFrame, scale: int = 256, relabel: tuple[int, int] | None = (7, 10)) -> DataFrame:
    """(vec_id, label, v): rows that take part, components floor(scale * x); labels of every relabel[0]-th vec_id move on by one modulo relabel[1]."""
    label = F.col("label").cast("bigint")
    if relabel:
        label = F.when(F.col("vec_id") % relabel[0] == 0, (label + 1) % relabel[1]).otherwise(label)
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    wide = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), wide.alias("v"))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the fewest bytes that hold them."""
    for kind in (np.int8, np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _chunked(dims: int):  # noqa: ANN202
    """The rows of a block as its chunks."""

    def make(table: pa.Table) -> pa.Table:
        ids, labels, tags = (table.column(c).combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "tag"))
        vectors = table.column("v").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        data = np.zeros((len(ids), -(-max(1, int(sizes.max())) // dims) * dims), np.int64)
        inside = np.arange(data.shape[1])[None, :] < sizes[:, None]
        data[inside] = vectors.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")  # so that a stable sort by score leaves ties by vec_id
        rows = []
        for k in range(data.shape[1] // dims):
            chunk = _narrow(data[order, k * dims : (k + 1) * dims])
            facts = [x[order].tobytes() if k == 0 else None for x in (ids, labels, tags)]
            rows.append((table.column("block")[0].as_py(), k, np.unique(labels).tolist(), len(ids), chunk.dtype.itemsize, chunk.tobytes(), *facts))
        return pa.Table.from_pydict(dict(zip(OUT.names, map(list, zip(*rows, strict=True)), strict=True)), schema=OUT)

    return make


OUT = pa.schema([
    ("block", pa.int64()), ("chunk", pa.int32()), ("labels", pa.list_(pa.int64())), ("n", pa.int32()), ("width", pa.int32()),
    ("data", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary()), ("tags", pa.binary()),
])


def blocks(rows: DataFrame, height: int, dims: int, name: str) -> DataFrame:
    """Chunks of blocks of `height` rows (vec_id, label, v, tag) each, in order of label, as a table."""
    placed = scan.running(rows.select("vec_id", "label", "v", "tag"), [], ["label", "vec_id", "tag"], {"place": (F.lit(1), "count")}, most=4 * height)
    dealt = placed.withColumn("block", F.floor((F.col("place") - 1) / height)).drop("place")
    return materialise(dealt.groupBy("block").applyInArrow(_chunked(dims), BLOCK), name)


def _matrix(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"i{width}")).reshape(n, -1)


def _top(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: in floating point where all sums stay below 2^53."""
    most = float(np.abs(a.astype(np.float64)).sum(axis=1).max(initial=0)) * _top(b)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("a score may not fit 64 bits: components are too large")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial tiles of block pairs that meet in a chunk."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in ("i", "j", "n", "width", "data", "n2", "width2", "data2")}
            tile = _product(_matrix(row["data"], row["n"], row["width"]), _matrix(row["data2"], row["n2"], row["width2"]))
            yield pa.RecordBatch.from_pydict({"i": [row["i"]], "j": [row["j"]], "tile": [tile.tobytes()]}, schema=TILE)


TILE = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("tile", pa.binary())])


def _partial_tiles(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, tile) partial score tiles of the wanted pairs of blocks, eight or so to a task."""
    tasks = max(1, -(-pairs.count() // 8)) * (a.agg(F.max("chunk")).first()[0] + 1 if not a.isEmpty() else 1)
    left = a.select(F.col("block").alias("i"), "chunk", "n", "width", "data").join(pairs, "i")
    right = b.select(F.col("block").alias("j"), "chunk", F.col("n").alias("n2"), F.col("width").alias("width2"), F.col("data").alias("data2"))
    met = left.repartition(tasks, "j", "chunk").join(right.repartition(tasks, "j", "chunk"), ["j", "chunk"])
    return met.select("i", "j", "n", "width", "data", "n2", "width2", "data2").mapInArrow(_partial, "i bigint, j bigint, tile binary")


def _pairs(a: DataFrame, b: DataFrame, wanted: Column) -> DataFrame:
    """(i, j): pairs of blocks to multiply. One row per block goes into this: the query set's blocks, and all rows'."""
    left = a.where("chunk = 0").select(F.col("block").alias("i"), "labels")
    right = b.where("chunk = 0").select(F.col("block").alias("j"), F.col("labels").alias("labels2"))
    return left.crossJoin(right).where(wanted).select("i", "j")  # the stated query set against all rows, in blocks


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best allowed scores; of equal ones those that stand first."""
    at = np.flatnonzero(allowed)
    if len(at) > 4 * k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _within(scores: np.ndarray, allowed: np.ndarray, bounds: list[tuple[int, int]], k: int) -> list[np.ndarray]:
    """For each (low, high) the places of the k best allowed scores between them."""
    return [_best(scores, allowed & (scores >= low) & (scores <= high), k) for low, high in bounds]


def _reduced(kind: str, keep: int, low: int, high: int):  # noqa: ANN202
    """For a tile's chunks (which are added) the best rows per anchor: `kind` positives, or negatives in each positive's window."""

    def window(score: int) -> tuple[int, int]:
        least, most = -(-low * score // 100), high * score // 100  # ceiling and floor
        return max(least, -(1 << 63)), min(most, (1 << 63) - 1)

    def reduce(table: pa.Table) -> pa.Table:
        first = {c: next(x for x in table.column(c).to_pylist() if x is not None) for c in ("n", "ids", "marks", "tags", "ids2", "marks2")}
        bounds = next((x for x in table.column("positives").to_pylist() if x is not None), None)
        tile, reach = None, 0
        for part in table.column("tile"):
            if part.is_valid:
                values = np.frombuffer(part.as_buffer(), np.int64)
                reach += _top(values)
                if reach >= 1 << 63:
                    raise OverflowError("a score may not fit 64 bits: components are too large")
                tile = values.copy() if tile is None else np.add(tile, values, out=tile)
        tile = tile.reshape(first["n"], -1)
        ids, marks, tags, ids2, marks2 = (np.frombuffer(first[c], np.int64) for c in ("ids", "marks", "tags", "ids2", "marks2"))
        out: list[tuple[int, int, int | None, int]] = []
        if kind == "positive":
            for a in range(len(ids)):
                for b in _best(tile[a], (marks2 == marks[a]) & (ids2 != ids[a]), keep):
                    out.append((int(tags[a]), 0, int(ids2[b]), int(tile[a, b])))
        else:
            by_tag: dict[int, list[tuple[int, int]]] = {}
            for p in bounds or []:
                by_tag.setdefault(p["tag"], []).append((p["place"], p["score"]))
            for a in range(len(ids)):
                mine = by_tag.get(int(tags[a]), [])
                for (place, _), found in zip(mine, _within(tile[a], marks2 != marks[a], [window(s) for _, s in mine], keep), strict=True):
                    out += [(int(tags[a]), place, int(ids2[b]), int(tile[a, b])) for b in found]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"tag": pa.array(cols[0], pa.int64()), "place": pa.array(cols[1], pa.int32()), "other": pa.array([None if x == LAST else x for x in cols[2]], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    return reduce


def _candidates(a: DataFrame, b: DataFrame, pairs: DataFrame, reduce, positives: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """(tag, place, other, score): what is left of each tile once its partial tiles are added."""
    heads = a.where("chunk = 0").select(F.col("block").alias("i"), "n", "ids", "marks", "tags")
    if positives is not None:
        heads = heads.join(positives, "i", "left")
    else:
        heads = heads.withColumn("positives", F.lit(None).cast("array<struct<tag:bigint,place:int,score:bigint>>"))
    tails = b.where("chunk = 0").select(F.col("block").alias("j"), F.col("ids").alias("ids2"), F.col("marks").alias("marks2"))
    facts = pairs.join(heads, "i").join(tails, "j").withColumn("tile", F.lit(None).cast("binary"))
    names = ["i", "j", "tile", "n", "ids", "marks", "tags", "positives", "ids2", "marks2"]
    tiles = _partial_tiles(a, b, pairs).withColumns({c: F.lit(None).cast(facts.schema[c].dataType) for c in names[3:]})
    whole = facts.select(*names).unionByName(tiles.select(*names))
    return whole.groupBy("i", "j").applyInArrow(reduce, "tag bigint, place int, other bigint, score bigint")


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    """The best rows of each anchor and place over all tiles, ranked; a task passes on no more than `keep` of each."""
    w = Window.partitionBy("tag", "place").orderBy(F.desc("score"), F.col("other").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, heights: tuple[int, int] = (ANCHORS, ROWS), dims: int = DIMS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, v) and a condition for anchors.

    A negative's score lies between `low` and `high` hundredths of the positive's.
    """
    rows = materialise(rows.withColumn("tag", F.monotonically_increasing_id()), "rows")
    a = blocks(rows.where(is_anchor), heights[0], dims, "anchors")
    b = blocks(rows, heights[1], dims, "blocks")
    pairs = materialise(_pairs(a, b, F.arrays_overlap("labels", "labels2")), "near_pairs")
    best = materialise(_ranked(_candidates(a, b, pairs, _reduced("positive", positives, low, high)), positives).select("tag", F.col("rank").cast("int").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    where = a.where("chunk = 0").select(F.col("block").alias("i"), "tags")
    # a block's positives: at most its height times their number
    tagged = where.mapInArrow(_unpacked, "i bigint, tag bigint")
    by_block = tagged.join(best, "tag").groupBy("i").agg(F.collect_list(F.struct("tag", "place", F.col("positive_score").alias("score"))).alias("positives"))
    apart = (F.size("labels") > 1) | (F.size("labels2") > 1) | ~F.arrays_overlap("labels", "labels2")
    pairs = materialise(_pairs(a, b, apart), "far_pairs")
    found = _ranked(_candidates(a, b, pairs, _reduced("negative", negatives, low, high), materialise(by_block, "windows")), negatives)
    named = rows.where(is_anchor).select("tag", F.col("vec_id").alias("anchor_id")).join(best, "tag")
    return found.join(named, ["tag", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, tags in zip(batch.column("i").to_pylist(), batch.column("tags").to_pylist(), strict=True):
            own = np.frombuffer(tags, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own)], ["i", "tag"])
