"""Operator 10, best-fit packing: hierarchical residual packing of token pieces into sequences of fixed capacity.

Each partition packs its own pieces best-fit (longest first) and emits nearly full bins. Underfull bins then
climb a tree: `FAN` partitions meet in one node, whose items are whole bins; best-fit again, emit the nearly
full, send the rest up. Only (bin, tokens used) travels, never the tokens. A node with more than `NODE` underfull
bins is several tasks' work; what these leave goes up like the rest, and at the top further rounds deal it anew
as long as more than one task's items are left and a round still merges some. So no task holds more than about
`NODE` small items, however large the input, and no bin is given up early.

Rows: a null text is the end id alone; a long text is cut into full pieces and a rest. Repeated rows are packed as
often as they occur. No piece is empty. An empty table gives no rows. Of documents only doc_id and text are read,
whatever other columns are called.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.llm.common import materialise, slices
from chunkwright.llm.tokens import word_encoder

CAPACITY = 2048
FAN = 8
#: Rows that a partition packs at once, and their bytes (token ids count); underfull bins that a task merges at once.
GROUP, GROUP_BYTES, NODE = 200_000, 64 << 20, 400_000
#: Share of its bins that a round at the top must merge for another one to follow.
WORTH = 0.01
#: Bins with at most this share of room left are emitted at once.
ROOM = 1 / 256


class BestFit:
    """Bins by room left; an item goes to the fullest bin that holds it, else to a new one."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []  # sorted rooms that some bin has
        self.by_room: dict[int, list[int]] = {}
        self.used: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """(bin, place in it) of an item."""
        k = bisect_left(self.rooms, size)
        if k == len(self.rooms):
            which, at = len(self.used), 0
            self.used.append(0)
            room = self.capacity
        else:
            room = self.rooms[k]
            bins = self.by_room[room]
            which = bins.pop()
            at = self.used[which]
            if not bins:
                del self.by_room[room], self.rooms[k]
        self.used[which] += size
        left = room - size
        if left:
            if left not in self.by_room:
                self.rooms.insert(bisect_left(self.rooms, left), left)
                self.by_room[left] = []
            self.by_room[left].append(which)
        return which, at


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and place of each item, and tokens used of each bin."""
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    full = BestFit(capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], places[i] = full.place(int(sizes[i]))
    return bins, places, np.array(full.used, np.int64)


def _cutter(tokenizer: str | None, end_id: int, capacity: int, with_ids: bool) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """The step from (doc_id, text) to pieces, and the pieces' schema."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for part in slices(batches, "text", 4 << 20):
            coder = coder or word_encoder(tokenizer)
            ids, offsets = coder.encode(part.column(1))
            raw = ids.astype("<u4").tobytes()
            end = np.array([end_id], "<u4").tobytes()
            out: list[list] = [[] for _ in names]
            for doc_id, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                whole = raw[4 * a : 4 * b] + end
                for k in range(0, b - a + 1, capacity):
                    body = whole[4 * k : 4 * (k + capacity)]
                    for c, v in zip(out, (doc_id, k // capacity, k, len(body) // 4, zlib.crc32(body), body), strict=False):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)

    return cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode documents, append the end id, cut what is longer than a sequence: one row per piece."""
    return _texts(docs).mapInArrow(*_cutter(tokenizer, end_id, capacity, with_ids))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Place rows with a length of 1 to `capacity`: adds sequence_id and offset; a sequence is gapless from 0."""
    return _merge(_pack_partitions(items, items.schema, capacity, length), capacity, length)


def _merge(local: DataFrame, capacity: int, length: str) -> DataFrame:
    """Merge the underfull bins of packed partitions."""
    names = [c for c in local.columns if c not in ("bin", "at", "part", "climbs")]
    local = materialise(local, "packed")
    moves = _climb(local.where("climbs").groupBy("bin", "part").agg(F.sum(length).cast("bigint").alias("used")), capacity)
    bins = local.drop("climbs", "part")
    if moves is None:
        return bins.withColumnRenamed("bin", "sequence_id").withColumnRenamed("at", "offset")
    joined = bins.join(moves, "bin", "left")
    return joined.select(
        *names,
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def _pack_partitions(rows: DataFrame, items: T.StructType, capacity: int, length: str, before: Callable | None = None) -> DataFrame:
    """Best-fit in each partition, `GROUP` items at a time so that memory stays bounded.

    `before` makes the items from the rows in the same worker; as a step of its own it would hold a second worker per core.
    """
    schema = T.StructType([*items.fields, T.StructField("bin", T.LongType()), T.StructField("at", T.LongType()), T.StructField("part", T.LongType()), T.StructField("climbs", T.BooleanType())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made = 0

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            table = pa.Table.from_batches(held).combine_chunks()
            bins, at, used = best_fit(table[length].to_numpy(), capacity)
            keep = capacity - used <= capacity * ROOM
            cols = {"bin": (part << 36) + made + bins, "at": at, "part": np.full(len(bins), part), "climbs": ~keep[bins]}
            made += len(used)
            for name, c in cols.items():
                table = table.append_column(name, pa.array(c))
            yield from table.to_batches(max_chunksize=10_000)

        held, count, size = [], 0, 0
        for batch in before(batches) if before else batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
                size += batch.nbytes
            if count >= GROUP or size >= GROUP_BYTES:
                yield from done(held)
                held, count, size = [], 0, 0
        if held:
            yield from done(held)

    return rows.mapInArrow(fit, schema)


def _climb(bins: DataFrame, capacity: int) -> DataFrame | None:
    """Merge underfull bins up the tree: (bin, into, shift) of all that moved; None if there are none."""
    bins = materialise(bins, "underfull")
    left, top = bins.agg(F.count(F.lit(1)), F.max("part")).first()
    if not left:
        return None
    moved: DataFrame | None = None
    parts, turn, level = top + 1, 0, bins.select("bin", "used", "part")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of (node, task)."""
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).sort_by([("used", "descending"), ("bin", "ascending")])
            names, sizes = own["bin"].to_numpy(), own["used"].to_numpy()
            which, at, used = best_fit(sizes, capacity)
            first = np.full(len(used), -1, np.int64)
            first[which[::-1]] = names[::-1]  # a merged bin is called by its first member, which lies at 0
            climbs = capacity - used > capacity * ROOM
            return pa.RecordBatch.from_pydict({"bin": names, "into": first[which], "shift": at, "used": used[which], "node": own["node"].combine_chunks(), "climbs": climbs[which]})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in (2, 3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if held and [held[0].column(k)[0].as_py() for k in (2, 3)] != keys[:, a].tolist():
                    yield done()
                    held.clear()
                held.append(part)
        if held:
            yield done()

    while True:
        parts, turn = -(-parts // FAN), turn + 1
        dealt = level.select("bin", "used", F.floor(F.col("part") / FAN).cast("bigint").alias("node"))
        sizes = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"))  # a row for each node
        dealt = dealt.join(sizes, "node").select("bin", "used", "node", F.pmod(F.xxhash64("bin", F.lit(turn)), F.ceil(F.col("n") / NODE)).cast("bigint").alias("task"))
        dealt = dealt.repartition(max(parts, -(-left // NODE)), "node", "task").sortWithinPartitions("node", "task")
        step = materialise(dealt.mapInArrow(merge, "bin bigint, into bigint, shift bigint, used bigint, node bigint, climbs boolean"), f"level-{turn}")
        gone = step.select("bin", "into", "shift")
        if moved is None:
            moved = gone
        else:
            after = gone.select(F.col("bin").alias("into"), F.col("into").alias("further"), F.col("shift").alias("more"))
            moved = moved.join(after, "into", "left").select("bin", F.coalesce("further", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        level = step.where("climbs and bin = into").select("bin", "used", F.col("node").alias("part"))
        before, left = left, level.count()
        if not left or (parts == 1 and (before <= NODE or left > (1 - WORTH) * before)):
            return moved


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut, schema = _cutter(tokenizer, end_id, capacity, with_ids)
    return _merge(_pack_partitions(_texts(docs), T.StructType.fromDDL(schema), capacity, "length", cut), capacity, "length")
