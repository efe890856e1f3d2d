"""Byte-pair training over a corpus of any size.

The corpus is one stream of tokens (bytes at first) in the order of its lines, and merges may cross lines. It lies in blocks of a megabyte,
which are rows of a table. A round counts the pairs of every block and between neighbouring blocks, takes the most frequent ones, and merges
them in all blocks at once. A task adds its blocks' counts up in a table of all pairs, so that it hands on one row per pair. The driver holds
the merges and a bounded number of counts, never text.

A round takes several pairs where that is what one at a time would give. Merging a pair (a, b) changes counts of pairs that meet it, (x, a) and (b, x),
and makes new ones that are no more frequent than those; (a, x) and (x, b) stay, as an a before another token is not merged. So in the order of
counts all pairs up to the first that meets an earlier one may be taken, if they are more frequent than that one (at an equal count a new pair
might stand first).

A corpus of more than a few blocks needs no rounds over its text as long as merges are frequent. Both parts of a merged pair are at least as frequent as
their bytes at the seam: a pair of tokens occurs no more often than the pair of bytes where its parts meet. So no pair of more than `floor` occurrences
lies over a seam of bytes that occurs `floor` times or less, and the text may be cut at all those seams, line ends among them. What is left are
short pieces that come again and again: their different ones, each with its number, stand for the text (a dictionary) as long as the best
pair occurs more than `floor` times. Of pairs that share the highest count the first lines say which stands first. Where that doesn't do (merges
over line ends, or ties that the first lines don't tell apart) the blocks are gone through.

Where a block ends in the first token of a merged pair and the next block begins with its second one, the merged token goes to the first block. Of a run of
one token (a pair of equal tokens) every second place counts, so a run that crosses blocks is counted through from its start.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.operators import scan

Pair = tuple[int, int]
#: Bytes of the corpus in a block; pairs that the driver sees a round; rounds before the blocks are written anew.
BLOCK, SEEN, KEPT = 1 << 20, 256, 4
#: Pairs of tokens up to which a table holds the counts of all of them; with more tokens a block's pairs are sorted.
DENSE = 1 << 22
#: Tokens of a block among which most of its pairs stand first.
FEW = 1 << 16
#: Blocks up to which a corpus is gone through as it is; bytes of text cut at once; short pieces, and bytes of long ones, that a task counts before it hands them on.
SMALL, STEP, HELD = 8, 1 << 20, 1 << 20
#: Lines among which the first of equally frequent pairs is looked for, few at first.
EARLY = (64, 4096)


def merge_pair(ids: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """Every left-to-right, non-overlapping occurrence of a pair replaced by a new id.

    Occurrences overlap only where both parts are equal: in a run of them every second one counts, from its start.
    """
    at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right)) if len(ids) > 1 else np.zeros(0, np.int64)
    if left == right and len(at):
        fresh = np.diff(at, prepend=-2) > 1
        at = at[(at - at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]) % 2 == 0]
    out = ids.copy()
    out[at] = new
    return np.delete(out, at + 1)


def pairs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of neighbours (left << 32 | right), where each stands first, and how often it occurs."""
    return np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_index=True, return_counts=True)


def table_of(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each pair left * width + right of neighbours occurs, and where it stands first (if anywhere); tokens are below `width`."""
    codes = ids[:-1].astype(np.int64)
    codes *= width
    codes += ids[1:]
    first, new = np.full(width * width, -1), np.arange(min(len(codes), FEW))
    first[codes[new[::-1]]] = new[::-1]  # from the end, as the last value of a place stays
    new = len(new) + np.flatnonzero(first[codes[len(new) :]] < 0)  # few pairs don't stand in the beginning
    first[codes[new[::-1]]] = new[::-1]
    return np.bincount(codes, minlength=width * width), first


def best_pair(ids: np.ndarray) -> Pair | None:
    """The most frequent pair of neighbours; of equal ones that which stands first."""
    if len(ids) < 2:
        return None
    keys, first, n = pairs_of(ids)
    at = int(first[n == n.max()].min())
    return int(ids[at]), int(ids[at + 1])


def batch_of(counts: list[tuple[int, int, int]], whole: bool) -> list[Pair]:
    """Pairs to merge in one round, from (left, right, n) in order of count and place; `whole`: there are no others.

    The first always; then those that meet no earlier one (one's left token is the other's right one), down to the first that does, with counts above
    that one's. A pair of equal tokens goes alone, as its merged token may follow itself.
    """
    if not counts:
        return []
    taken, lefts, rights = [counts[0]], {counts[0][0]}, {counts[0][1]}
    floor = 0 if whole else counts[-1][2]
    for left, right, n in counts[1:]:
        if counts[0][0] == counts[0][1] or left == right or left in rights or right in lefts:
            floor = n
            break
        taken.append((left, right, n))
        lefts.add(left)
        rights.add(right)
    return [(left, right) for k, (left, right, n) in enumerate(taken) if k == 0 or n > floor]


def stream_blocks(corpus: DataFrame, order: str, text: str, newline: bool, size: int, kind: str = "int32") -> DataFrame:
    """(block, ids): the lines in order (equal ones by their text) as blocks of bytes; `kind` is the type of an id. Null lines are left out."""
    line = F.concat(F.col(text).cast("string"), F.lit("\n" if newline else ""))
    lines = corpus.where(F.col(text).isNotNull()).select(F.col(order).alias("_order"), line.cast("binary").alias("_line"))
    total = lines.agg(F.sum(F.length("_line"))).first()[0] or 0
    dealt = lines.repartitionByRange(max(1, -(-total // (8 * size))), F.col("_order").asc_nulls_first(), "_line").sortWithinPartitions(F.col("_order").asc_nulls_first(), "_line")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, part = bytearray(), 0, None

        def row(piece: bytes) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number - 1]), pa.array([np.frombuffer(piece, np.uint8).astype(kind).tobytes()], pa.binary())], ["block", "ids"])

        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column(0)[k].as_py()
                held += batch.column(1)[k].as_buffer()
                while len(held) >= size:
                    yield row(bytes(held[:size]))
                    del held[:size]
        if held:
            yield row(bytes(held))

    return scan.kept(dealt.select(F.spark_partition_id().cast("bigint").alias("part"), "_line").mapInArrow(cut, "block bigint, ids binary"))


#: What a block does with a batch at its ends: its first token goes to the block before; its last one becomes this token (0: stays); tokens of
#: a run that the blocks before it hold.
Ends = dict[int, tuple[bool, int, int]]
Round = tuple[list[tuple[Pair, int]], Ends]


def applied(ids: np.ndarray, block: int, rounds: list[Round]) -> np.ndarray:
    """A block's tokens after some rounds."""
    for merges, ends in rounds:
        first, last, before = ends.get(block, (False, 0, 0))
        if merges[0][0][0] == merges[0][0][1]:
            (token, _), new = merges[0]
            ids = merge_pair(ids[1:] if before % 2 and len(ids) and ids[0] == token else ids, token, token, new)
            if last:
                ids[-1] = last
            continue
        ids = ids[1:] if first else ids
        # pairs of a round don't meet, so that none of their occurrences overlap
        met = np.zeros(max(0, len(ids) - 1), bool)
        for (left, right), _ in merges:
            met |= (ids[:-1] == left) & (ids[1:] == right)
        at, out = np.flatnonzero(met), ids.copy()
        lefts, rights = ids[at], ids[at + 1]
        for (left, right), new in merges:
            out[at[(lefts == left) & (rights == right)]] = new
        ids = np.delete(out, at + 1)
        if last and len(ids):
            ids[-1] = last
    return ids


def _run(ids: np.ndarray) -> int:
    """Length of the run of equal tokens at the start."""
    for part in (ids[:64], ids):
        other = np.flatnonzero(part != ids[0])
        if len(other):
            return int(other[0])
    return len(ids)


LOOK = "block bigint, first int, head bigint, last int, tail bigint, size bigint, left int, right int, n bigint, at bigint"


def _look(rounds: list[Round], kind: str, width: int):  # noqa: ANN202
    """One row for each block, of its ends (n null), and rows for pairs (first null): one a task for each, or one a block where there are too many pairs for a table."""
    dense = width * width <= DENSE

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LOOK.split(", ")]
        kinds = [pa.int32() if "bigint" not in c else pa.int64() for c in LOOK.split(", ")]
        total, place, start = (np.zeros(width * width if dense else 0, np.int64) for _ in range(3))

        def pairs(left: np.ndarray, right: np.ndarray, n: np.ndarray, block: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            m = len(left)
            return pa.RecordBatch.from_arrays([pa.array(block), *[pa.nulls(m, t) for t in kinds[1:6]], pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(at.astype(np.int64))], names)

        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column(0)[k].as_py()
                ids = applied(np.frombuffer(batch.column(1)[k].as_buffer(), kind), block, rounds)
                if not len(ids):
                    continue
                ends = [block, int(ids[0]), _run(ids), int(ids[-1]), _run(ids[::-1]), len(ids), None, None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(ends, kinds, strict=True)], names)
                if not dense:
                    keys, first, n = pairs_of(ids)
                    yield pairs(keys >> 32, keys & 0xFFFFFFFF, n, np.full(len(keys), block), first)
                    continue
                n, first = table_of(ids, width)
                sooner = np.flatnonzero((n > 0) & ((total == 0) | (block < place)))
                place[sooner], start[sooner] = block, first[sooner]
                total += n
        some = np.flatnonzero(total)
        if len(some):
            yield pairs(some // width, some % width, total[some], place[some], start[some])

    return look


def _rewritten(state: DataFrame, rounds: list[Round], kind: str) -> DataFrame:
    """The blocks after some rounds, as a new table; empty ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column(0)[k].as_py()
                ids = applied(np.frombuffer(batch.column(1)[k].as_buffer(), kind), block, rounds)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids.tobytes()], pa.binary())], ["block", "ids"])

    return scan.kept(state.mapInArrow(run, "block bigint, ids binary"))


def _ends(edges: DataFrame, merges: list[tuple[Pair, int]]) -> Ends:
    """What blocks do at their ends, from (block, first, head, last, tail, size, next, next_first): only those where a merged pair meets."""
    new = {pair: token for pair, token in merges}
    (left, right), token = merges[0]
    out: Ends = {}
    if left == right:
        # blocks that begin or end in the token, in order: a run goes on while blocks follow each other and consist of it
        rows = edges.where(F.col("first").eqNullSafe(left) | F.col("last").eqNullSafe(left)).orderBy("block").collect()
        before, expected = 0, None
        for r in rows:
            before = before if r["first"] == left and expected == r["block"] else 0
            head = before + (r["head"] if r["first"] == left else 0)
            run = head if r["first"] == left and r["head"] == r["size"] else r["tail"] if r["last"] == left else 0
            open_end = r["last"] == left and r["next_first"] == left and run % 2 == 1  # the last token pairs with the next block's first
            out[r["block"]] = (False, token if open_end else 0, before)
            before, expected = run, r["next"]
        return out
    meet = F.struct(F.col("last").alias("l"), F.col("next_first").alias("r")).isin([F.struct(F.lit(a).cast("int").alias("l"), F.lit(b).cast("int").alias("r")) for a, b in new])
    for r in edges.where(meet).collect():  # no more than one row for each block
        f, _, b = out.get(r["block"], (False, 0, 0))
        out[r["block"]] = (f, new[r["last"], r["next_first"]], b)
        _, la, b = out.get(r["next"], (False, 0, 0))
        out[r["next"]] = (True, la, b)
    return out


def trim() -> None:
    """Return free memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _slices(batches: Iterator[pa.RecordBatch], newline: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of some lines one after another, and where each ends: about STEP bytes, or one longer line."""
    for batch in batches:
        lines, size = [], 0
        for line in batch.column(0):
            piece = line.as_buffer()
            if piece is None:
                continue
            lines.append(piece)
            size += len(piece)
            if size >= STEP:
                yield _joined(lines, newline)
                lines, size = [], 0
        if lines:
            yield _joined(lines, newline)


def _joined(lines: list[pa.Buffer], newline: bool) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) + newline for x in lines], np.int64)
    return np.frombuffer((b"\n" if newline else b"").join([*lines, b""] if newline else lines), np.uint8), np.cumsum(sizes[sizes > 0])


def _held(data: np.ndarray, ends: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Of each two neighbouring bytes of lines, whether they stay together."""
    out = np.zeros(max(0, len(data) - 1), bool)
    for k in range(0, len(out), STEP):
        out[k : k + STEP] = held[data[k : k + STEP + 1][:-1].astype(np.uint16) << 8 | data[k + 1 : k + STEP + 1]]
    out[ends[:-1] - 1] = False
    return out


def seams(lines: DataFrame, newline: bool) -> tuple[np.ndarray, np.ndarray]:
    """How often each pair of bytes (left << 8 | right) occurs in the lines, and how often it may occur between two of them at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << 16) + 512, np.int64)  # pairs, first bytes, last bytes
        for data, ends in _slices(batches, newline):
            if not len(data):
                continue
            for k in range(0, len(data) - 1, STEP):
                n[: 1 << 16] += np.bincount(data[k : k + STEP + 1][:-1].astype(np.uint16) << 8 | data[k + 1 : k + STEP + 1], minlength=1 << 16)
            last, first = data[ends - 1], data[np.append(0, ends[:-1])]
            np.subtract.at(n, last[:-1].astype(np.int64) << 8 | first[1:], 1)
            n[1 << 16 :] += np.concatenate([np.bincount(first, minlength=256), np.bincount(last, minlength=256)])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["code", "n"])

    n = np.zeros((1 << 16) + 512, np.int64)
    for r in lines.mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        n[r["code"]] = r["n"]
    return n[: 1 << 16], np.minimum(n[-256:, None], n[None, 1 << 16 : -256]).ravel()


def dictionary(lines: DataFrame, newline: bool, held: np.ndarray, gap: int, kind: str) -> DataFrame:
    """(ids, n): the different pieces of the lines between bytes that don't stay together, many in a row, with `gap` after each, and how often each occurs.

    Pieces of a single byte have no pair and are left out. One of up to seven bytes is counted as a number, its length on top.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(pieces: list[bytes] | pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(n, pa.int64())], ["piece", "n"])

        def numbered(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), FEW):
                part = keys[k : k + FEW]
                sizes = (part >> np.uint64(56)).astype(np.int64)
                flat = part.view(np.uint8).reshape(-1, 8)[np.arange(8) < sizes[:, None]]
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                yield rows(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]), n[k : k + FEW])

        def added(new: list[np.ndarray], keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            fresh, m = np.unique(np.concatenate(new), return_counts=True)
            every = np.concatenate([keys, fresh])
            order = np.argsort(every, kind="stable")
            every, n = every[order], np.concatenate([n, m])[order]
            starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            return every[starts], np.add.reduceat(n, starts)

        masks = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
        new, fresh, keys, n = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        long, size = Counter(), 0
        for data, ends in _slices(batches, newline):
            edge = np.diff(np.concatenate([[False], _held(data, ends, held), [False]]).view(np.int8))
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            sizes = stops - starts
            short = sizes < 8
            window = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
            new.append(window[starts[short]] & masks[sizes[short]] | sizes[short].astype(np.uint64) << np.uint64(56))
            fresh += len(new[-1])
            if fresh >= HELD:
                keys, n = added(new, keys, n)
                new, fresh = [], 0
                if len(keys) >= HELD:
                    yield from numbered(keys, n)
                    keys, n = keys[:0], n[:0]
            whole, before = data.tobytes(), len(long)
            long.update(whole[a:b] for a, b in zip(starts[~short].tolist(), stops[~short].tolist(), strict=True))
            size += int(sizes[~short].mean() * (len(long) - before)) if len(long) > before else 0
            if size >= 8 * HELD or len(long) >= HELD // 16:
                yield rows(list(long.keys()), np.fromiter(long.values(), np.int64, len(long)))
                long, size = Counter(), 0
        if fresh:
            keys, n = added(new, keys, n)
        yield from numbered(keys, n)
        if long:
            yield rows(list(long.keys()), np.fromiter(long.values(), np.int64, len(long)))
        del new, keys, n, long
        trim()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pieces = batch.column(0).to_pylist()
                stops = np.cumsum([len(x) for x in pieces])
                ids = np.insert(np.frombuffer(b"".join(pieces), np.uint8).astype(kind), stops, gap)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy().astype(np.int64).tobytes()], pa.binary())], ["ids", "n"])

    counted = lines.mapInArrow(count, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return scan.kept(counted.mapInArrow(pack, "ids binary, n binary"))


def weighed(ids: np.ndarray, n: np.ndarray, gap: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (left * width + right) inside pieces with `gap` after each, and how often they occur where a piece occurs `n` times."""
    inside = ids != gap
    owner = np.cumsum(~inside)[:-1]
    at = np.flatnonzero(inside[:-1] & inside[1:])
    codes, times = ids[at].astype(np.int64) * width + ids[at + 1], n[owner[at]]
    if width * width <= DENSE:
        some, where = np.arange(width * width), codes
    else:
        some, where = np.unique(codes, return_inverse=True)
    low, high = (np.bincount(where, part, len(some)).astype(np.int64) for part in (times & 0xFFFFFFFF, times >> 32))  # sums of doubles, exact in parts
    total = low + (high << 32)
    return some[total > 0], total[total > 0]


def _pairs_in(pieces: DataFrame, rounds: list[Round], kind: str, gap: int, width: int) -> DataFrame:
    """(left, right, n) of a dictionary after some rounds, a row for each pair and row of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width if width * width <= DENSE else 0, np.int64)

        def rows(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((codes // width).astype(np.int32)), pa.array((codes % width).astype(np.int32)), pa.array(n)], ["left", "right", "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                ids = applied(np.frombuffer(batch.column(0)[k].as_buffer(), kind), 0, rounds)
                codes, n = weighed(ids, np.frombuffer(batch.column(1)[k].as_buffer(), np.int64), gap, width)
                if len(total):
                    total[codes] += n
                else:
                    yield rows(codes, n)
        some = np.flatnonzero(total)
        if len(some):
            yield rows(some, total[some])

    return pieces.mapInArrow(run, "left int, right int, n bigint")


def _packed_again(pieces: DataFrame, rounds: list[Round], kind: str, gap: int) -> DataFrame:
    """A dictionary after some rounds, as a new table; pieces of a single token go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = applied(np.frombuffer(batch.column(0)[k].as_buffer(), kind), 0, rounds)
                stops = np.flatnonzero(ids == gap)
                stay = np.diff(stops, prepend=-1) > 2
                owner = np.cumsum(ids == gap) - (ids == gap)
                n = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)[stay]
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[stay[owner]].tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["ids", "n"])

    return scan.kept(pieces.mapInArrow(run, "ids binary, n binary"))


def first_of(corpus: DataFrame, order: str, text: str, newline: bool, rounds: list[Round], pairs: list[Pair], kind: str) -> Pair | None:
    """That of some pairs inside lines which stands first after some rounds, if it does so in the first lines."""
    line = F.concat(F.col(text).cast("string"), F.lit("\n" if newline else "")).cast("binary").alias("_line")
    lines = corpus.where(F.col(text).isNotNull()).select(F.col(order).alias("_order"), line)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column(1):
                ids = applied(np.frombuffer(line.as_buffer(), np.uint8).astype(kind), 0, rounds)
                found = [(int(at[0]), *pair) for pair in pairs if len(at := np.flatnonzero((ids[:-1] == pair[0]) & (ids[1:] == pair[1])))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in min(found)[1:]], ["left", "right"])
                    return

    for most in EARLY:
        found = lines.orderBy(F.col("_order").asc_nulls_first(), "_line").limit(most).mapInArrow(find, "left int, right int").first()
        if found:
            return found["left"], found["right"]
    return None


def train(corpus: DataFrame, order: str, text: str, vocab_size: int, first_id: int, newline: bool = True, block: int = BLOCK) -> dict[Pair, int]:
    """Merges of a byte-pair vocabulary in order: the most frequent pair of the whole stream each time, of equal ones that which stands first."""
    merges = train_pieces(corpus, order, text, vocab_size, first_id, newline, block)
    return train_blocks(corpus, order, text, vocab_size, first_id, newline, block) if merges is None else merges


def train_pieces(corpus: DataFrame, order: str, text: str, vocab_size: int, first_id: int, newline: bool, block: int) -> dict[Pair, int] | None:
    """The same from a dictionary of pieces; None for a small corpus and where pieces don't tell."""
    lines = corpus.where(F.col(text).isNotNull()).select(F.col(text).cast("string").cast("binary").alias("_line"))
    inside, between = seams(lines, newline)
    if inside.sum() <= SMALL * block:
        return None
    most, kind, gap = inside + between, "uint16" if max(vocab_size, first_id) < 1 << 16 else "int32", max(vocab_size, first_id)
    ranked, wanted, floor, pieces = np.sort(most)[::-1], 2 * (vocab_size - first_id), None, None
    merges: dict[Pair, int] = {}
    pending: list[Round] = []
    done: list[Round] = []
    while first_id + len(merges) < vocab_size:
        if pieces is None:
            lower = max(int(ranked[min(wanted, len(ranked) - 1)]), int(most[between > 0].max(initial=0)))
            if lower == floor:
                return None
            floor, pending, wanted = lower, list(done), 4 * wanted
            pieces = dictionary(lines, newline, most > floor, gap, kind)
        top = _pairs_in(pieces, pending, kind, gap, gap + 1).groupBy("left", "right").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "left", "right").limit(SEEN + 1).collect()
        counts = [(r["left"], r["right"], r["n"]) for r in top if r["n"] > floor]
        if not counts:
            if floor == 0:
                break
            pieces = None
            continue
        alike = next((k for k in range(1, len(counts)) if counts[k][2] == counts[k - 1][2]), None)
        if alike == 1:
            tied = [(left, right) for left, right, n in counts if n == counts[0][2]]
            first = first_of(corpus, order, text, newline, done, tied, kind) if len(tied) <= SEEN else None
            if first is None:
                return None
            chosen = [first]
        else:  # down to the first two of one count
            chosen = batch_of(counts[:SEEN] if alike is None else counts[: min(alike + 1, SEEN)], alike is None and len(counts) <= SEEN)
        chosen = chosen[: vocab_size - first_id - len(merges)]
        numbered = [(pair, first_id + len(merges) + k) for k, pair in enumerate(chosen)]
        merges |= dict(numbered)
        pending, done = [*pending, (numbered, {})], [*done, (numbered, {})]
        if len(pending) >= KEPT and first_id + len(merges) < vocab_size:
            pieces, pending = _packed_again(pieces, pending, kind, gap), []
    return merges


def train_blocks(corpus: DataFrame, order: str, text: str, vocab_size: int, first_id: int, newline: bool = True, block: int = BLOCK) -> dict[Pair, int]:
    """The same from the stream in blocks, whatever the text."""
    kind = "uint16" if max(vocab_size, first_id) <= 1 << 16 else "int32"
    state = stream_blocks(corpus, order, text, newline, block, kind)
    long = scan.long_groups(state, [])
    merges: dict[Pair, int] = {}
    pending: list[Round] = []
    while first_id + len(merges) < vocab_size:
        looked = scan.kept(state.mapInArrow(_look(pending, kind, max(256, first_id + len(merges))), LOOK))
        edges = scan.shifted(looked.where("n is null").select("block", "first", "head", "last", "tail", "size"), [], ["block"], {"next": ("block", 1, None), "next_first": ("first", 1, None)}, long=long)
        between = edges.where("next is not null").select(F.col("last").alias("left"), F.col("next_first").alias("right"), F.lit(1).cast("bigint").alias("n"), "block", (F.col("size") - 1).alias("at"))
        counted = looked.where("n is not null").select("left", "right", "n", "block", "at").unionByName(between)
        counted = counted.groupBy("left", "right").agg(F.sum("n").alias("n"), F.min(F.struct("block", "at")).alias("place"))
        top = counted.orderBy(F.desc("n"), "place").limit(SEEN + 1).collect()
        chosen = batch_of([(r["left"], r["right"], r["n"]) for r in top[:SEEN]], len(top) <= SEEN)[: vocab_size - first_id - len(merges)]
        if not chosen:
            break
        numbered = [(pair, first_id + len(merges) + k) for k, pair in enumerate(chosen)]
        merges |= dict(numbered)
        pending = [*pending, (numbered, _ends(edges, numbered))]
        if len(pending) >= KEPT and first_id + len(merges) < vocab_size:
            state, pending = _rewritten(state, pending, kind), []
    return merges
