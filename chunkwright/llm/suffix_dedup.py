"""Operator 7, suffix-array dedup: longest-previous-factor arrays over blocks that hold all of a string's occurrences.

Two equal strings of `length` bytes have the same least-hash k-gram (minimiser) at the same place in them. So
every window of `length` bytes is dealt to the group of its minimiser, and consecutive windows with one minimiser
travel as one region. Groups with one region need nothing more. Of the others each different content comes to a
block once, with the number of its copies; hashes deal, and in the block bytes decide. A block's suffix array
(prefix doubling up to `length`; suffixes that are unique at some depth leave) puts equal windows side by side;
previous and next smaller positions in suffix order give each window's longest previous factor, up to `length`, and
on mirrored positions its longest next factor: whether an equal window starts earlier, and whether one starts
later. Of a content with copies the first and the last one come to the block, where their bytes are compared: then
the first has a next factor and the last a previous one over the whole region, and so have the copies between them,
which a 128-bit BLAKE2 digest of their bytes ties to the two. A group with more than `MOST` regions is split before:
its contents with copies are compared by themselves, and its windows are dealt again by narrower ranges of the
minimiser's place together with the bytes that all windows of the range share, down to single windows, so that no
block grows with the input (it holds at most `MOST` regions of a few hundred bytes, besides groups that are smaller)
and no pair of regions is ever made.

keep="first" removes a window if an equal one starts earlier (documents in order of doc_id, then of text hash);
keep="none" removes every window that also starts anywhere else. Overlaps and the same document count.

Rows: a null text is empty; texts shorter than `length` lose nothing; long texts are read whole. Rows may repeat (a
repeated row is another copy for keep="none"; for keep="first" equal rows share their fate, as nothing tells them
apart). A null doc_id sorts first. An empty table gives no rows. `removals` reads doc_id and text alone, whatever
other columns are called; `without_repeats` carries them all.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import buffer, materialise, mix, ranges, slices

LENGTH = 400
#: Different regions of a group that one block takes; bytes of a block.
MOST, BLOCK_BYTES = 3000, 512 << 10
#: Bytes of regions that a task hands on at once.
OUT_BYTES = 4 << 20
#: How many places of the minimiser a region spans after each split of a large group.
WIDTHS = (48, 7, 1)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_C = np.uint64(0x9E3779B97F4A7C15)

#: A region: its document, place of the minimiser, first and last window, group, and digest of its bytes.
OCC = "did bigint, key bigint, place int, lo int, hi int, gid bigint, reg binary"
#: A region in block `blk`: a content's first copy (last = 0; -1 if it is there for the last one alone) or last one (1), the number m of its copies, and its bytes.
CTX = "blk bigint, " + OCC + ", last int, m bigint, body binary"
REGION = ("did", "key", "place", "lo", "hi", "gid", "reg")
_ARROW = {"blk": pa.int64(), "did": pa.int64(), "key": pa.int64(), "place": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "gid": pa.int64(), "reg": pa.binary(), "last": pa.int32(), "m": pa.int64(), "body": pa.binary()}
#: Byte ranges that a block removes: from one document, or (copies) from all copies of a content, as counted from their begin.
FOUND = "gid bigint, reg binary, copies boolean, did bigint, key bigint, lo int, begin int, end int"


def _double(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of 2m bytes from hashes of m bytes."""
    with np.errstate(over="ignore"):
        t = h[: len(h) - m] * _C
        t += h[m:]
        t ^= t >> np.uint64(29)
    return t


def _hashes(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Rolling hashes of power-of-two sizes."""
    h, m, out = _TABLE[data], 1, {}
    while True:
        if m in sizes:
            out[m] = h
        if m >= max(sizes) or len(h) <= m:
            break
        h = _double(h, m)
        m *= 2
    return {s: out.get(s, np.zeros(0, np.uint64)) for s in sizes}


def _digest(body: bytes | memoryview) -> bytes:
    """128 bits that stand for the bytes of a region."""
    return hashlib.blake2b(body, digest_size=16).digest()


def _sizes(length: int) -> tuple[int, int]:
    """k of the minimisers, and the size of the hashes that cover windows: powers of two."""
    k = 1 << max(2, (length // 6).bit_length() - 1)
    return k, 1 << (length.bit_length() - 1)


def occurrences(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, minimiser, first window, last window, group) of each region; places are in the buffer."""
    k = _sizes(length)[0]
    w = length - k + 1
    v = mix(_hashes(data, (k,))[k])
    packed = (v & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(v), dtype=np.uint64)
    m = 1
    while 2 * m <= w and len(packed) > m:
        packed = np.minimum(packed[: len(packed) - m], packed[m:])
        m *= 2
    if w > m:
        packed = np.minimum(packed[: len(packed) - (w - m)], packed[w - m :]) if len(packed) > w - m else packed[:0]
    least = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= length)
    counts = size[rows] - length + 1
    starts = ranges(offsets[rows], counts)
    row = np.repeat(rows, counts)
    at = least[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi, place, row = starts[first], starts[last] if len(first) else first, at[first], row[first]
    return row, place, lo, hi, v[place]


def _met(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Places in `starts` of windows whose 64-bit hash another one has: all that have an equal one, and hardly any other."""
    q = _sizes(length)[1]
    h = _hashes(text, (q,))[q]
    with np.errstate(over="ignore"):
        own = mix(h[starts] * _C + h[starts + (length - q)])
    bits = min(22, len(starts).bit_length() + 2)
    slot = (own >> np.uint64(64 - bits)).astype(np.int64)
    some = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)  # spares the others the sort
    order = some[np.argsort(own[some])]
    same = own[order][1:] == own[order][:-1]
    return np.sort(order[np.append(same, False)[: len(order)] | np.append(False, same)[: len(order)]])


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of windows that have an equal one: (places in `starts`, rank of each), sorted by rank then place.

    Prefix doubling from eight-byte words over the windows that share a hash; a window leaves as soon as its prefix is unique.
    """
    met = _met(text, starts, length)
    if not len(met):
        return met, met
    starts = starts[met]
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for j in range(min(8, length)):
        word |= padded[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
    depth = min(8, length)
    # positions that some window covers at its current depth
    marks = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length - depth + 1, n), minlength=n + 1)
    alive = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    rank = np.full(n, -1, np.int64)
    keys = word[alive]
    while True:
        order = np.argsort(keys)  # equal keys get one rank, whatever their order
        ordered = keys[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        ranks = np.cumsum(new) - 1
        alone = new & np.append(new[1:], True)
        rank[:] = -1
        at = alive[order[~alone]]
        rank[at] = ranks[~alone]
        if depth == length:
            break
        step = min(depth, length - depth)
        at = np.sort(at)
        ahead = at + step
        ok = ahead < n
        at, ahead = at[ok], ahead[ok]
        ok = rank[ahead] >= 0
        alive, ahead = at[ok], ahead[ok]
        keys = rank[alive] * np.int64(n + 1) + rank[ahead]
        depth += step
    found = rank[starts]
    own = np.flatnonzero(found >= 0)
    order = own[np.argsort(found[own], kind="stable")]
    ranks = found[order]
    same = np.zeros(len(order), bool)
    same[1:] = ranks[1:] == ranks[:-1]
    keep = same | np.append(same[1:], False)[: len(same)]
    return met[order[keep]], ranks[keep]


def previous_factors(order: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
    """Longest-previous-factor lengths, up to `length`, of windows in suffix order; `order` holds their positions.

    Of all earlier positions the two that share most with a window are those at the previous and at the next
    smaller position in suffix order. Neighbours in that order share a whole window exactly where their ranks agree,
    so such a position counts if it lies in the same run.
    """
    if not len(order):
        return np.zeros(0, np.int64)
    new = np.ones(len(ranks), bool)
    new[1:] = ranks[1:] != ranks[:-1]
    run = np.cumsum(new) - 1
    wide = int(order.max()) + 1
    # a running minimum over each run: later runs get lower offsets so that it restarts
    before = np.minimum.accumulate(order - run * wide) + run * wide
    smaller_before = np.zeros(len(order), bool)
    smaller_before[1:] = (before[:-1] < order[1:]) & ~new[1:]
    back = np.minimum.accumulate((order + run * wide)[::-1])[::-1] - run * wide
    smaller_after = np.zeros(len(order), bool)
    smaller_after[:-1] = (back[1:] < order[:-1]) & ~new[1:]
    return np.where(smaller_before | smaller_after, length, 0)


def next_factors(order: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
    """The same for later positions: previous factors with the positions mirrored."""
    return previous_factors(order.max() - order if len(order) else order, ranks, length)


def _solve(block: list[dict], length: int, first: bool) -> Iterator[tuple]:
    """Byte ranges (FOUND) to remove by the regions (CTX) of a block."""
    heads, tails = {}, {}
    for r in block:  # a repeated row's regions stand here once: as copies they are counted in m
        if r["last"] > 0:
            tails[r["gid"], r["reg"]] = r
        else:
            heads[r["gid"], r["reg"]] = r
    for name, r in tails.items():
        head = heads[name]
        if head["body"] != r["body"]:
            raise RuntimeError(f"regions of documents {head['did']} and {r['did']} differ and have one digest")
        # with equal bytes at both ends every window of the copies has a factor of `length` at one of them
        yield *name, True, head["did"], head["key"], head["lo"], 0, len(r["body"])
    block = sorted((r for r in heads.values() if not r["last"]), key=lambda r: (r["did"], r["key"], r["lo"], r["hi"]))
    if not block:
        return
    text = np.frombuffer(b"".join(r["body"] for r in block), np.uint8)
    size = np.array([len(r["body"]) for r in block])
    base = np.cumsum(size) - size
    count = size - length + 1
    starts = ranges(base, count)
    owner = np.repeat(np.arange(len(block)), count)
    order, ranks = equal_windows(text, starts, length)
    factors = previous_factors(order, ranks, length)
    if not first:
        factors = np.maximum(factors, next_factors(order, ranks, length))
    dead = np.zeros(len(starts), bool)
    dead[order[factors >= length]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], dead, [False]]).astype(np.int8)) != 0)
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        while a < b:  # a run of windows may go on into the next region
            i = int(owner[a])
            stop = min(b, int(np.searchsorted(owner, i, side="right")))
            r = block[i]
            if first or r["m"] == 1:
                begin = r["lo"] + int(starts[a] - base[i])
                yield r["gid"], r["reg"], False, r["did"], r["key"], r["lo"], begin, begin + (stop - a) + length - 1
            a = stop


def _several(occ: DataFrame) -> DataFrame:
    """Regions of groups with several regions."""
    groups = occ.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # The groups stand in a table, so that both sides of the join are plain exchanges, which Spark splits where a group is large.
    return occ.join(materialise(groups.select("gid"), "groups"), "gid").select(*occ.columns)


def _contents(regions: DataFrame, first: bool) -> DataFrame:
    """Of each content its first copy, and its last one where it has copies, with their number m.

    Counts come from a pre-aggregated table; copies are in order of document and place. With keep="first" regions of
    repeated rows are one copy.
    """
    me = F.struct("did", "key", "lo", "hi", "place")
    ends = regions.groupBy("gid", "reg").agg(F.count(F.lit(1)).alias("m"), F.min(me).alias("head"), F.max(me).alias("tail"))
    more = F.col("head") != F.col("tail") if first else F.col("m") > 1
    both = F.array(F.struct(F.lit(0).alias("last"), "head.*"), F.struct(F.lit(1).alias("last"), "tail.*"))
    ends = ends.select("gid", "reg", "m", F.explode(F.when(more, both).otherwise(F.slice(both, 1, 1))).alias("e"))
    return ends.select("gid", "reg", "m", "e.*")


def _release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of steps whose results are in tables.

    Spark drops them once nothing in the driver refers to them, which it learns from a collection; by itself that
    comes every half hour, and until then each step's files lie on the executors' disks besides the next one's.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def spans(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """(did, key, spans): byte ranges to remove, as they were found; docs has did, key and text."""
    first = keep == "first"
    spark = docs.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 512 << 10):
            data, offsets = buffer(part.column(2))
            if len(data) < length:
                continue
            row, place, lo, hi, gid = occurrences(data, offsets, length)
            at = pa.array(row)
            begin = offsets[row]
            raw = memoryview(data)
            reg = [_digest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
            cols = [part.column(0).take(at), part.column(1).take(at), *(pa.array((c - begin).astype(np.int32)) for c in (place, lo, hi)), pa.array(gid.view(np.int64)), pa.array(reg, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, list(REGION))

    occ = materialise(docs.select("did", "key", "text").where(F.octet_length("text") >= length).mapInArrow(scan, OCC), "regions")
    copies = materialise(_several(occ), "met")
    ends = materialise(_contents(copies, first), "ends")
    _release(docs)
    wanted = ends.groupBy("did", "key").agg(F.collect_list(F.struct("gid", "reg", "m", "last", "lo", "hi", "place")).alias("regions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows, size = [], 0
            for did, key, text, regions in zip(*(c.to_pylist() for c in part.columns), strict=True):
                body = text.encode()
                for r in regions:
                    rows.append({**r, "blk": r["gid"], "did": did, "key": key, "body": body[r["lo"] : r["hi"] + length]})
                    size += len(rows[-1]["body"]) + 200
                    if size >= OUT_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    contexts = docs.join(wanted, ["did", "key"]).select("did", "key", "text", "regions").mapInArrow(cut, CTX)
    contexts = materialise(contexts, "contexts")
    _release(docs)
    for width in WIDTHS:
        large = contexts.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select("blk")
        large = materialise(large, "large")
        if large.isEmpty():
            break
        inside = contexts.join(large, "blk", "left_semi").select(*contexts.columns)
        # both ends of a content with copies meet by themselves, all contents by narrower ranges
        pairs = inside.join(inside.where("last = 1").select("gid", "reg").distinct(), ["gid", "reg"], "left_semi")
        pairs = pairs.withColumn("blk", F.xxhash64("gid", "reg")).withColumn("last", F.when(F.col("last") > 0, 1).otherwise(-1)).select(*contexts.columns)
        finer = inside.where("last = 0").mapInArrow(_narrow(length, width), f"{OCC}, body binary")
        finer = materialise(_several(finer), f"width-{width}")
        chosen = _contents(finer.drop("body"), first).join(finer.select("gid", "reg", "did", "key", "lo", "body"), ["gid", "reg", "did", "key", "lo"])
        rest = contexts.join(large, "blk", "left_anti").unionByName(pairs).unionByName(chosen.withColumn("blk", F.col("gid")))
        contexts, copies = materialise(rest.select(*contexts.columns), "contexts"), copies.unionByName(finer.drop("body"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        kinds = {"gid": pa.int64(), "reg": pa.binary(), "copies": pa.bool_(), "did": pa.int64(), "key": pa.int64(), "lo": pa.int32(), "begin": pa.int32(), "end": pa.int32()}

        def done() -> pa.RecordBatch:
            got = list(_solve(held, length, first))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True) if got else [[]] * len(kinds), kinds.values(), strict=True)], list(kinds))

        for part in slices(batches, "body"):
            for r in part.to_pylist():
                if r["blk"] != last and size >= BLOCK_BYTES:
                    yield done()
                    held, size = [], 0
                last = r["blk"]
                held.append(r)
                size += len(r["body"])
        if held:
            yield done()

    found = contexts.repartition("blk").sortWithinPartitions("blk").mapInArrow(solve, FOUND)
    found = materialise(found, "found")
    _release(docs)
    whole = found.where("copies").select("gid", "reg", F.struct("did", "key", "lo").alias("head"), "begin", "end")
    every = copies.join(whole, ["gid", "reg"])
    if first:
        every = every.where(F.struct("did", "key", "lo") != F.col("head"))
    every = every.select("did", "key", (F.col("lo") + F.col("begin")).alias("begin"), (F.col("lo") + F.col("end")).alias("end"))
    every = materialise(every.unionByName(found.where("not copies").select("did", "key", "begin", "end")), "spans")
    _release(docs)
    return every.groupBy("did", "key").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))


def _batch(rows: list[dict], names: tuple[str, ...] = tuple(_ARROW)) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _ARROW[c]) for c in names], list(names))


def _narrow(length: int, width: int):
    """Split regions by ranges of `width` places of the minimiser in the window; the group is then what all those windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(data: bytes, salt: int) -> int:
            return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=salt.to_bytes(16, "little", signed=True)).digest(), "little", signed=True)

        names = ("did", "key", "place", "lo", "hi", "gid", "body")
        out = (*REGION, "body")
        rows, size = [], 0
        for part in slices(batches, "body", 1 << 20):
            for did, key, place, lo, hi, gid, body in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                for band in range((place - hi) // width, (place - lo) // width + 1):
                    a1, a2 = band * width, band * width + width - 1
                    begin, end = max(lo, place - a2), min(hi, place - a1)
                    core = body[place - a1 - lo : place - a2 + length - lo]
                    own = body[begin - lo : end + length - lo]
                    rows.append({"did": did, "key": key, "place": place, "lo": begin, "hi": end, "gid": hashed(core, gid ^ (band << 70)), "reg": _digest(own), "body": own})
                    size += len(own) + 200
                if size >= OUT_BYTES:  # a region may become hundreds
                    yield _batch(rows, out)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, out)

    return run


def identified(docs: DataFrame) -> DataFrame:
    """(row, did, key, text): whole rows with did (doc_id, null lowest) and key (64 bits by way of the text's SHA-256), which join spans to them."""
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    return rows.select("row", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("did"), F.xxhash64(F.sha2(text, 256)).alias("key"), text.alias("text"))


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs from sorted, overlapping or touching ranges."""
    out: list[list[int]] = []
    for s in found or ():
        if out and s["begin"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["begin"], s["end"]])
    return [(a, b) for a, b in out]


def removals(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed byte ranges, and the text that is left.

    The hash is that of all bytes left; in `text` the halves of characters that a range cuts are left out.
    """
    rows = identified(docs.select("doc_id", "text"))
    found = spans(rows.select("did", "key", "text"), length, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for part in slices(batches, "text"):
            out = []
            for doc_id, text, got in zip(*(c.to_pylist() for c in part.columns), strict=True):
                body, runs = text.encode(), merged(got)
                if runs:
                    left = b"".join(body[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(body)], strict=True))
                    digest, text = hashlib.sha256(left).hexdigest(), without(body, runs)
                else:
                    digest = hashlib.sha256(body).hexdigest()
                out.append((doc_id, len(body), sum(b - a for a, b in runs), len(runs), digest, [{"begin": a, "end": b} for a, b in runs], text))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind, pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "text"])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<begin:int,end:int>>, text string"
    joined = rows.join(found, ["did", "key"], "left")
    return joined.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "text", "spans").mapInArrow(run, schema)


def without(body: bytes, runs: list[tuple[int, int]], whole: bool = False) -> str:
    """A text without byte ranges; the halves of characters that a range cuts go with it, or stay whole."""
    kept, at = [], 0
    for a, b in runs:
        while whole and a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while whole and a < b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(body[at:a])
        at = b
    return b"".join([p.decode(errors="ignore").encode() for p in (*kept, body[at:])]).decode()


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", emptied: bool = True) -> DataFrame:
    """The documents with repeated passages cut out of their texts (whole characters only); all columns stay.

    Documents of which nothing is left stay with an empty text, or go where `emptied` is false; null texts and those that
    were empty before stay in either case.
    """
    rows = identified(docs)
    found = spans(rows.select("did", "key", "text"), length, keep)

    # columns travel under numbers, so that none of them can be called like the spans
    names, at = docs.columns, docs.columns.index("text")
    numbered = [F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            *cols, got = part.columns
            got = got.to_pylist()
            # a row without spans keeps its very text (null too)
            texts = [t if g is None else without(t.encode(), merged(g), whole=True) for t, g in zip(cols[at].to_pylist(), got, strict=True)]
            cols[at] = pa.array(texts, cols[at].type)
            rest = pa.RecordBatch.from_arrays(cols, names)
            yield rest if emptied else rest.filter(pa.array([g is None or t != "" for t, g in zip(texts, got, strict=True)]))

    return rows.join(found, ["did", "key"], "left").select(*numbered, "spans").mapInArrow(cut, docs.schema)
