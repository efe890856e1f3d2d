"""Operator 8, MinHash near-duplicates: Order MinHash over five-word shingles, verified by banded alignment.

Equal texts are one class from the start (a 128-bit hash). A sketch takes the `ELL` least shingles, each
labelled with its occurrence number, under its own random order and keeps them in text order; texts whose
sketches are equal share a bucket. Texts of up to `SHORT` shingles, whose sketches depend on their length, also
share one for each shingle that both have among their rarest ones (an exact prefix filter): of those no pair of
similarity `LEAST` is missed, nor is one of a text of up to 0.8 `SHORT` shingles and a longer one. In a bucket all members are compared with one leader, the member that meets
most others over all sketches; members that fail are compared with each other: small remainders in one task. A remainder of
more than `REST` members meets again under another leader; it is done when it is small, or has one class
already, or few members are outside its largest class (those few meet all others). What is left after `LEADERS` rounds is dealt again by the
exact prefix filter, with the shingles' numbers in that remainder, so that what all its members share brings nobody together; and what is left after
as many rounds more is compared block by block. The number of rounds is bounded, and a bucket loses no member to them. 1 - similarity is
a metric, so that a member which fails can only be similar to a passed one if it has `2 * LEAST - 1` with their leader;
such members meet the passed ones of their leader unless both are in one class by then. So no link that would join two classes
of a bucket is missed. Links inside a class may be: those between two texts that passed with one leader, between a passed and a
failed one, and in large remainders, where both were in one class already; `n_verified` counts those that were looked at.
Leaders' members are spread over salts, and texts are compared with a leader one at a time. Texts that share a bucket are turned into shingles
once; what is compared travels as shingles. Where many meet many, an index by shingle counts what a text shares with all others at once, and only
pairs that share enough are aligned.

Verification aligns the labelled shingles of two texts inside a band around the diagonal: with m aligned, the
similarity is m / (n1 + n2 - m), and pairs of `LEAST` or more are links. Classes are the components of links.

Words are runs of other than ASCII white space, in lower case for ASCII and Latin-1 letters. Texts of one to
four words are one shingle. Rows: null is the empty text; empty texts are equal texts, and so are all texts without words
that have the same white space. Long texts are read whole. Rows may repeat: they are copies. An empty table gives no
rows. `near_duplicates` reads doc_id and text alone, whatever other columns are called; `one_of_each` carries them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import SPACES, buffer, lengths, materialise, mix, ranges, slices, span_hashes, words
from chunkwright.llm.components import components

WORDS, LEAST = 5, 0.8
SKETCHES, ELL = 24, 6
#: Members of a leader that one task compares; members that are left in a bucket and then compared in one task.
SALT, REST = 500, 1000
#: Bytes of such members' texts in one task; shingles in one index, and matches that are counted at once.
REST_BYTES, INDEX = 8 << 20, 1 << 20
#: Rounds of leaders in a bucket before what is left is dealt again by its rarest shingles, and then before it is compared block by block.
LEADERS = 4
#: Shingles of a text up to which buckets are exact.
SHORT = 25

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    low = _lower[data]
    low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 0x20
    return low


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, each labelled with its occurrence number in its text, and their row bounds."""
    begin, end, row = words(data, offsets)
    n = len(offsets) - 1
    word = span_hashes(lowered(data), begin, end) if len(begin) else np.zeros(0, np.uint64)
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = ranges(first, made)
    owner = np.repeat(np.arange(n), made)
    hashed = np.zeros(len(at), np.uint64)
    stop = first[owner] + counts[owner]
    with np.errstate(over="ignore"):
        for j in range(k):
            place = at + j
            inside = place < stop
            hashed = mix(hashed + np.where(inside, word[np.minimum(place, max(len(word) - 1, 0))] if len(word) else np.uint64(0), np.uint64(j + 1)))
        # shingles that meet no other one in a slot occur once in their text; the others are sorted
        slot = (mix(hashed + mix(owner.astype(np.uint64))) >> np.uint64(64 - min(22, len(at).bit_length() + 2))).astype(np.int64)
        some = np.flatnonzero(np.bincount(slot)[slot] > 1)
        order = some[np.lexsort((hashed[some], owner[some]))]
        same = (hashed[order][1:] == hashed[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        if same.any():
            run = np.concatenate([[0], np.cumsum(~same)])
            start = np.concatenate([[0], np.flatnonzero(~same) + 1])
            turn = (np.arange(len(order)) - start[run]).astype(np.uint64)
            hashed[order] = np.where(turn > 0, mix(hashed[order] + turn), hashed[order])
    return hashed, bounds


def sketches(col: pa.Array, count: int = SKETCHES, ell: int = ELL) -> list[np.ndarray]:
    """One key per sketch for each text; none for texts without words."""
    hashed, bounds = shingles(*buffer(col))
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
        odd = mix(seeds) | np.uint64(1)
        out = [np.zeros(0, np.int64)] * len(col)
        chosen: dict[int, list[tuple[int, np.ndarray]]] = {}  # by their number: texts, and places of the least shingles of each sketch
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            own = hashed[a:b]
            if not len(own):
                continue
            e = min(ell, len(own))
            ranks = own[None, :] ^ seeds[:, None]
            ranks *= odd[:, None]
            ranks ^= ranks >> np.uint64(32)
            ranks *= np.uint64(0x9E3779B97F4A7C15)
            least = np.argpartition(ranks, e - 1, axis=1)[:, :e] if len(own) > e else np.tile(np.arange(e), (count, 1))
            chosen.setdefault(e, []).append((i, least + a))
        for e, found in chosen.items():
            least = hashed[np.sort(np.stack([at for _, at in found]), axis=2)]
            key = np.tile(seeds, (len(found), 1))
            for j in range(e):
                key = mix(key + least[:, :, j])
            for (i, _), own in zip(found, key.view(np.int64), strict=True):
                out[i] = own
    return out


def brief(col: pa.Array, most: int | None = None) -> list[np.ndarray]:
    """Labelled shingles of each text that has up to `most` (`SHORT`); none for the others."""
    most = SHORT if most is None else most
    data, offsets = buffer(col)
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    counts = np.diff(np.concatenate([[0], np.cumsum(first)])[offsets])
    at = np.flatnonzero((counts > 0) & (counts <= most + WORDS - 1))
    out = [np.zeros(0, np.int64)] * len(col)
    if len(at):
        for i, own in zip(at.tolist(), _shingles_of(col.take(pa.array(at))), strict=True):
            out[i] = own.view(np.int64)
    return out


def _prefixes(rows: DataFrame, least: float, *group: str) -> DataFrame:
    """(*group, cls, met_at): the rarest labelled shingles of texts (*group, cls, own), as many as leave fewer than a similar text must share.

    Those that no other text of the group has are left out. Rarity is that among the texts of the same group. Two texts of a group with similarity `least` have such a shingle in common.
    """
    rows = rows.select(*group, "cls", F.explode("own").alias("shingle"))
    common = rows.groupBy(*group, "shingle").agg(F.count(F.lit(1)).alias("n"))
    ordered = rows.join(common, [*group, "shingle"]).groupBy(*group, "cls").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("own"))
    size = F.size("own")
    kept = F.slice("own", F.lit(1), size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1)
    rarest = ordered.select(*group, "cls", F.explode(kept).alias("x")).where("x.n > 1")
    return rarest.select(*group, "cls", F.xxhash64(F.lit("prefix"), *group, "x.shingle").alias("met_at"))


def _finer(large: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Members (key, cls, met, size) of large remainders in buckets of their rarest shingles instead."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "own"):
            lists = [s.view(np.int64) for s in _listed(part.column(4))]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(lists, pa.list_(pa.int64()))], ["key", "cls", "met", "size", "own"])

    rows = large.join(texts, "cls").select("key", "cls", "met", "size", "own").mapInArrow(own, "key bigint, cls binary, met bigint, size bigint, own array<bigint>")
    rows = materialise(rows, "finer")
    keys = _prefixes(rows.select("key", "cls", "own"), least, "key")
    keys = keys.join(rows.select("key", "cls", "met", "size"), ["key", "cls"]).select(F.col("met_at").alias("key"), "cls", "met", "size")
    return keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key", "left_semi")


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Similarity of two labelled shingle lists by alignment in the band that similarity `least` allows; 0 if surely below."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2 or min(n1, n2) < least * max(n1, n2):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least * (n1 + n2 - len(i)):
        return 0.0
    band = int((1 - least) * (n1 + n2)) + 1  # what lies farther off the diagonal needs more gaps than that
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= band]
    m = len(j)
    if m > 1 and (np.diff(j) < 0).any():  # symbols are unique: the alignment is the longest increasing subsequence
        from bisect import bisect_left

        tails: list[int] = []
        for v in j.tolist():
            k = bisect_left(tails, v)
            tails[k : k + 1] = [v]
        m = len(tails)
    return m / (n1 + n2 - m)


def _shingles_of(texts: pa.Array) -> list[np.ndarray]:
    hashed, bounds = shingles(*buffer(texts))
    return [hashed[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, own) from (cls, text): the labelled shingles of a text in one binary value, see `_listed`."""
    for part in slices(batches, "text"):
        hashed, bounds = shingles(*buffer(part.column(1)))
        own = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds * 8), pa.py_buffer(hashed)])
        yield pa.RecordBatch.from_arrays([part.column(0), own.cast(pa.binary())], ["cls", "own"])


def _listed(col: pa.Array) -> list[np.ndarray]:
    data, offsets = buffer(col)
    return [data[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


class Held:
    """Several shingle lists, in indexes by shingle."""

    def __init__(self, lists: list[np.ndarray]):
        self.lists = lists
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.parts: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # lists from .. to, their shingles in order, whose each is
        ends, first = np.cumsum(self.sizes), 0
        while first < len(lists):
            stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + INDEX, side="right")))
            flat = np.concatenate(lists[first:stop])
            order = np.argsort(flat, kind="stable")
            self.parts.append((first, stop, flat[order], np.repeat(np.arange(stop - first), self.sizes[first:stop])[order]))
            first = stop

    def near(self, own: np.ndarray, least: float) -> list[int]:
        """Which lists share as many shingles with another one as similarity `least` needs, in whatever order."""
        own, common = np.sort(own), np.zeros(len(self.lists), np.int64)
        for first, stop, symbols, owner in self.parts:
            begin = np.searchsorted(symbols, own)
            counts = np.searchsorted(symbols, own, side="right") - begin
            ends, at = np.cumsum(counts), 0
            while at < len(own):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + INDEX, side="right")))
                common[first:stop] += np.bincount(owner[ranges(begin[at:to], counts[at:to])], minlength=stop - first)
                at = to
        return np.flatnonzero((common > 0) & (common >= least * (self.sizes + len(own) - common))).tolist()


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], ["cls", "lead"])


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(cls, lead, sim) for pairs of classes, sim exact from 2 * least - 1 on; texts is (cls, own)."""
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    spread = pairs.join(sizes, "lead")
    members = spread.select("cls", "lead", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = sizes.select(F.col("lead").alias("cls"), "lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    rows = members.unionByName(heads).join(texts, "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, head = None, None
        for part in slices(batches, "own"):
            lists = _listed(part.column(4))
            out: list[tuple] = []
            for cls, own, role, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), lists, strict=True):
                if role == 0:
                    lead, head = own, s.copy()
                elif own == lead:
                    out.append((cls, own, aligned(head, s, max(0.0, 2 * least - 1) - 1e-9)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], ["cls", "lead", "sim"])

    dealt = rows.select("cls", "lead", "salt", "role", "own").repartition("lead", "salt").sortWithinPartitions("lead", "salt", "role")
    return dealt.mapInArrow(compare, "cls binary, lead binary, sim double")


def _finish(groups: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (cls, lead) inside small remainders (key, cls): each task compares a remainder's members at once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, lists, found = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            held = Held(lists)
            for i, own in enumerate(lists):
                found.extend((names[i], names[j]) for j in held.near(own, least) if j < i and names[j] != names[i] and aligned(lists[j], own, least) >= least)
                if len(found) > 20_000:
                    yield _pairs(found)
                    found.clear()

        for part in slices(batches, "own"):
            for k, cls, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _listed(part.column(2)), strict=True):
                if k != key:
                    yield from done()
                    key, names, lists = k, [], []
                names.append(cls)
                lists.append(s.copy())  # not a view of the whole slice
        yield from done()
        if found:
            yield _pairs(found)

    dealt = groups.join(texts, "cls").select("key", "cls", "own").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "cls binary, lead binary")


def _roots(found: DataFrame, name: str, root: str) -> DataFrame:
    return components(found, "cls", "lead").select(F.col("node").alias(name), F.col("root").alias(root))


def _across(groups: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (cls, lead) in groups (grp, cls, root, role, sim) between members of role 1 and role 0 that have different roots.

    Both roles are spread over blocks of `SALT`, each pair of blocks is a task's work; sim, where it isn't null, is
    the similarity with one text of the group, by which pairs that can't be similar are passed over.
    """
    sizes = groups.groupBy("grp").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("role") == r, 1).otherwise(0)) / SALT)).cast("int").alias(f"blocks{r}") for r in (0, 1)))
    spread = groups.join(sizes, "grp")
    own = lambda r: F.array(F.pmod(F.xxhash64("cls"), F.col(f"blocks{r}")).cast("int"))
    all_of = lambda r: F.sequence(F.lit(0), F.col(f"blocks{r}") - 1)
    for r in (0, 1):
        spread = spread.withColumn(f"at{r}", F.explode(F.when(F.col("role") == r, own(r)).otherwise(all_of(r))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, held, index = None, [], None
        for part in slices(batches, "own"):
            found = []
            cols = [c.to_pylist() for c in part.columns[:-1]]
            for grp, at0, at1, role, cls, root, sim, s in zip(*cols, _listed(part.column(7)), strict=True):
                if (grp, at0, at1) != work:
                    work, held, index = (grp, at0, at1), [], None
                if role:
                    held.append((cls, root, sim, s.copy()))
                    continue
                index = index or Held([t for *_, t in held])
                for j in index.near(s, least):
                    other, its, close, t = held[j]
                    if its != root and (sim is None or close is None or abs(sim - close) <= 1 - least + 1e-9) and aligned(t, s, least) >= least:
                        found.append((other, cls))
                if len(found) > 20_000:
                    yield _pairs(found)
                    found = []
            if found:
                yield _pairs(found)

    dealt = spread.join(texts, "cls").select("grp", "at0", "at1", "role", "cls", "root", "sim", "own")
    return dealt.repartition("grp", "at0", "at1").sortWithinPartitions("grp", "at0", "at1", F.desc("role")).mapInArrow(compare, "cls binary, lead binary")


def _remainders(large: DataFrame, found: DataFrame) -> DataFrame:
    """Large remainders (key, cls, met, size) with root, top (the root that most members have) and open (members with other roots)."""
    large = large.join(_roots(found, "cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    parts = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    tops = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    return large.join(tops.select("key", F.col("most.root").alias("top"), (F.col("all") - F.col("most.n")).alias("open")), "key")


def _missed(tried: DataFrame, found: DataFrame, texts: DataFrame, least: float) -> DataFrame | None:
    """Links between those that passed with a leader and those that failed with it, where these are in another class."""
    close = tried.where((F.col("sim") < least) & (F.col("sim") >= 2 * least - 1 - 1e-9)).select("cls", "lead", "sim")
    close = close.join(tried.where(F.col("sim") >= least).select("lead"), "lead", "left_semi")
    if close.isEmpty():
        return None
    roots = materialise(_roots(found, "node", "root"), "roots")
    close = close.join(roots.select(F.col("node").alias("lead"), F.col("root").alias("its")), "lead")
    close = close.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")).where("root <> its")
    close = materialise(close, "close")
    passed = tried.where(F.col("sim") >= least).join(close.select("lead", "its").distinct(), "lead")
    both = close.select("lead", "cls", "root", F.lit(1).alias("role"), "sim").unionByName(passed.select("lead", "cls", F.col("its").alias("root"), F.lit(0).alias("role"), "sim"))
    return _across(both.withColumnRenamed("lead", "grp"), texts, least)


def links(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Verified links (cls, lead) between different texts; docs has cls (hash of the text), doc_id and text."""
    spark = docs.sparkSession

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (sketches(part.column(1)), brief(part.column(1))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths(part.column(1))), *lists], ["cls", "size", "keys", "own"])

    keys = docs.select("cls", "text").mapInArrow(sketch, "cls binary, size bigint, keys array<bigint>, own array<bigint>")
    made = materialise(keys.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("size", "keys", "own"))), "sketches")
    prefixes = materialise(_prefixes(made.where(F.size("own") > 0), least).select("cls", F.col("met_at").alias("key")), "prefixes")
    # Texts that meet by prefixes alone have few shingles: no size.
    keys = made.select("cls", "size", F.explode("keys").alias("key")).unionByName(prefixes, allowMissingColumns=True)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(keys.join(shared, "key"), "members")
    met = members.groupBy("cls").agg(F.sum("n").alias("met"), F.coalesce(F.max("size"), F.lit(0)).alias("size"))
    active = materialise(members.select("key", "cls").join(met, "cls"), "active")
    # The shingles of one text for each class that shares a bucket: written once, read by every round.
    first = docs.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(met, "cls", "left_semi")
    same = (docs["cls"] == first["cls"]) & docs["doc_id"].eqNullSafe(first["doc_id"])
    texts = docs.join(first, same, "left_semi").select("cls", "text")
    texts = materialise(texts.mapInArrow(_packed, "cls binary, own binary"), "texts").dropDuplicates(["cls"])
    found = spark.createDataFrame([], "cls binary, lead binary")
    tried = spark.createDataFrame([], "cls binary, lead binary, sim double")
    for turn in range(2 * LEADERS):
        lead = active.groupBy("key").agg(F.max(F.struct("met", "cls")).getField("cls").alias("lead"))
        led = active.join(lead, "key").where("cls <> lead")
        pairs = led.select("cls", "lead").distinct()
        judged = materialise(_verify(pairs, texts, least), "judged")
        tried = tried.unionByName(judged)
        found = found.unionByName(judged.where(F.col("sim") >= least).select("cls", "lead"))
        failed = judged.where(F.col("sim") < least).select("cls", "lead").distinct()
        rest = materialise(led.join(failed, ["cls", "lead"], "left_semi"), "rest")
        several = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")
        rest = materialise(rest.select("key", "cls", "met", "size").join(several, "key"), "rest")
        fits = (F.col("n") <= REST) & (F.col("bytes") <= REST_BYTES)
        small = rest.where(fits)
        found = materialise(found.unionByName(_finish(small.select("key", "cls"), texts, least)), "found")
        large = rest.where(~fits).drop("n", "bytes")
        if large.isEmpty():
            break
        large = materialise(_remainders(large, found), "large")
        few = large.where((F.col("open") > 0) & (F.col("open") <= REST))
        sides = few.select(F.col("key").alias("grp"), "cls", "root", F.explode(F.when(F.col("root") == F.col("top"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("role"))
        found = materialise(found.unionByName(_across(sides.withColumn("sim", F.lit(None).cast("double")), texts, least)), "found")
        large = large.where(F.col("open") > REST).select("key", "cls", "met", "size")
        active = materialise(_finer(large, texts, least) if turn == LEADERS - 1 else large, "active")
        if active.isEmpty():
            break
    else:
        roots = active.join(_roots(found, "cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        sides = roots.select(F.col("key").alias("grp"), "cls", "root", F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), F.lit(None).cast("double").alias("sim"))
        found = materialise(found.unionByName(_across(sides, texts, least)), "found")
    more = _missed(tried, found, texts, least)
    return found.distinct() if more is None else materialise(found.unionByName(more).distinct(), "found")


def _classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, cls): whole rows with their text's hash; and (cls, least doc_id, n_copies, n_verified, root) of each text."""
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.coalesce("row.text", F.lit("")))).alias("cls"))
    texts = rows.select("doc_id", F.coalesce("row.text", F.lit("")).alias("text"), "cls")
    found = links(texts, least)
    both = found.select(F.col("cls").alias("node"), F.col("lead").alias("other")).unionByName(found.select(F.col("lead").alias("node"), F.col("cls").alias("other"))).distinct()
    degree = both.groupBy(F.col("node").alias("cls")).agg(F.count(F.lit(1)).alias("n_verified"))
    roots = components(found, "cls", "lead").withColumnRenamed("node", "cls")
    copies = texts.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    known = copies.join(roots, "cls", "left").join(degree, "cls", "left")
    known = known.select("cls", "least", "n_copies", F.coalesce("n_verified", F.lit(0)).cast("bigint").alias("n_verified"), F.coalesce("root", "cls").alias("root"))
    return rows, materialise(known, "known")


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Per document: doc_id, class_id (least doc_id of its class), n_verified (links of its text that were verified), n_copies (rows with its very text)."""
    rows, known = _classes(docs.select("doc_id", "text"), least)
    heads = known.groupBy("root").agg(F.min("least").alias("class_id"))
    labelled = known.join(heads, "root").select("cls", "class_id", "n_verified", "n_copies")
    return rows.select("doc_id", "cls").join(labelled, "cls").select("doc_id", "class_id", "n_verified", "n_copies")


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each class: the least by doc_id, then by text hash; of rows that agree in both, one. All columns stay."""
    rows, known = _classes(docs, least)
    heads = known.groupBy("root").agg(F.min(F.struct(F.col("least").isNotNull(), "least", "cls")).alias("head"))
    heads = heads.select(F.coalesce("head.least", F.lit(-(1 << 63))).alias("did"), F.col("head.cls").alias("cls"))
    rows = rows.withColumn("did", F.coalesce("doc_id", F.lit(-(1 << 63))))
    return rows.join(heads, ["did", "cls"]).dropDuplicates(["did", "cls"]).select("row.*")
