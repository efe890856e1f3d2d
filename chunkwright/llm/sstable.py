"""Operator 5, token-id output: sorted-string-table shards of token ids keyed by document identifier.

File format (all integers little-endian unless said otherwise)
  data blocks   zstd frames; inside, entries in key order, each: u8 bytes shared with the key before,
                u8 further key bytes, u32 value bytes, the key's further bytes, the value.
                A block's first entry shares nothing.
  index block   zstd frame; per data block: its first key (12 bytes), u64 place, u32 length, u32 entries.
  Bloom filter  bit array over document identifiers; `BLOOM_HASHES` probes by double hashing.
  footer        u64 place and u32 length of the index, u64 place and u32 length of the filter, u64 documents,
                u64 ids, u8 bytes of an id (2 or 4), 7 bytes magic.
A key is 12 bytes, big-endian, so that byte order is document order: identifier with the sign bit flipped
(8 bytes), then a running number for rows that share an identifier (4 bytes). A value is the row's ids.

Rows: a null text has only the end id; a long one is one entry, and its block is as long as it. An empty table gives no
shards and no rows. Only doc_id and text are read, whatever other columns are called. Rows with a null identifier come first, under the lowest key with flag 0
in the running number's top bit. Repeated identifiers keep all their rows,
ordered by a hash of the text, then the text; many rows of one identifier may fill several shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import filesystem, slices, work_dir
from chunkwright.llm.tokens import word_encoder

MAGIC = b"CWSST01"
FOOTER = struct.Struct("<QIQIQQB7s")
ENTRY = struct.Struct("<12sQII")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None, turn: int) -> bytes:
    """Byte-ordered key; null sorts before every identifier."""
    return struct.pack(">QI", 0 if doc_id is None else (doc_id + (1 << 63)), turn | (0 if doc_id is None else 1 << 31))


def id_of(key: bytes) -> int | None:
    head, turn = struct.unpack(">QI", key)
    return head - (1 << 63) if turn >> 31 else None


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    from chunkwright.llm.common import mix

    with np.errstate(over="ignore"):
        a = mix(keys.astype(np.uint64) + np.uint64(0x51ED27))
        b = mix(a) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class TableWriter:
    """Writes one shard; rows must come in key order."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.place = 0
        self.index = bytearray()
        self.keys: list[int] = []
        self.docs = self.ids = 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self._open()

    def _open(self) -> None:
        self.block, self.entries, self.first, self.last = bytearray(), 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries:
            while shared < 12 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += struct.pack("<BBI", shared, 12 - shared, len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.docs += 1
        self.ids += len(value) // self.width
        self.keys.append(struct.unpack(">Q", key[:8])[0])
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        at = self.place
        self.sink.write(data)
        self.place += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.entries:
            at, size = self._write(self.pack(bytes(self.block)))
            self.index += ENTRY.pack(self.first, at, size, self.entries)
        self._open()

    def close(self) -> None:
        self._flush()
        index = self._write(self.pack(bytes(self.index)))
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        marks = np.zeros(bits, np.uint8)
        if self.keys:
            marks[_probes(np.array(self.keys, np.uint64), bits).ravel()] = 1
        bloom = self._write(np.packbits(marks, bitorder="little").tobytes())
        self._write(FOOTER.pack(*index, *bloom, self.docs, self.ids, self.width, MAGIC))


class TableReader:
    """Opens a shard: full scans in key order, and lookups by Bloom filter, binary search and one block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        at, length, bloom_at, bloom_length, self.docs, self.ids, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        self.unpack = zstandard.ZstdDecompressor().decompress
        raw = self.unpack(self._read(at, length)) if self.docs else b""
        self.index = list(ENTRY.iter_unpack(raw))
        self.bloom_place = bloom_at, bloom_length
        self.bloom: np.ndarray | None = None
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, length, entries = self.index[k]
        data, place, key = self.unpack(self._read(at, length)), 0, b""
        for _ in range(entries):
            shared, more, size = struct.unpack_from("<BBI", data, place)
            place += 6
            key = key[:shared] + data[place : place + more]
            place += more
            yield key, data[place : place + size]
            place += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self.block(k):
                yield id_of(key), np.frombuffer(value, self.kind)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every row under an identifier; [] if there is none."""
        if self.bloom is None:
            self.bloom = np.unpackbits(np.frombuffer(self._read(*self.bloom_place), np.uint8), bitorder="little")
        head = np.array([doc_id + (1 << 63)], np.uint64)
        if not self.bloom[_probes(head, len(self.bloom))].all():
            return []
        low, high = key_of(doc_id, 0), key_of(doc_id, (1 << 31) - 1)
        begin, end = 0, len(self.index)
        while begin < end:  # the last block whose first key is not above the lowest key sought
            mid = (begin + end) // 2
            begin, end = (mid + 1, end) if self.index[mid][0] <= low else (begin, mid)
        found = []
        for k in range(max(0, begin - 1), len(self.index)):
            if self.index[k][0] > high:
                break
            found += [np.frombuffer(v, self.kind) for key, v in self.block(k) if low <= key <= high]
        return found


def write_tables(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1) -> list[tuple[str, int, int]]:
    """Write (doc_id, text) rows as shards in ascending identifier order; returns (file, documents, ids) in that order.

    One shuffle by identifier range deals the rows out; each task sorts its range (spilling if need be), encodes
    and writes one file. A task that is run again writes another file, and only the file named in the
    surviving attempt's row is used. The list holds one entry per shard, whatever the number of documents.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, table, sink = None, None, None
        name, last, turn = "", None, -1
        for part in slices(batches, "text", 8 << 20):
            if table is None:
                coder = word_encoder(tokenizer)
                store, path = filesystem(folder)
                store.create_dir(path, recursive=True)
                name = f"shard-{uuid.uuid4().hex}.sst"
                sink = store.open_output_stream(f"{path}/{name}")
                table = TableWriter(sink, 2 if max(coder.whole.get_vocab_size(True), end_id) <= 1 << 16 else 4)
            ids, offsets = coder.encode(part.column(1))
            ids = ids.astype("<u2" if table.width == 2 else "<u4")
            end = np.array([end_id], ids.dtype).tobytes()
            for doc_id, a, b in zip(part.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                turn = turn + 1 if doc_id == last else 0
                last = doc_id
                table.add(key_of(doc_id, turn), ids[a:b].tobytes() + end)
        if table is not None:
            table.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "place": [TaskContext.get().partitionId()], "docs": [table.docs], "ids": [table.ids]})

    # Ranges of (identifier, hash): partitions are in key order, and one identifier's rows may spread over several.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    dealt = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    shards = dealt.mapInArrow(write, "file string, place bigint, docs bigint, ids bigint").collect()
    shards.sort(key=lambda s: s["place"])
    return [(s["file"], s["docs"], s["ids"]) for s in shards]


def read_tables(spark, folder: str, shards: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """Read shards back: doc_id, start (ids of all rows before), n_tokens, ids_crc32, and the ids as bytes if asked."""
    rows, start = [], 0
    for name, _, ids in shards:
        rows.append((name, start))
        start += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{path}/{name}") as source:
                    out: list[list] = [[], [], [], [], []]

                    def full(out=out) -> pa.RecordBatch:
                        kinds = [pa.int64()] * 4 + [pa.binary()]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]
                        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: len(names)], names)

                    for doc_id, ids in TableReader(source):
                        wide = ids.astype("<u4").tobytes()
                        for c, v in zip(out, (doc_id, at, len(ids), zlib.crc32(wide), wide if with_ids else None), strict=True):
                            c.append(v)
                        at += len(ids)
                        if len(out[0]) >= 2000:
                            yield full()
                            out = [[], [], [], [], []]
                            full.__defaults__ = (out,)
                    if out[0]:
                        yield full()

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    if not rows:
        return spark.createDataFrame([], schema)
    # One task a shard: reading and checking a shard is a unit that may be run again anywhere.
    frame = spark.createDataFrame(rows, "file string, at bigint")
    return frame.repartition(len(rows)).mapInArrow(read, schema)


def token_tables(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Write all documents as token tables in the shared folder and read them back (see `read_tables`)."""
    spark = docs.sparkSession
    folder = f"{work_dir(spark)}/token-tables"
    shards = write_tables(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), folder, tokenizer, end_id)
    return read_tables(spark, folder, shards, with_ids)
