"""Quoted CSV read by byte ranges: a large file is many tasks, though fields may span lines.

Spark's text reader deals a file's lines in splits. Whether a split begins inside a quoted field is the parity of all quotes before it, so one pass
takes each split's parity and a running value along a file's splits (one row each) says how each begins. A second pass puts lines together to records
where that needs no other split; what spans splits, at most one record at either end of each, comes as fragments that are joined.

For files as RFC 4180 has them: a field that holds a quote, a separator or a line end is quoted, and a quote in it is doubled. Lines end in \\n or \\r\\n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])
#: What a row of text is: a whole record, or the end, a middle part or the beginning of one that spans splits, in the order that fragments of a split have.
WHOLE, END, MIDDLE, BEGINNING = range(4)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits (file, block, inside, odd, value), in order, as records and fragments."""
    at: tuple[str, int] | None = None
    held: list[str] = []
    open_, head, fresh = False, False, False

    def rows(parts: list[int], firsts: list[bool], texts) -> pa.RecordBatch:  # noqa: ANN001
        n = len(parts)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array(parts, pa.int32()), pa.array(firsts, pa.bool_()), texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())], schema=PIECES)

    def rest() -> Iterator[pa.RecordBatch]:
        if at is not None and held:
            yield rows([MIDDLE if head else BEGINNING], [fresh], ["\n".join(held)])

    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        inside, odd, values = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
        turns = np.flatnonzero(np.r_[True, (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])])
        for begin, stop in zip(turns, [*turns[1:], batch.num_rows], strict=True):
            if at != (files[begin], int(blocks[begin])):
                yield from rest()
                at, held = (files[begin], int(blocks[begin])), []
                open_ = head = bool(inside[begin])
                fresh = at[1] == 0
            state = (int(open_) + np.cumsum(odd[begin:stop])) % 2
            ends = np.flatnonzero(state == 0)
            open_ = bool(state[-1])
            own = values.slice(begin, stop - begin)
            if len(ends) == stop - begin and not held and not head:
                firsts = [False] * len(own)
                firsts[0], fresh = fresh, False
                yield rows([WHOLE] * len(own), firsts, own)
                continue
            lines, last, parts, firsts, texts = own.to_pylist(), 0, [], [], []
            for e in ends.tolist():
                parts.append(END if head else WHOLE)
                firsts.append(fresh)
                texts.append("\n".join([*held, *lines[last : e + 1]]))
                held, head, fresh, last = [], False, False, e + 1
            held += lines[last:]
            if parts:
                yield rows(parts, firsts, texts)
    yield from rest()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, first): the records of quoted CSV files as text, and whether they begin a file. Empty records go."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    odd = ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("int").alias("odd")
    lines = lines.select("file", "block", odd, "value")
    parity = lines.groupBy("file", "block").agg(F.bit_xor("odd").alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = parity.select(F.xxhash64("file", "block").alias("_split"), F.coalesce(F.bit_xor("odd").over(before), F.lit(0)).alias("inside"))
    # one row of two numbers for each split
    met = lines.join(F.broadcast(begins), F.xxhash64("file", "block") == F.col("_split"), "left")
    known = F.coalesce("inside", F.raise_error(F.lit("files were split otherwise in the second pass")).cast("int")).alias("inside")
    pieces = met.select("file", "block", known, "odd", "value").mapInArrow(_assembled, "file string, block bigint, part int, first boolean, text string")
    whole = pieces.where(F.col("part") == WHOLE).select("file", F.col("text").alias("record"), "first")
    # a record's fragments lie in splits that follow each other; there are two at most to a split
    along = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.where(F.col("part") != WHOLE).withColumn("_record", F.sum((F.col("part") == BEGINNING).cast("int")).over(along))
    joined = numbered.groupBy("file", "_record").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("all"), F.max("first").alias("first"))
    spanning = joined.select("file", F.array_join(F.transform("all", lambda p: p["text"]), "\n").alias("record"), "first")
    both = whole.unionByName(spanning).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return both.where(F.col("record") != "")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of headered, quoted CSV files with declared columns; values that don't fit their column's type are null."""
    kind = T._parse_datatype_string(schema)
    parsed = F.from_csv("record", F.lit(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return records(spark, path).where("not first").select(parsed.alias("_row")).select("_row.*")
