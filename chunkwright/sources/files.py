"""Readers and writers: media files, tables, headered CSV, JSON documents, captions, manifests, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.sources.objects import entries
from chunkwright.sources.quoted import read_csv

CAPTIONS = "map<string,struct<text:array<string>,start:array<double>,end:array<double>>>"
MANIFEST = "video_id string, task_id int, rank int, category_1 string, category_2 string"
TRANSCRIPTS = "file string, start_time string, text string"
SCORES = "file string, start_time string, tfidf_score string"


def media_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """Whole files by a name pattern: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """One row: GiB of the plain files in a folder; contents aren't read."""
    return spark.read.format("binaryFile").load(folder).select("length").agg((F.coalesce(F.sum("length"), F.lit(0)) / F.lit(2.0**30)).alias("gib"))


def existing(spark: SparkSession, folder: str, least_bytes: int = 0) -> DataFrame:
    """(name, length) of the files in a folder that are larger than a size."""
    rows = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("name"), "length")
    return rows.where(F.col("length") > least_bytes)


def missing_from(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present, key, "left_anti")


def found_in(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present, key, "left_semi")


def headered_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header and declared columns; quotes are doubled, fields may span lines, broken rows become nulls.

    A file is one task, so that quotes may stand anywhere; well-formed files are read by `quoted.read_csv` in many.
    """
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def scored_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, start_time, score) as numbers; repeated header rows go."""
    rows = read_csv(spark, path, SCORES).where("start_time <> 'start_time'")
    return rows.select("file", F.col("start_time").try_cast("double").alias("start_time"), F.col("tfidf_score").try_cast("double").alias("score"))


def transcripts_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, TRANSCRIPTS).where("start_time <> 'start_time'")
    return rows.select("file", F.col("start_time").try_cast("double").alias("start_time"), "text")


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def caption_rows(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, text, start, end) of JSON documents of parallel arrays by video; a large document is read by ranges."""
    return entries(spark, path).select(F.explode(F.from_json("entry", CAPTIONS)).alias("video_id", "c")).select("video_id", "c.text", "c.start", "c.end")


def caption_table(captions: DataFrame) -> DataFrame:
    """(video_id, caption_text, has_caption, start_time, end_time); empty captions start and end at 0."""
    from chunkwright.functions.scalar import first_or, has_text, last_or

    text = F.array_join("text", " ")
    return captions.select("video_id", text.alias("caption_text"), has_text(text).alias("has_caption"), first_or("start").alias("start_time"), last_or("end").alias("end_time"))


def caption_arrays(rows: DataFrame) -> DataFrame:
    """Caption pieces (text, start, duration) as parallel arrays with ends."""
    return rows.select("video_id", F.transform("pieces", lambda p: p["text"]).alias("text"), F.transform("pieces", lambda p: p["start"]).alias("start"), F.transform("pieces", lambda p: p["start"] + p["duration"]).alias("end"))


def caption_document(rows: DataFrame) -> DataFrame:
    """One row: captions by video as a JSON document. The format is one object, so one task holds them all: for manifests of up to a few million captions."""
    entry = F.struct("video_id", F.struct("text", "start", "end"))
    return rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def with_captions(wanted: DataFrame, captions: DataFrame, key: str = "video_id") -> DataFrame:
    """Manifest rows that have captions, with these; a manifest row without any is left out."""
    return wanted.join(captions, key)


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines of plain-text files, one row each."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def committed(spark: SparkSession, path: str, read):  # noqa: ANN001, ANN201
    """What `read()` gives, if the writer of the folder came to its end (its marker is there); else an error."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        raise FileNotFoundError(f"{path} has no commit marker")
    return read()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return headered_csv(spark, path, MANIFEST)


def or_default(read, default: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """What `read()` gives, or a given table where the source can't be analysed; without one the error stands."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException:
        if default is None:
            raise
        return default


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Headered CSV; in one part where a single file is wanted (then one task writes all rows: for reports, not for tables that grow)."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """One-row documents as text, by one task."""
    df.coalesce(1).write.mode("overwrite").text(path)


def timeline(scores: DataFrame, segments: DataFrame, group: str) -> DataFrame:
    """Plot-ready rows: score points and segment spans of each group."""
    points = scores.select(group, F.lit("point").alias("kind"), F.col("start_time").alias("x0"), F.col("start_time").alias("x1"), F.col("score").alias("y"))
    return points.unionByName(segments.select(group, F.lit("span").alias("kind"), F.col("start_time").alias("x0"), F.col("end_time").alias("x1"), F.lit(None).cast("double").alias("y")))


def heatmap(rows: DataFrame, group: str, t: str, features: str) -> DataFrame:
    """Long form of vectors: (group, t, dim, value)."""
    return rows.select(group, t, F.posexplode(features).alias("dim", "value"))
