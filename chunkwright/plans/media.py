"""The media flow from feature vectors to highlight segments, as one DataFrame plan after the cluster fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.scalar import stem
from chunkwright.operators.attention import hybrid_attention
from chunkwright.operators.evaluate import evaluate
from chunkwright.operators.features import cluster_tokens, standard_scale
from chunkwright.operators.relevance import tfidf_rows
from chunkwright.operators.temporal import cut_plan, highpass, plan_segments


@dataclass(frozen=True)
class Params:
    """All constants of the flow."""

    clusters: int | None = None
    seed: int = 42
    percentile: float = 0.6
    floor: float = 0.35
    chunk: float = 5.0
    bridge: float = 1.0
    least_seconds: float = 30.0
    share: float = 0.2


def tokens_and_relevance(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(file, start_time, mfcc, token_id, score) from (file, start_time, mfcc)."""
    scaled = standard_scale(vectors.where("mfcc is not null"), "mfcc")
    tokens, _ = cluster_tokens(scaled, "scaled", p.clusters, p.seed)
    return tfidf_rows(tokens.drop("scaled"), "file", "token_id").select("file", "start_time", "mfcc", "token_id", "score")


def smoothed_scores(relevance: DataFrame, p: Params = Params()) -> DataFrame:
    """(file, start_time, score): hybrid attention, smoothed and high-passed."""
    hybrid = hybrid_attention(relevance, "file", "start_time", "score", "mfcc")
    return highpass(hybrid, "file", "start_time", "hybrid_score", p.percentile, p.floor).select("file", "start_time", F.col("smooth").alias("score"))


def fuse(scores: DataFrame, frames: DataFrame) -> DataFrame:
    """Scores that have a keyframe: joined by base name and chunk number, so that no float is a key."""
    place = lambda d: d.withColumn("base", stem("file")).withColumn("pos", F.round(F.col("start_time") / 5.0).cast("bigint"))
    right = place(frames).select("base", "pos", "image_name", "blur_score")
    return place(scores).join(right, ["base", "pos"]).select("base", "start_time", "score", "image_name", "blur_score")


def highlights(scores: DataFrame, durations: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, cuts, evaluation) per base from (base, start_time, score) and (base, duration)."""
    segments = plan_segments(scores, durations, "base", "start_time", "score", p.chunk, p.bridge, p.least_seconds, p.share)
    return segments, cut_plan(segments, "base"), evaluate(segments, scores, durations, "base", chunk=p.chunk)
