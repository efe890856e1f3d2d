"""Evaluation of summaries against scores: one row of fifteen measures per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.scalar import safe_ratio
from chunkwright.operators import scan
from chunkwright.operators.temporal import interval_overlap, precision_recall, redundancy


def evaluate(
    segments: DataFrame, scores: DataFrame, durations: DataFrame, group: str, t: str = "start_time", score: str = "score", chunk: float = 5.0, most: int = scan.MOST, long: scan.Long = scan.Ask
) -> DataFrame:
    """segments (group, start_time, end_time, duration), scores (group, t, score), durations (group, duration; unknown is 0)."""
    sums = segments.groupBy(group).agg(F.sum("duration").alias("_sum"), F.count(F.lit(1)).alias("segments"), (F.max("end_time") - F.min("start_time")).alias("_span"))
    known = sums.join(durations.select(group, F.col("duration").alias("_total")), group, "left").fillna({"_total": 0.0})
    long = scan.long_groups(scores, [group], most) if long is scan.Ask else long
    edges = scan.quantile(scores, [group], score, 0.8, "_edge", most, long)
    overall = scores.groupBy(group).agg(F.sum(score).alias("_importance")).join(edges, group)
    starts = segments.select(group, F.col("start_time").alias(t)).distinct()
    chosen = scores.join(starts, [group, t], "left_semi").groupBy(group).agg(F.sum(score).alias("_chosen"), F.avg(score).alias("_mean"))
    important = scores.join(overall.select(group, "_edge"), group).where(F.col(score) >= F.col("_edge"))
    important = important.select(group, F.col(t).alias("start_time"), (F.col(t) + chunk).alias("end_time"))
    agreed = precision_recall(interval_overlap(segments.select(group, "start_time", "end_time"), important, group, most, long))
    joined = known.join(overall, group, "left").join(chosen, group, "left").join(redundancy(segments, group, most, long), group).join(agreed.select(group, "precision", "recall", "f1"), group)
    r = lambda x, d: F.bround(F.round(x, 9), d)  # noqa: E731  ties are decided on what is left of summation noise
    return joined.select(
        group,
        r(F.col("_total"), 2).alias("original_duration_sec"),
        r(F.col("_sum"), 2).alias("summary_duration_sec"),
        r(safe_ratio("_sum", "_total"), 3).alias("compression_ratio"),
        "segments",
        r(F.col("_span"), 2).alias("timeline_span_sec"),
        r(safe_ratio("_span", "_total"), 3).alias("timeline_coverage"),
        r(safe_ratio("segments", "_sum"), 3).alias("diversity_score"),
        r(safe_ratio("segments", "_total"), 4).alias("highlight_density"),
        r(F.coalesce(safe_ratio(F.coalesce("_chosen", F.lit(0.0)), "_importance"), F.lit(0.0)), 3).alias("importance_coverage"),
        r(F.coalesce("_mean", F.lit(0.0)), 3).alias("avg_importance"),
        r(F.col("redundancy"), 3).alias("redundancy_score"),
        r(F.col("precision"), 3).alias("temporal_precision"),
        r(F.col("recall"), 3).alias("temporal_recall"),
        r(F.col("f1"), 3).alias("temporal_f1"),
    )
