"""The media flow on made-up vectors: shapes, ranges, and segments that don't overlap."""

import numpy as np
from pyspark.sql import functions as F

from chunkwright.plans import media
from chunkwright.sources import files


def test_flow(spark, tmp_path):
    rng = np.random.default_rng(0)
    kinds = rng.normal(size=(8, 13)) * 20
    with (tmp_path / "v.json").open("w") as f:
        for i in range(50):
            values = (kinds[rng.integers(8)] + rng.normal(size=13)).round(4).tolist()
            f.write(f'{{"file": "talk.wav", "start_time": {5.0 * i}, "mfcc": {values}}}\n')
    vectors = files.json_lines(spark, str(tmp_path / "v.json"), "file string, start_time double, mfcc array<double>")
    assert vectors.count() == 50
    relevance = media.tokens_and_relevance(vectors, media.Params(clusters=8))
    assert relevance.count() == 50 and relevance.select("token_id").distinct().count() == 8
    scores = media.smoothed_scores(relevance).withColumn("base", F.substring_index("file", ".", 1)).cache()
    assert 0 < scores.count() <= 50 - 30 + 1
    durations = spark.createDataFrame([("talk", 250.0)], "base string, duration double")
    segments, cuts, report = media.highlights(scores, durations)
    rows = segments.orderBy("start_time").collect()
    assert rows and all(a["end_time"] + 1 < b["start_time"] for a, b in zip(rows, rows[1:]))
    assert sum(r["duration"] for r in rows) <= 50 and cuts.count() == len(rows) and report.count() == 1
    frames = scores.where("start_time < 100").select("file", "start_time", F.lit("x.jpg").alias("image_name"), F.lit(1.0).alias("blur_score"))
    assert media.fuse(scores, frames).count() == frames.count()
