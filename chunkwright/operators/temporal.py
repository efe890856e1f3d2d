"""Scores along time, per group: smoothing, thresholds, budgets, merging into segments, caps, cuts and overlaps.

All windows of a stage share one partition key, so a stage needs one exchange. Ties are broken by time, then by the other columns. Groups of more
than `most` rows are cut into ranges (see `scan`); `long` passes on which groups those are, so that they are looked for once in a flow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions.scalar import safe_ratio
from chunkwright.operators import scan


def smooth(rows: DataFrame, group: str, t: str, score: str, weights: tuple[float, float, float] = (0.2, 0.6, 0.2), most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """Three-point weighted sum; what lies outside a group counts 0."""
    met = scan.shifted(rows, [group], [t], {"_before": (score, -1, 0.0), "_after": (score, 1, 0.0)}, most, long)
    before, own, after = (F.lit(x) for x in weights)
    return met.withColumn("smooth", before * F.col("_before") + own * F.col(score) + after * F.col("_after")).drop("_before", "_after")


def percentile_gate(rows: DataFrame, group: str, score: str, share: float = 0.6, floor: float = 0.35, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """Rows at or above their group's percentile (an element of the group) and above a floor; adds the percentile as `edge`."""

    def whole(table: DataFrame) -> DataFrame:
        return table.withColumn("edge", F.percentile_approx(score, share, 2 * scan.MOST).over(Window.partitionBy(group)))  # exact for as many rows

    def cut(table: DataFrame) -> DataFrame:
        table = scan.kept(table)
        edges = scan.at_places(table, [group], score, {"edge": lambda n: scan.place_of(share, n)}, most)
        return scan.matched(table, scan.kept(edges.drop("n")), [group], "inner")

    gated = scan.by_size(rows, [group], whole, cut, min(most, scan.MOST), long)
    return gated.where((F.col(score) >= F.col("edge")) & (F.col(score) > floor))


def highpass(rows: DataFrame, group: str, t: str, score: str, share: float = 0.6, floor: float = 0.35, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """Smooth, then keep what passes its group's percentile and the floor."""
    long = scan.long_groups(rows, [group], most) if long is scan.Ask else long
    return percentile_gate(smooth(rows, group, t, score, most=most, long=long), group, "smooth", share, floor, most, long)


def top_k(rows: DataFrame, group: str, t: str, score: str, k: Column, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """The k rows of each group with the highest scores, k from each row's own group; adds `rank`."""
    ranked = scan.running(rows, [group], [F.desc(score), F.col(t)], {"rank": (F.lit(1), "count")}, most=most, long=long)
    return ranked.where(F.col("rank") <= k)


def budget_rows(duration: Column | str, least: float = 30.0, share: float = 0.2, chunk: float = 5.0) -> Column:
    """How many chunks a summary of max(least, share * duration) seconds has."""
    return F.floor(F.greatest(F.lit(least), F.col(duration) * share if isinstance(duration, str) else duration * share) / chunk).cast("int")


def merge_islands(rows: DataFrame, group: str, t: str, chunk: float = 5.0, bridge: float = 1.0, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """Chunks of one length merged over gaps up to `bridge`: (group, start_time, end_time, chunks).

    A long group's ranges are merged each for itself; only an island at either end of a range can go on in the next one, so those (two a range)
    are merged once more.
    """

    def islands(table: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(start)
        fresh = F.when(F.col(start) - (F.lag(end).over(w) + chunk) <= bridge, 0).otherwise(1)
        numbered = table.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        found = numbered.groupBy(*keys, "_island").agg(F.min(start).alias("_start"), F.max(end).alias("_end"), F.sum("_chunks").alias("_chunks"))
        return found.drop("_island")

    def whole(table: DataFrame) -> DataFrame:
        return islands(table.select(group, t, F.lit(1).cast("bigint").alias("_chunks")), [group], t, t)

    def cut(table: DataFrame) -> DataFrame:
        part = scan.ranged(table.select(group, t, F.lit(1).cast("bigint").alias("_chunks")), [group], [t], most)
        edge = Window.partitionBy(group, "_range")
        local = scan.kept(islands(part, [group, "_range"], t, t).withColumn("_outer", (F.col("_start") == F.min("_start").over(edge)) | (F.col("_end") == F.max("_end").over(edge))))
        outer = islands(local.where("_outer").drop("_outer", "_range"), [group], "_start", "_end")
        return local.where("not _outer").select(*outer.columns).unionByName(outer)

    found = scan.by_size(rows, [group], whole, cut, most, long)
    return found.select(group, F.col("_start").alias("start_time"), (F.col("_end") + chunk).alias("end_time"), F.col("_chunks").alias("chunks"))


def cap_segments(segments: DataFrame, group: str, duration: str, least: int = 3, per: float = 45.0, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """The longest max(least, duration / per) segments of each group; of equal ones the earlier."""
    keep = F.greatest(F.lit(least), F.floor(F.col(duration) / per).cast("int"))
    ranked = scan.running(segments, [group], [F.desc(F.col("end_time") - F.col("start_time")), F.col("start_time")], {"_rank": (F.lit(1), "count")}, most=most, long=long)
    return ranked.where(F.col("_rank") <= keep).drop("_rank")


def plan_segments(
    scores: DataFrame, durations: DataFrame, group: str, t: str, score: str, chunk: float = 5.0, bridge: float = 1.0, least: float = 30.0, share: float = 0.2, most: int = scan.MOST
) -> DataFrame:
    """Budgeted top chunks merged into segments and capped: (group, start_time, end_time, duration). An unknown duration is 0."""
    long = scan.long_groups(scores, [group], most)
    known = scores.join(durations.select(group, F.col("duration").alias("_total")), group, "left").fillna({"_total": 0.0})
    chosen = top_k(known, group, t, score, budget_rows("_total", least, share, chunk), most, long)
    segments = merge_islands(chosen, group, t, chunk, bridge, most, long).join(durations.select(group, F.col("duration").alias("_total")), group, "left").fillna({"_total": 0.0})
    return cap_segments(segments, group, "_total", most=most, long=long).select(group, "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"))


def cut_plan(segments: DataFrame, group: str, pad: float = 0.25, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """Cuts with padding, numbered in time: seek, length, index."""
    seek = F.greatest(F.lit(0.0), F.col("start_time") - pad)
    length = F.greatest(F.col("start_time") + 1, F.col("end_time")) - F.col("start_time") + 2 * pad
    numbered = scan.running(segments.select(group, "start_time", "end_time"), [group], ["start_time"], {"index": (F.lit(1), "count")}, most=most, long=long)
    return numbered.select(group, "start_time", "end_time", (F.col("index") - 1).cast("int").alias("index"), seek.alias("seek"), length.alias("length"))


def concat_list(cuts: DataFrame, group: str, folder: str = "temp_chunks") -> DataFrame:
    """One line of a concatenation list per cut."""
    line = F.concat(F.lit(f"file '{folder}/"), F.col(group), F.lit("_"), F.col("index").cast("string"), F.lit(".mp4'"))
    return cuts.select(group, "index", line.alias("line"))


def redundancy(segments: DataFrame, group: str, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """Mean overlap of neighbouring segments; 0 with fewer than two."""
    met = scan.shifted(segments.select(group, "start_time", "end_time"), [group], ["start_time"], {"_next": ("start_time", 1, None)}, most, long)
    overlap = F.when(F.col("_next").isNotNull(), F.greatest(F.lit(0.0), F.col("end_time") - F.col("_next")))
    return met.withColumn("_overlap", overlap).groupBy(group).agg(F.coalesce(F.avg("_overlap"), F.lit(0.0)).alias("redundancy"))


def interval_overlap(a: DataFrame, b: DataFrame, group: str, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """Per group: seconds of a, seconds of b, and seconds in which they overlap, over all pairs.

    Overlap is accumulated by a sweep: at each end point the change of the number of open intervals on either
    side, running sums, and time weighted by the product. No pair of intervals is formed.
    """

    def ends(rows: DataFrame, side: str) -> DataFrame:
        opened = rows.select(group, F.col("start_time").alias("t"), F.lit(1).alias(side))
        return opened.unionByName(rows.select(group, F.col("end_time").alias("t"), F.lit(-1).alias(side)))

    points = ends(a, "da").withColumn("db", F.lit(0)).unionByName(ends(b, "db").withColumn("da", F.lit(0)))
    steps = points.groupBy(group, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    long = scan.long_groups(steps, [group], most) if long is scan.Ask else long
    steps = scan.shifted(steps, [group], ["t"], {"_next": ("t", 1, None)}, most, long)
    steps = scan.running(steps, [group], ["t"], {"na": (F.col("da"), "sum"), "nb": (F.col("db"), "sum")}, most=most, long=long, unique=True)
    swept = steps.select(group, F.coalesce(F.col("_next") - F.col("t"), F.lit(0.0)).alias("width"), "na", "nb")
    return swept.groupBy(group).agg(
        F.sum(F.col("width") * F.col("na")).alias("a_sec"), F.sum(F.col("width") * F.col("nb")).alias("b_sec"), F.sum(F.col("width") * F.col("na") * F.col("nb")).alias("overlap_sec")
    )


def precision_recall(overlaps: DataFrame) -> DataFrame:
    """precision, recall and F1 from overlap seconds."""
    p, r = safe_ratio("overlap_sec", "a_sec"), safe_ratio("overlap_sec", "b_sec")
    with_pr = overlaps.withColumn("precision", p).withColumn("recall", r)
    return with_pr.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def running_budget(rows: DataFrame, order: str, size: str, budget: float, most: int = 1 << 16) -> DataFrame:
    """Rows in order as long as the sizes before them stay below a budget; adds `before`.

    The running sum is taken in two levels (within ranges of the order, then over range totals), and there are as many ranges as there are `most` rows.
    Rows with a null order come first; rows of one order count one after the other by size, then by their other columns, and may lie in several
    ranges. A null size is 0.
    """
    width = F.coalesce(F.col(size), F.lit(0))
    summed = scan.running(rows.withColumn("_width", width), [], [F.col(order).asc_nulls_first(), "_width"], {"before": (F.col("_width"), "sum")}, before=True, most=most)
    return summed.withColumn("before", F.coalesce("before", F.lit(0))).where(F.col("before") < budget).drop("_width")


def intro_ramp(rows: DataFrame, group: str, t: str, longest: float = 30.0, share: float = 0.1, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """A factor that rises from 0.7 to 1 over a group's introduction, 1 elsewhere."""
    long = scan.long_groups(rows, [group], most) if long is scan.Ask else long
    limit = F.least(F.lit(longest), share * (F.col("_t1") - F.col("_t0")))
    marked = scan.with_totals(rows, [group], {"_t0": F.min(t), "_t1": F.max(t)}, most, long).withColumn("_intro", (F.col(t) < limit).cast("int")).drop("_t0", "_t1")
    marked = scan.with_totals(marked, [group], {"_size": F.sum("_intro")}, most, long)
    marked = scan.running(marked, [group], [t], {"_turn": (F.lit(1), "count")}, most=most, long=long)
    ramp = F.when(F.col("_size") == 1, F.lit(0.7)).otherwise(F.lit(0.7) + F.lit(0.3) * (F.col("_turn") - 1) / (F.col("_size") - 1))
    return marked.withColumn("ramp", F.when(F.col("_intro") == 1, ramp).otherwise(F.lit(1.0))).drop("_intro", "_size", "_turn")
