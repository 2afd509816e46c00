"""Numeric intervals [start, end) in seconds: islands, gaps, cuts, complements. Each group (a recording, a user) is a window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .segments import islands


#: Seconds of a recording (or of a user's time) that one task looks at.
CHUNK = 3600.0


def merge_nearby(intervals: DataFrame, *key: str, gap: float = 0.12, width: float = CHUNK) -> DataFrame:
    """(key, start, end): intervals at most `gap` apart are one. A key is cut into chunks of `width`, so that a long one is the work of many tasks."""
    return islands(intervals, *key, width=width, gap=gap).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merge_to_count(intervals: DataFrame, count: int | Column, *key: str) -> DataFrame:
    """(key, start, end): the smallest gaps (the first of equal ones) are closed until `count` intervals are left."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    gap = F.lead("start").over(w) - F.col("end")
    t = intervals.withColumn("_i", F.row_number().over(w)).withColumn("_gap", gap).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    t = t.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_gap").asc_nulls_last(), "_i")))
    closed = F.col("_gap").isNotNull() & (F.col("_rank") <= F.col("_n") - (F.lit(count) if isinstance(count, int) else count))
    t = t.withColumn("_cut", F.when(closed, 0).otherwise(1))
    t = t.withColumn("_island", F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return t.groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max_by("end", "_i").alias("end")).drop("_island")


def gap_features(intervals: DataFrame, *key: str) -> DataFrame:
    """intervals with duration, mid, gap_before, gap_after, max_gap."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    before = F.coalesce(F.greatest(F.lit(0.0), F.col("start") - F.lag("end").over(w)), F.lit(0.0))
    after = F.coalesce(F.greatest(F.lit(0.0), F.lead("start").over(w) - F.col("end")), F.lit(0.0))
    out = intervals.withColumn("duration", F.greatest(F.lit(0.01), F.col("end") - F.col("start"))).withColumn("mid", (F.col("start") + F.col("end")) / 2)
    return out.withColumn("gap_before", before).withColumn("gap_after", after).withColumn("max_gap", F.greatest("gap_before", "gap_after"))


def gap_candidates(intervals: DataFrame, *key: str) -> DataFrame:
    """(key, time, gap): the middle of each gap."""
    following = F.lead("start").over(Window.partitionBy(*key).orderBy("start", "end"))
    t = intervals.withColumn("_next", following).filter("_next IS NOT NULL")
    return t.select(*key, ((F.col("end") + F.col("_next")) / 2).alias("time"), (F.col("_next") - F.col("end")).alias("gap"))


def cut_selection(regions: DataFrame, selections: DataFrame, *key: str) -> DataFrame:
    """Regions without what a group's selection (sel_start, sel_end) covers: none, one or two pieces each, of more than 10 ms. Touching isn't overlap."""
    hit = (regions["start"] < selections["sel_end"]) & (regions["end"] > selections["sel_start"])
    for k in key:
        hit = hit & (regions[k] == selections[k])
    joined = regions.join(selections, hit, "left").select(*[regions[c] for c in regions.columns], "sel_start", "sel_end")
    piece = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    parts = F.when(F.col("sel_start").isNull(), F.array(piece(F.col("start"), F.col("end")))).otherwise(F.filter(F.array(piece(F.col("start"), F.least("end", "sel_start")), piece(F.greatest("start", "sel_end"), F.col("end"))), lambda p: p["end"] - p["start"] > 0.01))
    others = [c for c in regions.columns if c not in ("start", "end")]
    return joined.select(*others, F.explode(parts).alias("p")).select(*others, "p.start", "p.end")


def invert_selection(start: Column, end: Column, duration: Column) -> Column:
    """What of [0, duration) one selection leaves, in pieces of more than 50 ms."""
    parts = F.array(F.struct(F.lit(0.0).alias("start"), start.alias("end")), F.struct(end.alias("start"), duration.alias("end")))
    return F.filter(parts, lambda p: p["end"] - p["start"] > 0.05)


def valid_region(start: Column, end: Column, duration: Column) -> Column:
    """What is wrong with a region, or null."""
    return F.when(start >= end, F.lit("empty")).when(end > duration + 0.05, F.lit("beyond the end"))


def default_region(playhead: Column, duration: Column) -> Column:
    length = F.least(F.lit(5.0), duration / 10)
    start = F.greatest(F.lit(0.0), playhead - length / 2)
    return F.struct(start.alias("start"), F.least(duration, start + length).alias("end"))


def move_region(start: Column, end: Column, by: Column, duration: Column) -> Column:
    length = end - start
    moved = F.greatest(F.lit(0.0), F.least(duration - length, start + by))
    return F.struct(moved.alias("start"), (moved + length).alias("end"))


def resize_region(start: Column, end: Column, to: Column, duration: Column, left: bool) -> Column:
    """One handle moved; the region stays at least 50 ms long."""
    if left:
        return F.struct(F.greatest(F.lit(0.0), F.least(to, end - 0.05)).alias("start"), end.alias("end"))
    return F.struct(start.alias("start"), F.least(duration, F.greatest(to, start + 0.05)).alias("end"))


def region_sort(regions: DataFrame) -> DataFrame:
    """By start, the earlier made first among equals."""
    return regions.orderBy("start", "id")


def visible(mode: str, selected: Column, hidden: Column) -> Column:
    return {"selected": selected, "all": F.lit(True), "hidden": F.lit(False)}.get(mode, ~hidden)


def running_share(targets: DataFrame, *key: str, weight: str = "weight", order: str = "ord") -> DataFrame:
    """targets with share_from and share_to: their place in the running sum of weights, from 0 to 1."""
    w, whole = Window.partitionBy(*key).orderBy(order), Window.partitionBy(*key)
    total = F.sum(weight).over(whole)
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return targets.withColumn("share_from", (upto - F.col(weight)) / total).withColumn("share_to", upto / total)


def proportional_split(targets: DataFrame, duration: Column, *key: str, syllables: str = "syllables", order: str = "ord") -> DataFrame:
    """targets with start and end: the duration dealt out by syllables (one for a target without)."""
    weighted = targets.withColumn("_w", F.when(F.coalesce(F.col(syllables), F.lit(0)) > 0, F.col(syllables)).otherwise(1))
    out = running_share(weighted, *key, weight="_w", order=order)
    return out.withColumn("start", F.col("share_from") * duration).withColumn("end", F.col("share_to") * duration).drop("_w", "share_from", "share_to")


def install_regions(regions: DataFrame, duration: Column) -> DataFrame:
    """Clamped to the recording; those of at most 10 ms go."""
    out = regions.withColumn("start", F.greatest(F.lit(0.0), F.coalesce("start", F.lit(0.0)))).withColumn("end", F.least(duration, F.coalesce("end", F.lit(0.0))))
    return out.filter(F.col("end") > F.col("start") + 0.01)


def target_weight(beats: Column, syllables: Column) -> Column:
    return F.when(F.coalesce(beats, F.lit(0.0)) > 0, beats).when(F.coalesce(syllables, F.lit(0)) > 0, syllables.cast("double")).otherwise(F.lit(1.0))


def match_cost(duration: Column, expected: Column, mid_error: Column, span: Column, pause_hint: Column, gap_after: Column, max_gap: Column) -> Column:
    pause = F.when(pause_hint, F.when(gap_after >= 0.16, -0.18).otherwise(0.24)).otherwise(0.0)
    reward = F.when(max_gap >= 0.2, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1.35 * F.abs(F.log((duration + 0.04) / (F.greatest(F.lit(0.03), expected) + 0.04))) + 0.95 * F.abs(mid_error) / span + pause - reward)


def skip_target_cost(weight: Column) -> Column:
    return 0.62 + F.least(F.lit(1.45), 0.25 * weight)


def skip_interval_cost(duration: Column, mean: Column) -> Column:
    return 0.45 + F.least(F.lit(0.9), 0.4 * duration / (mean + 0.03))
