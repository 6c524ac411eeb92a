"""The observation queue: detections wait for a follow-up view, with a delay and a time to live.

A view at t belongs to the latest detection d of the same target with d <= t; it counts if
delay < t - d <= ttl, and ends the wait, so of each detection only the earliest views count (all of them
if several share that time). A new detection starts the wait again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts)


def latest_within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within_us: int, out: str) -> DataFrame:
    """As-of join: to each row of ``left`` the latest ``right_time`` of its keys that is at most ``within_us`` before (else null).

    Rows are windowed by (keys, time bucket of ``within_us``); right rows also stand in the bucket after theirs. So
    a window holds two buckets of one key at most, however many rows the key has."""
    t = lambda c: F.floor(F.col(c) / within_us)
    marks = right.select(*keys, F.col(right_time).alias("__t")).distinct().withColumn("__b", F.explode(F.array(F.floor(F.col("__t") / within_us), F.floor(F.col("__t") / within_us) + 1)))
    rows = left.select(F.struct(*left.columns).alias("__row"), *keys, F.col(left_time).alias("__t"), t(left_time).alias("__b"))
    both = rows.withColumn("__d", F.lit(None).cast("long")).unionByName(marks.withColumn("__d", F.col("__t")), allowMissingColumns=True)
    # At equal times a right row comes first: a null __row sorts before others.
    w = Window.partitionBy(*keys, "__b").orderBy("__t", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__d", F.last("__d", ignorenulls=True).over(w)).where(F.col("__row").isNotNull())
    near = F.when(F.col("__t") - F.col("__d") <= within_us, F.col("__d"))
    return found.select("__row.*", near.alias(out))


def observation_queue(detections: DataFrame, opportunities: DataFrame, keys: list[str], detected: str, seen: str, delay_s: int, ttl_s: int) -> DataFrame:
    """The opportunities that become views, with ``detected_us``; times are microseconds."""
    waiting = latest_within(opportunities, detections, keys, seen, detected, ttl_s * 1_000_000, "detected_us")
    gap = F.col(seen) - F.col("detected_us")
    open_ = waiting.where((gap > delay_s * 1_000_000) & (gap <= ttl_s * 1_000_000))
    first = F.min(seen).over(Window.partitionBy(*keys, "detected_us"))
    return open_.withColumn("__first", first).where(F.col(seen) == F.col("__first")).drop("__first")


def pending_spans(detections: DataFrame, views: DataFrame, keys: list[str], detected: str, seen: str, ttl_s: int) -> DataFrame:
    """``keys, start_us, end_us``: how long each detection waits; until the next detection, its view or the end of its life."""
    ends = views.groupBy(*keys, F.col("detected_us").alias(detected)).agg(F.min(seen).alias("__seen"))
    spans = detections.select(*keys, detected).distinct()
    nxt = latest_within(
        spans.withColumn("__neg", -F.col(detected) - 1), spans.withColumn("__neg", -F.col(detected)), keys, "__neg", "__neg", ttl_s * 1_000_000, "__next"
    ).withColumn("__next", -F.col("__next"))
    return (
        nxt.join(ends, [*keys, detected], "left")
        .select(*keys, F.col(detected).alias("start_us"), F.least(F.col(detected) + ttl_s * 1_000_000, "__next", "__seen").alias("end_us"))
    )


def pending_by_tick(spans: DataFrame, tick_us: int) -> DataFrame:
    """``tick_us, pending``: spans that are open at each tick (start <= tick < end)."""
    first, last = F.ceil(F.col("start_us") / tick_us), F.ceil(F.col("end_us") / tick_us) - 1
    ticks = spans.where(first <= last).select(F.explode(F.sequence(first, last)).alias("tick"))
    return ticks.groupBy("tick").agg(F.count("*").alias("pending")).select((F.col("tick") * tick_us).alias("tick_us"), "pending")


def counts_with_zeros(events: DataFrame, tick: Column, group: str, ticks: DataFrame, groups: DataFrame) -> DataFrame:
    """``tick, group, n, any``: a row for each tick and group, also where nothing happened."""
    seen = events.groupBy(tick.alias("tick"), group).agg(F.count("*").alias("n"))
    return ticks.crossJoin(groups).join(seen, ["tick", group], "left").select("tick", group, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("any_detected"))


def tick_report(detections: DataFrame, views: DataFrame, detected: str, seen: str, tick_us: int) -> DataFrame:
    """``tick_us, detections, views``: what a run prints, as a table."""
    one = lambda df, c, n: df.groupBy((F.floor(F.col(c) / tick_us) * tick_us).alias("tick_us")).agg(F.count("*").alias(n))
    both = one(detections, detected, "detections").join(one(views, seen, "views"), "tick_us", "full")
    return both.select("tick_us", F.coalesce("detections", F.lit(0)).alias("detections"), F.coalesce("views", F.lit(0)).alias("views"))
