"""Queries of the observation queue over events: views are detections, clicks opportunities, users targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import vectors as V
from orbitweave.operators import attitude, matching, queue
from orbitweave.plans.tables import EVENTS_SQL, events, table
from orbitweave.sources.scratch import fresh_path
from orbitweave.streaming import queue as streams

DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def _queue(spark: SparkSession, sf_dir: str, ttl_s: int) -> DataFrame:
    ev = events(spark, sf_dir)
    kind = lambda k: ev.where(F.col("event_type") == k).select("user_id", "event_id", "t")
    seen = queue.observation_queue(kind("view"), kind("click"), ["user_id"], "t", "t", 300, ttl_s)
    return seen.select("user_id", "event_id", F.col("detected_us"), F.col("t").alias("seen_us"), (F.col("t") - F.col("detected_us")).alias("wait_us"))


def _queue_sql(ttl_s: int) -> str:
    return f"""
WITH {EVENTS_SQL},
d AS (SELECT user_id, t, CAST(NULL AS BIGINT) AS event_id, 0 AS k FROM ev WHERE event_type = 'view' GROUP BY user_id, t),
u AS (SELECT * FROM d UNION ALL SELECT user_id, t, event_id, 1 FROM ev WHERE event_type = 'click'),
a AS (SELECT *, max(CASE WHEN k = 0 THEN t END) OVER (PARTITION BY user_id ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS det FROM u),
g AS (SELECT * FROM a WHERE k = 1 AND t - det > 300000000 AND t - det <= {ttl_s}000000),
f AS (SELECT *, min(t) OVER (PARTITION BY user_id, det) AS first FROM g)
SELECT user_id, event_id, CAST(det AS BIGINT) AS detected_us, t AS seen_us, CAST(t - det AS BIGINT) AS wait_us FROM f WHERE t = first"""


def observation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir, 1200)


def observation_queue_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir, 86_400)


#: Slices of time in which the stream lands, and files of one micro-batch.
SLICES, FILES_PER_BATCH = 6, 4
#: Events of a share of the targets: states grow in number with the table, not in size.
EVENTS_PER_SHARE = 50_000


def streamed_queue_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of a day as a stream: events land in slices of time and go through keyed state to files, which are read."""
    landed, seen, marks = (fresh_path(spark, x) for x in ("landed", "streamed", "stream-marks"))
    kind = F.when(F.col("event_type") == "view", "detection").otherwise("opportunity")
    rows = events(spark, sf_dir).where(F.col("event_type").isin("view", "click")).select(F.col("user_id").cast("string").alias("key"), F.col("t").alias("t_us"), "event_id", kind.alias("kind"), F.timestamp_micros("t").alias("at"))
    late = streams.write_slices(rows, "at", "t_us", landed, SLICES)
    stream = streams.read_slices(spark, landed, rows.schema, FILES_PER_BATCH)
    shares = rows.count() // EVENTS_PER_SHARE + 1
    streams.write_queue(streams.stream_queue(stream, "at", 300, 86_400, f"{late} seconds", shares), seen, marks)
    views = spark.read.schema(streams.VIEWS).parquet(seen)
    return views.select(F.col("key").cast("long").alias("user_id"), "event_id", "detected_us", "seen_us", (F.col("seen_us") - F.col("detected_us")).alias("wait_us"))


def pending_backlog_by_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _queue(spark, sf_dir, 86_400).withColumnRenamed("seen_us", "t")
    detections = events(spark, sf_dir).where("event_type = 'view'").select("user_id", "t")
    spans = queue.pending_spans(detections, views, ["user_id"], "t", "t", 86_400)
    return queue.pending_by_tick(spans, HOUR_US)


PENDING_SQL = f"""
WITH q AS ({_queue_sql(86_400)}),
{EVENTS_SQL},
d AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'view'),
n AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM d),
s AS (SELECT user_id, detected_us, min(seen_us) AS seen FROM q GROUP BY user_id, detected_us),
x AS (SELECT n.t AS a, least(n.t + {DAY_US}, coalesce(n.nxt, 9000000000000000), coalesce(s.seen, 9000000000000000)) AS b FROM n LEFT JOIN s ON n.user_id = s.user_id AND n.t = s.detected_us),
k AS (SELECT unnest(range((a + {HOUR_US - 1}) // {HOUR_US}, (b + {HOUR_US - 1}) // {HOUR_US})) AS tick FROM x)
SELECT CAST(tick * {HOUR_US} AS BIGINT) AS tick_us, count(*) AS pending FROM k GROUP BY tick"""


def detections_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    ends = ev.agg(F.min(F.floor(F.col("t") / HOUR_US)).alias("a"), F.max(F.floor(F.col("t") / HOUR_US)).alias("b"))
    ticks = ends.select(F.explode(F.sequence("a", "b")).alias("tick"))
    kinds = ev.select("event_type").distinct()
    return queue.counts_with_zeros(ev, F.floor(F.col("t") / HOUR_US), "event_type", ticks, kinds)


ZEROS_SQL = f"""
WITH {EVENTS_SQL}, b AS (SELECT t // {HOUR_US} AS tick, event_type FROM ev),
ticks AS (SELECT unnest(range((SELECT min(tick) FROM b), (SELECT max(tick) FROM b) + 1)) AS tick),
n AS (SELECT tick, event_type, count(*) AS n FROM b GROUP BY tick, event_type)
SELECT CAST(k.tick AS BIGINT) AS tick, e.event_type, coalesce(n.n, 0) AS n, coalesce(n.n, 0) > 0 AS any_detected
FROM ticks k CROSS JOIN (SELECT DISTINCT event_type FROM events) e LEFT JOIN n ON n.tick = k.tick AND n.event_type = e.event_type"""


def last_log_row_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).where("event_type = 'view'")
    last = F.max_by(F.struct("event_id", "user_id", "value"), F.struct("t", "event_id")).alias("last")
    return ev.groupBy(F.floor(F.col("t") / HOUR_US).alias("tick")).agg(F.count("*").alias("n"), last).select("tick", "n", "last.event_id", "last.user_id", "last.value")


LAST_ROW_SQL = f"""
WITH {EVENTS_SQL}, r AS (SELECT t // {HOUR_US} AS tick, event_id, user_id, value, row_number() OVER (PARTITION BY t // {HOUR_US} ORDER BY t DESC, event_id DESC) AS k,
count(*) OVER (PARTITION BY t // {HOUR_US}) AS n FROM ev WHERE event_type = 'view')
SELECT CAST(tick AS BIGINT) AS tick, n, event_id, user_id, value FROM r WHERE k = 1"""


def attitude_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attitude (value) an instrument (user) has turned from, within each day, in the order of events."""
    ev = events(spark, sf_dir).where("event_type = 'click'").withColumn("day", F.floor(F.col("t") / DAY_US))
    before = matching.previous(ev, ["day", "user_id"], ["t", "event_id"], "value")
    return ev.select("event_id", "user_id", "day", F.round(before, 6).alias("before"), F.round(F.col("value") - before, 6).alias("turned"))


CARRY_SQL = f"""
WITH {EVENTS_SQL}, c AS (SELECT event_id, user_id, t // {DAY_US} AS day, t, value FROM ev WHERE event_type = 'click'),
p AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY day, user_id ORDER BY t, event_id), 0) AS before FROM c)
SELECT event_id, user_id, CAST(day AS BIGINT) AS day, round(before, 6) AS before, round(value - before, 6) AS turned FROM p"""


#: Rows of a range, few so that the groups of small tables are cut as well.
TURNS_PER_RANGE = 1_000


def carried_attitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attitude after each event, where each kind of event turns one instrument on from its last attitude: about the axis that the user tells, by the value."""
    axis = F.when(F.col("user_id") % 3 == 0, V.vec(1.0, 0.0, 0.0)).when(F.col("user_id") % 3 == 1, V.vec(0.0, 1.0, 0.0)).otherwise(V.vec(0.0, 0.0, 1.0))
    rows = events(spark, sf_dir).select("event_id", "event_type", "t", attitude.turn(axis, F.coalesce("value", F.lit(0.0))).alias("turn"))
    turned = attitude.carried(rows, ["event_type"], ["t", "event_id"], "turn", rows_per_range=TURNS_PER_RANGE)
    return turned.select("event_id", *((F.round(f"after.{c}", 6) + 0.0).alias(c) for c in "wxyz"), (F.round("before.w", 6) + 0.0).alias("before_w"))


CARRIED_SQL = f"""WITH RECURSIVE {EVENTS_SQL},
r AS MATERIALIZED (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS k, cos(radians(coalesce(value, 0)) / 2) AS a, CASE WHEN user_id % 3 = 0 THEN sin(radians(coalesce(value, 0)) / 2) ELSE 0 END AS b,
 CASE WHEN user_id % 3 = 1 THEN sin(radians(coalesce(value, 0)) / 2) ELSE 0 END AS c, CASE WHEN user_id % 3 = 2 THEN sin(radians(coalesce(value, 0)) / 2) ELSE 0 END AS d FROM ev),
f AS (SELECT event_type, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, 1.0::DOUBLE AS before_w FROM (SELECT DISTINCT event_type FROM r)
 UNION ALL SELECT f.event_type, r.k, r.event_id, w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a, w FROM f JOIN r ON r.event_type = f.event_type AND r.k = f.k + 1)
SELECT event_id, round(w, 6) + 0 AS w, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) + 0 AS z, round(before_w, 6) + 0 AS before_w FROM f WHERE k > 0"""


def detections_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of 50 seconds."""
    ev = table(spark, sf_dir, "events").where("event_type = 'view'")
    return ev.groupBy(F.window("ts", "50 seconds")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(queue.micros(F.col("window.start")).alias("start_us"), "n", "users")


WINDOW_SQL = f"WITH {EVENTS_SQL} SELECT CAST(t // 50000000 * 50000000 AS BIGINT) AS start_us, count(*) AS n, count(DISTINCT user_id) AS users FROM ev WHERE event_type = 'view' GROUP BY t // 50000000"

def tick_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _queue(spark, sf_dir, 86_400)
    return queue.tick_report(events(spark, sf_dir).where("event_type = 'view'"), views, "t", "seen_us", HOUR_US)


REPORT_SQL = f"""WITH q AS ({_queue_sql(86_400)}), {EVENTS_SQL}, d AS (SELECT t // {HOUR_US} * {HOUR_US} AS tick_us, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY 1), v AS (SELECT seen_us // {HOUR_US} * {HOUR_US} AS tick_us, count(*) AS n FROM q GROUP BY 1)
SELECT CAST(coalesce(d.tick_us, v.tick_us) AS BIGINT) AS tick_us, coalesce(d.n, 0) AS detections, coalesce(v.n, 0) AS views FROM d FULL JOIN v ON d.tick_us = v.tick_us"""

QUERIES = {
    "tick_report": (tick_report, REPORT_SQL),
    "observation_queue": (observation_queue, _queue_sql(1200)),
    "observation_queue_day": (observation_queue_day, _queue_sql(86_400)),
    "streamed_queue_day": (streamed_queue_day, _queue_sql(86_400)),
    "pending_backlog_by_tick": (pending_backlog_by_tick, PENDING_SQL),
    "detections_per_tick": (detections_per_tick, ZEROS_SQL),
    "last_log_row_per_tick": (last_log_row_per_tick, LAST_ROW_SQL),
    "carried_attitudes": (carried_attitudes, CARRIED_SQL),
    "attitude_carryover": (attitude_carryover, CARRY_SQL),
    "detections_by_window": (detections_by_window, WINDOW_SQL),
}
