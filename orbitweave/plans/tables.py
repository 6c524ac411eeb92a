"""Stand-ins from the driver's tables: moving targets, satellites, land cells, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import geo
from orbitweave.functions.noise import lcg
from orbitweave.operators.queue import micros

LAND_RES = 1.0
LAND_SHARE = 0.29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by a key: a small file of one row group would be one task, however much work follows its rows."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, key)


def place_of_target(k: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the target of a key."""
    return geo.sphere_lat(lcg(k, 1)), lcg(k, 2) * 360.0 - 180.0


def place_of_satellite(k: Column) -> tuple[Column, Column]:
    """Latitude and longitude below the satellite of a key."""
    return geo.sphere_lat(lcg(k, 5)), lcg(k, 6) * 360.0 - 180.0


def target_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``whale_id`` alone, as it lies in the files: for joins that shuffle it and make places behind the shuffle."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("whale_id"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as targets: ``whale_id, lat, lon, speed, heading``."""
    k = F.col("c_custkey")
    lat, lon = place_of_target(k)
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(
        k.alias("whale_id"), lat.alias("lat"), lon.alias("lon"), (0.5 + 2.5 * lcg(k, 3)).alias("speed"), (lcg(k, 4) * 360.0).alias("heading")
    )


def satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as satellites: ``sat, role, sat_lat, sat_lon``."""
    k = F.col("s_suppkey")
    lat, lon = place_of_satellite(k)
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(k.alias("sat"), F.when(k % 2 == 0, "tip").otherwise("cue").alias("role"), lat.alias("sat_lat"), lon.alias("sat_lon"))


def land(spark: SparkSession) -> DataFrame:
    """Land cells ``row, col`` of a 1-degree raster, by chance."""
    cols = round(360.0 / LAND_RES)
    return spark.range(round(180.0 / LAND_RES) * cols).where(lcg(F.col("id"), 7) < LAND_SHARE).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``t``, their time in microseconds."""
    return table(spark, sf_dir, "events").withColumn("t", micros(F.col("ts")))


# The same in SQL.
def lcg_sql(key: str, draw: int) -> str:
    return f"(CAST((CAST({key} AS BIGINT) * 1103515245 + {12345 * draw}) % 2147483648 AS DOUBLE) / 2147483648.0::DOUBLE)"


TARGETS_SQL = f"""targets AS (SELECT c_custkey AS whale_id, degrees(asin(2 * {lcg_sql('c_custkey', 1)} - 1)) AS lat, {lcg_sql('c_custkey', 2)} * 360 - 180 AS lon,
  0.5::DOUBLE + 2.5::DOUBLE * {lcg_sql('c_custkey', 3)} AS speed, {lcg_sql('c_custkey', 4)} * 360 AS heading FROM customer)"""
SATELLITES_SQL = f"""sats AS (SELECT s_suppkey AS sat, CASE WHEN s_suppkey % 2 = 0 THEN 'tip' ELSE 'cue' END AS role, degrees(asin(2 * {lcg_sql('s_suppkey', 5)} - 1)) AS sat_lat,
  {lcg_sql('s_suppkey', 6)} * 360 - 180 AS sat_lon FROM supplier)"""
LAND_SQL = f"land AS (SELECT CAST(id // 360 AS INTEGER) AS r, CAST(id % 360 AS INTEGER) AS c FROM (SELECT range AS id FROM range(64800)) WHERE {lcg_sql('id', 7)} < 0.29)"
EVENTS_SQL = "ev AS (SELECT *, epoch_us(ts) AS t FROM events)"
