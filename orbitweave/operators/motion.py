"""Moving targets: starting places on water, and a walk with mean-reverting speed and drifting heading."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import geo, noise
from orbitweave.operators.ordinal import with_ordinal
from orbitweave.operators.spatial import on_water


@dataclass(frozen=True)
class Walk:
    """Fixed values of the motion model: metres, seconds, degrees."""

    mean: float = 1.5
    low: float = 0.2
    high: float = 6.0
    reversion: float = 1.0 / 900.0
    sigma: float = 0.30
    turn: float = 2.0
    max_lat: float = 70.0
    tries: int = 12


def start_targets(spark: SparkSession, n: int, land_cells: DataFrame, res_deg: float, seed: int, max_lat: float | None = 70.0, surplus: int = 4) -> DataFrame:
    """``whale_id, lat, lon, alt, speed, heading`` of n targets, uniform over the water of the sphere.

    ``surplus * n`` places are drawn, and twice as many as long as fewer than n are on water; the first n are
    kept and numbered from 0. The draws are a function of the seed and their number, so the n targets don't
    depend on ``surplus``. Hardly any water in the band (one draw in 10,000) is an error."""

    def on_sea(draws: int) -> DataFrame:
        drawn = spark.range(draws).select(
            F.col("id").alias("draw"), geo.sphere_lat(noise.uniform(seed, F.col("id"), "lat")).alias("lat"), (noise.uniform(seed, F.col("id"), "lon") * 360.0 - 180.0).alias("lon")
        )
        return on_water(drawn if max_lat is None else drawn.where(F.abs("lat") <= max_lat), land_cells, "lat", "lon", res_deg)

    draws = max(1, surplus * n)
    while (found := on_sea(draws).count()) < n:
        if draws > 10_000 * n:
            raise ValueError("too little water for the targets")
        draws *= 2
    numbered = with_ordinal(on_sea(draws), F.col("draw"), [], "whale_id", start=0, total=found).where(F.col("whale_id") < n)
    return numbered.select(
        "whale_id", "lat", "lon", F.lit(0.0).alias("alt"),
        (0.5 + 2.5 * noise.uniform(seed, F.col("whale_id"), "speed")).alias("speed"), (360.0 * noise.uniform(seed, F.col("whale_id"), "heading")).alias("heading"),
    )


def next_speed(speed: Column, dt: float, gauss: Column, walk: Walk = Walk()) -> Column:
    """Ornstein-Uhlenbeck step, clamped."""
    moved = speed + walk.reversion * (walk.mean - speed) * dt + gauss * walk.sigma * math.sqrt(dt)
    return F.greatest(F.lit(walk.low), F.least(F.lit(walk.high), moved))


def bounced_step(lat: Column, lon: Column, heading: Column, distance: Column, max_lat: float) -> Column:
    """``STRUCT<heading, lat, lon>``: a step, turned round once if it would leave the latitude band (not tested again)."""
    ahead, back = geo.geodesic_step(lat, lon, heading, distance), F.pmod(heading + 180.0, F.lit(360.0))
    out = F.abs(ahead["lat"]) > max_lat
    behind = geo.geodesic_step(lat, lon, back, distance)
    return F.struct(F.when(out, back).otherwise(heading).alias("heading"), F.when(out, behind["lat"]).otherwise(ahead["lat"]).alias("lat"), F.when(out, behind["lon"]).otherwise(ahead["lon"]).alias("lon"))


def _land_bits(land_cells: DataFrame, res_deg: float) -> np.ndarray:
    """The raster as packed bits: its size is fixed by the resolution (3.3 MB at 0.05 degrees)."""
    rows, cols = round(180.0 / res_deg), round(360.0 / res_deg)
    width = -(-cols // 8)
    bits = np.zeros((rows, width), dtype=np.uint8)
    packed = land_cells.distinct().groupBy("row", F.floor(F.col("col") / 8).alias("byte")).agg(F.bit_or(F.pow(F.lit(2.0), 7 - F.col("col") % 8).cast("int")).alias("bits"))
    for r in packed.toLocalIterator():
        bits[r.row, r.byte] = r.bits
    return bits


def walk_targets(targets: DataFrame, land_cells: DataFrame, res_deg: float, steps: int, dt: float, seed: int, walk: Walk = Walk()) -> DataFrame:
    """``whale_id, step, lat, lon, alt, speed, heading`` for steps 0 to ``steps`` - 1; step 0 has moved once already.

    Targets are independent: each task advances its batch of targets step by step, vectorised over the batch."""
    bits = targets.sparkSession.sparkContext.broadcast(_land_bits(land_cells, res_deg))
    rows, cols = round(180.0 / res_deg), round(360.0 / res_deg)

    def land(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        r = np.clip(((90.0 - lat) / res_deg).astype(int), 0, rows - 1)
        c = np.clip(((lon + 180.0) / res_deg).astype(int), 0, cols - 1)
        return (bits.value[r, c // 8] >> (7 - c % 8)) & 1 == 1

    def go(lat, lon, heading, distance):
        phi, theta, d = np.radians(lat), np.radians(heading), distance / geo.EARTH_RADIUS_M
        sine = np.clip(np.sin(phi) * np.cos(d) + np.cos(phi) * np.sin(d) * np.cos(theta), -1, 1)
        east = np.arctan2(np.sin(theta) * np.sin(d) * np.cos(phi), np.cos(d) - np.sin(phi) * sine)
        moved = distance != 0
        return np.where(moved, np.degrees(np.arcsin(sine)), lat), np.where(moved, (lon + np.degrees(east) + 180.0) % 360.0 - 180.0, lon)

    def draw(ids: np.ndarray, step: int, what: int) -> np.ndarray:
        """Uniform in [0, 1) by a counter-based hash: independent of batches."""
        with np.errstate(over="ignore"):
            x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + step * 1009 + what) % (1 << 63))
            for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
        return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)

    def normal(ids: np.ndarray, step: int, what: int) -> np.ndarray:
        return np.sqrt(-2.0 * np.log(1.0 - draw(ids, step, what))) * np.cos(2.0 * np.pi * draw(ids, step, what + 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame.whale_id.to_numpy()
            lat, lon, speed, heading = (frame[c].to_numpy().copy() for c in ("lat", "lon", "speed", "heading"))
            for step in range(steps):
                if dt > 0:
                    speed = np.clip(speed + walk.reversion * (walk.mean - speed) * dt + normal(ids, step, 0) * walk.sigma * math.sqrt(dt), walk.low, walk.high)
                    heading = (heading + normal(ids, step, 2) * walk.turn * math.sqrt(dt)) % 360.0
                    distance = speed * dt
                    lat1, lon1 = go(lat, lon, heading, distance)
                    out = np.abs(lat1) > walk.max_lat
                    heading = np.where(out, (heading + 180.0) % 360.0, heading)
                    lat1, lon1 = go(lat, lon, heading, distance)
                    for attempt in range(walk.tries):
                        stuck = land(lat1, lon1) | (np.abs(lat1) > 89.9)
                        if not stuck.any():
                            break
                        turn = (30.0 + 120.0 * draw(ids, step, 10 + 2 * attempt)) * np.where(draw(ids, step, 11 + 2 * attempt) < 0.5, 1.0, -1.0)
                        heading = np.where(stuck, (heading + turn) % 360.0, heading)
                        distance = np.where(stuck, distance * 0.7, distance)
                        again = go(lat, lon, heading, distance)
                        lat1, lon1 = np.where(stuck, again[0], lat1), np.where(stuck, again[1], lon1)
                        if attempt == walk.tries - 1:  # stays where it was
                            lat1, lon1 = np.where(stuck, lat, lat1), np.where(stuck, lon, lon1)
                    lat, lon = lat1, lon1
                yield pd.DataFrame({"whale_id": ids, "step": step, "lat": lat, "lon": lon, "alt": frame.alt.to_numpy(), "speed": speed, "heading": heading})

    return targets.mapInPandas(run, "whale_id long, step int, lat double, lon double, alt double, speed double, heading double")
