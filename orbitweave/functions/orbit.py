"""Orbits: period, constellation, Kepler motion with J2 secular drift, square footprints, pointing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import geo
from orbitweave.functions import vectors as V

# Gravity and oblateness of the Earth.
MU, J2, R_EQUATOR = 3.986004418e14, 1.08262668e-3, 6_378_137.0
NEWTON_STEPS = 8


def period_s(a_m: float) -> float:
    return 2.0 * math.pi * math.sqrt(a_m**3 / MU)


def anomaly_lag_deg(seconds: float, a_m: float) -> float:
    """Mean anomaly by which a follower trails on the same orbit."""
    return 360.0 * seconds / period_s(a_m)


def constellation(spark: SparkSession, prefix: str, planes: int, per_plane: int, a: float, e: float, i: float, raan: float, argp: float, m: float) -> DataFrame:
    """Evenly spaced satellites: ``actor, role, a, e, i, raan, argp, m`` (metres, degrees); names are Prefix_plane0_sat1."""
    p, s = F.floor(F.col("id") / per_plane), F.col("id") % per_plane
    name = F.concat(F.lit(f"{prefix}_plane"), p.cast("string"), F.lit("_sat"), s.cast("string"))
    return spark.range(planes * per_plane).select(
        name.alias("actor"),
        role_of(name).alias("role"),
        F.lit(a).alias("a"),
        F.lit(e).alias("e"),
        F.lit(i).alias("i"),
        F.pmod(F.lit(raan) + p * (360.0 / planes), F.lit(360.0)).alias("raan"),
        F.lit(argp).alias("argp"),
        F.pmod(F.lit(m) + s * (360.0 / per_plane), F.lit(360.0)).alias("m"),
    )


def role_of(name: Column) -> Column:
    """``tip`` or ``cue`` by the name; any other name is an error."""
    return F.when(name.contains("Tip"), "tip").when(name.contains("Cue"), "cue").otherwise(F.raise_error(F.concat(F.lit("neither Tip nor Cue: "), name)))


def eccentric_anomaly(mean: Column, e: Column) -> Column:
    """Solves Kepler's equation by a fixed number of Newton steps."""
    step = lambda x, _: x - (x - e * F.sin(x) - mean) / (1.0 - e * F.cos(x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), mean, step)


def state(a: Column, e: Column, i: Column, raan: Column, argp: Column, m: Column, seconds: Column) -> Column:
    """``STRUCT<r, v>`` in the inertial frame, ``seconds`` after the elements' epoch."""
    n, p, inc = F.sqrt(F.lit(MU) / (a * a * a)), a * (1.0 - e * e), F.radians(i)
    rate = 1.5 * J2 * F.pow(R_EQUATOR / p, 2.0) * n
    angles = F.struct(
        inc.alias("inc"),
        (F.radians(raan) - rate * F.cos(inc) * seconds).alias("node"),
        (F.radians(argp) + rate * (2.0 - 2.5 * F.pow(F.sin(inc), 2.0)) * seconds).alias("perigee"),
        n.alias("n"),
        F.pmod(F.radians(m) + (n + rate * F.sqrt(1.0 - e * e) * (1.0 - 1.5 * F.pow(F.sin(inc), 2.0))) * seconds, F.lit(2.0 * math.pi)).alias("mean"),
    )
    flat = e * e

    def in_plane(q: Column) -> Column:
        return V.let(
            eccentric_anomaly(q["mean"], e),
            lambda x: F.struct(
                q.alias("q"),
                (a * (F.cos(x) - e)).alias("x"),
                (a * F.sqrt(1.0 - flat) * F.sin(x)).alias("y"),
                (-a * F.sin(x) * q["n"] / (1.0 - e * F.cos(x))).alias("vx"),
                (a * F.sqrt(1.0 - flat) * F.cos(x) * q["n"] / (1.0 - e * F.cos(x))).alias("vy"),
            ),
        )

    def turned(s: Column, u: str, w: str) -> Column:
        q = s["q"]
        f, g = s[u] * F.cos(q["perigee"]) - s[w] * F.sin(q["perigee"]), s[u] * F.sin(q["perigee"]) + s[w] * F.cos(q["perigee"])
        return V.vec(F.cos(q["node"]) * f - F.sin(q["node"]) * F.cos(q["inc"]) * g, F.sin(q["node"]) * f + F.cos(q["node"]) * F.cos(q["inc"]) * g, F.sin(q["inc"]) * g)

    return V.let(V.let(angles, in_plane), lambda s: F.struct(turned(s, "x", "y").alias("r"), turned(s, "vx", "vy").alias("v")))


def earth_fixed(r: Column, days: Column) -> Column:
    """Inertial to Earth-fixed by the Earth rotation angle."""
    return V.rotate_z(r, -geo.earth_angle(days))


def axes(r: Column, v: Column) -> Column:
    """``STRUCT<along, across, nadir>``: along-track, cross-track and nadir unit vectors."""
    nadir = V.normalize(V.scale(r, -1.0))
    both = V.let(nadir, lambda n: F.struct(n.alias("nadir"), V.normalize(V.cross(n, v)).alias("across")))
    return V.let(both, lambda q: F.struct(V.cross(q["across"], q["nadir"]).alias("along"), q["across"].alias("across"), q["nadir"].alias("nadir")))


def pointing(r: Column, v: Column, yaw: Column, pitch: Column, roll: Column, forward=0.0, sideways=0.0) -> Column:
    """Inertial direction of a ray of the sensor: tangents ``forward`` and ``sideways`` of the boresight, turned by the attitude in degrees."""
    ray = V.vec(F.lit(forward), F.lit(sideways), F.lit(1.0))
    cr, sr, cp, sp, cy, sy = F.cos(F.radians(roll)), F.sin(F.radians(roll)), F.cos(F.radians(pitch)), F.sin(F.radians(pitch)), F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    rolled = V.vec(ray["x"], cr * ray["y"] - sr * ray["z"], sr * ray["y"] + cr * ray["z"])
    pitched = V.vec(cp * rolled["x"] + sp * rolled["z"], rolled["y"], -sp * rolled["x"] + cp * rolled["z"])
    turned = V.vec(cy * pitched["x"] - sy * pitched["y"], sy * pitched["x"] + cy * pitched["y"], pitched["z"])
    return V.let(F.struct(axes(r, v).alias("a"), turned.alias("t")), lambda q: V.normalize(V.vec(*(q["t"]["x"] * q["a"]["along"][k] + q["t"]["y"] * q["a"]["across"][k] + q["t"]["z"] * q["a"]["nadir"][k] for k in "xyz"))))


def ground_hit(r: Column, direction: Column) -> Column:
    """Where a ray meets the WGS84 ellipsoid first, in the frame of r; null if it misses."""
    stretch = geo.WGS84_A / geo.WGS84_B

    def meet(q: Column) -> Column:
        o, d = V.vec(q["r"]["x"], q["r"]["y"], q["r"]["z"] * stretch), V.vec(q["d"]["x"], q["d"]["y"], q["d"]["z"] * stretch)
        terms = F.struct(V.dot(d, d).alias("a"), V.dot(o, d).alias("b"), (V.dot(o, o) - geo.WGS84_A**2).alias("c"), q["r"].alias("r"), q["d"].alias("d"))
        return V.let(terms, lambda s: V.let(F.struct(s.alias("s"), (s["b"] * s["b"] - s["a"] * s["c"]).alias("root")), along))

    def along(q: Column) -> Column:
        s = q["s"]
        t = (-s["b"] - F.sqrt(F.greatest(q["root"], F.lit(0.0)))) / s["a"]
        return F.when((q["root"] >= 0) & (t > 0), V.add(s["r"], V.scale(s["d"], t)))

    return V.let(F.struct(r.alias("r"), direction.alias("d")), meet)


def _on_ground(hit: Column, days: Column) -> Column:
    """Geodetic place of a hit, or null; the ray is followed once."""
    return V.let(hit, lambda h: F.when(h.isNotNull(), geo.geodetic(earth_fixed(h, days))))


def footprint(r: Column, v: Column, days: Column, fov_deg: float, yaw=0.0, pitch=0.0, roll=0.0) -> Column:
    """Corners of the square field of view on the ground, ``ARRAY<STRUCT<lat, lon, alt>>``; a corner off the Earth is null."""
    yaw, pitch, roll = (c if isinstance(c, Column) else F.lit(float(c)) for c in (yaw, pitch, roll))
    t = math.tan(math.radians(fov_deg / 2.0))
    corners = [(t, -t), (t, t), (-t, t), (-t, -t)]
    return F.array(*(_on_ground(ground_hit(r, pointing(r, v, yaw, pitch, roll, f, s)), days) for f, s in corners))


def boresight(r: Column, v: Column, days: Column, yaw=0.0, pitch=0.0, roll=0.0) -> Column:
    """``STRUCT<lat, lon, alt>`` that the centre ray meets, or null."""
    yaw, pitch, roll = (c if isinstance(c, Column) else F.lit(float(c)) for c in (yaw, pitch, roll))
    return _on_ground(ground_hit(r, pointing(r, v, yaw, pitch, roll)), days)


def look_attitude(r: Column, v: Column, target: Column) -> Column:
    """``STRUCT<off_nadir, pitch, roll>`` in degrees that turn the boresight from nadir to a target in r's frame."""

    def parts(q: Column) -> Column:
        return F.struct(*(V.dot(q["d"], q["a"][axis]).alias(k) for k, axis in zip("xyz", ("along", "across", "nadir"), strict=True)))

    def angles(q: Column) -> Column:
        return F.struct(
            F.degrees(F.acos(V.clipped(q["z"]))).alias("off_nadir"),
            F.degrees(F.atan2(q["x"], F.sqrt(q["y"] * q["y"] + q["z"] * q["z"]))).alias("pitch"),
            F.degrees(F.atan2(-q["y"], q["z"])).alias("roll"),
        )

    return V.let(V.let(F.struct(axes(r, v).alias("a"), V.normalize(V.sub(target, r)).alias("d")), parts), angles)
