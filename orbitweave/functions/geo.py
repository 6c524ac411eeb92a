"""Geodesy: angles, great-circle steps, WGS84 frames, sun position and view geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbitweave.functions import vectors as V

# Sphere of the targets, and WGS84.
EARTH_RADIUS_M = 6_371_000.0
WGS84_A, WGS84_E2 = 6_378_137.0, 6.69437999014e-3
WGS84_B = WGS84_A * math.sqrt(1.0 - WGS84_E2)
DARK_BELOW_DEG = -18.0
ASTRONOMICAL_UNIT_M = 149_597_870_700.0


def wrap_lon(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def clamp_lat(lat: Column) -> Column:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat))


def geodesic_step(lat: Column, lon: Column, bearing: Column, distance: Column) -> Column:
    """``STRUCT<lat, lon>`` after going ``distance`` metres along a great circle from a point in degrees."""
    phi, theta, d = F.radians(lat), F.radians(bearing), distance / EARTH_RADIUS_M
    sine = V.clipped(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(theta))
    east = F.atan2(F.sin(theta) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * sine)
    moved = distance != 0.0
    return F.struct(
        F.when(moved, F.degrees(F.asin(sine))).otherwise(lat).alias("lat"),
        F.when(moved, wrap_lon(F.degrees(F.radians(lon) + east))).otherwise(lon).alias("lon"),
    )


def central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Radians between two points of the sphere (haversine)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), 2.0)
    return 2.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def sphere_lat(u: Column) -> Column:
    """Latitude of a point that is uniform on the sphere, from u in [0, 1]."""
    return F.degrees(F.asin(2.0 * u - 1.0))


def fov_from_swath(swath_m: float, altitude_m: float) -> float:
    """Full field of view in degrees."""
    return math.degrees(2.0 * math.atan(swath_m / (2.0 * altitude_m)))


def up(lat: Column, lon: Column) -> Column:
    """Ellipsoid normal at geodetic degrees."""
    phi, lam = F.radians(lat), F.radians(lon)
    return V.vec(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))


def ecef(lat: Column, lon: Column, alt: Column) -> Column:
    """WGS84 geodetic degrees and metres to Earth-fixed metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1.0 - WGS84_E2 * F.pow(F.sin(phi), 2.0))
    return V.vec((n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * (1.0 - WGS84_E2) + alt) * F.sin(phi))


def geodetic(r: Column) -> Column:
    """Earth-fixed metres to ``STRUCT<lat, lon, alt>`` on WGS84 (Bowring's formula, applied twice)."""
    second = (WGS84_A**2 - WGS84_B**2) / WGS84_B**2

    def latitude(q: Column, beta: Column) -> Column:
        return F.atan2(q["z"] + second * WGS84_B * F.pow(F.sin(beta), 3.0), q["p"] - WGS84_E2 * WGS84_A * F.pow(F.cos(beta), 3.0))

    def refined(q: Column) -> Column:
        first = F.atan2(q["z"] * WGS84_A, q["p"] * WGS84_B)
        return V.let(latitude(q, first), lambda phi: latitude(q, F.atan2(WGS84_B * F.sin(phi), WGS84_A * F.cos(phi))))

    def finished(q: Column) -> Column:
        n = WGS84_A / F.sqrt(1.0 - WGS84_E2 * F.pow(F.sin(q["phi"]), 2.0))
        # Near the poles the height follows from z.
        alt = F.when(F.abs(F.cos(q["phi"])) > 1e-6, q["q"]["p"] / F.cos(q["phi"]) - n).otherwise(F.abs(q["q"]["z"]) - WGS84_B)
        return F.struct(F.degrees(q["phi"]).alias("lat"), F.degrees(q["q"]["lon"]).alias("lon"), alt.alias("alt"))

    plane = V.let(r, lambda v: F.struct(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]).alias("p"), v["z"].alias("z"), F.atan2(v["y"], v["x"]).alias("lon")))
    return V.let(plane, lambda q: V.let(F.struct(q.alias("q"), refined(q).alias("phi")), finished))


def enu(lat: Column, lon: Column, d: Column) -> Column:
    """An Earth-fixed difference vector as east, north, up at a point."""
    phi, lam = F.radians(lat), F.radians(lon)
    return V.vec(
        -F.sin(lam) * d["x"] + F.cos(lam) * d["y"],
        -F.sin(phi) * F.cos(lam) * d["x"] - F.sin(phi) * F.sin(lam) * d["y"] + F.cos(phi) * d["z"],
        F.cos(phi) * F.cos(lam) * d["x"] + F.cos(phi) * F.sin(lam) * d["y"] + F.sin(phi) * d["z"],
    )


def days_since_2000(ts: Column) -> Column:
    """Days since 2000-01-01 12:00 of a timestamp without zone (taken as UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("2000-01-01 12:00:00").cast("timestamp_ntz"), ts) / 86_400_000_000.0


def timestamp_of_days(days: Column) -> Column:
    """The inverse: days since 2000-01-01 12:00 to a timestamp without zone."""
    return F.timestamp_add("MICROSECOND", F.round(days * 86_400_000_000.0).cast("long"), F.lit("2000-01-01 12:00:00").cast("timestamp_ntz"))


def earth_angle(days: Column) -> Column:
    """Earth rotation angle in radians."""
    return F.pmod(2.0 * math.pi * (0.7790572732640 + 1.00273781191135448 * days), F.lit(2.0 * math.pi))


def sun_ecef(ts: Column) -> Column:
    """Sun position in Earth-fixed metres by the low-precision almanac formula (about 0.01 degree)."""
    n = days_since_2000(ts)
    g = F.radians(357.529 + 0.98560028 * n)
    lam = F.radians(280.459 + 0.98564736 * n + 1.915 * F.sin(g) + 0.020 * F.sin(2.0 * g))
    eps = F.radians(23.439 - 0.00000036 * n)
    r = (1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2.0 * g)) * ASTRONOMICAL_UNIT_M
    inertial = V.vec(r * F.cos(lam), r * F.cos(eps) * F.sin(lam), r * F.sin(eps) * F.sin(lam))
    return V.rotate_z(inertial, -earth_angle(n))


def elevation_deg(observer: Column, body: Column, model: str = "spherical") -> Column:
    """Elevation of ``body`` seen from ``observer``, above the plane normal to the sphere's or WGS84's vertical."""
    vertical = observer if model == "spherical" else V.vec(observer["x"] / WGS84_A**2, observer["y"] / WGS84_A**2, observer["z"] / WGS84_B**2)
    return F.degrees(F.asin(V.clipped(V.dot(V.normalize(V.sub(body, observer)), V.normalize(vertical)))))


def is_dark(observer: Column, sun: Column, threshold_deg: float = DARK_BELOW_DEG, model: str = "spherical") -> Column:
    """``STRUCT<dark, elevation, threshold>``."""
    e = elevation_deg(observer, sun, model)
    return F.struct((e < threshold_deg).alias("dark"), e.alias("elevation"), F.lit(threshold_deg).alias("threshold"))


def in_sight(observer: Column, satellite: Column, min_elevation_deg: float = 10.0, model: str = "wgs84") -> Column:
    return elevation_deg(observer, satellite, model) >= min_elevation_deg


def glint_satellite(target: Column, lat: Column, lon: Column, sun: Column, distance_m: float = 700_000.0) -> Column:
    """Where a satellite sees the mirror image of the sun in a level surface at the target."""
    rays = F.struct(up(lat, lon).alias("n"), V.normalize(V.sub(sun, target)).alias("s"))
    mirrored = V.let(rays, lambda q: V.normalize(V.sub(V.scale(q["n"], 2.0 * V.dot(q["n"], q["s"])), q["s"])))
    return V.let(mirrored, lambda m: V.add(target, V.scale(m, distance_m)))


def scene(satellite: Column, target: Column, sun: Column, width_px: int, gsd_m: float) -> Column:
    """View of a target: local satellite, sun-to-target direction, scene field of view, zenith angle, azimuth."""

    def seen(at: Column) -> Column:
        local, light = enu(at["lat"], at["lon"], V.sub(satellite, target)), enu(at["lat"], at["lon"], V.sub(target, sun))
        return F.struct(local.alias("local"), V.normalize(light).alias("light"))

    view = F.struct(geodetic(satellite).alias("sat"), V.let(geodetic(target), seen).alias("v"))
    return V.let(
        view,
        lambda q: F.struct(
            q["v"]["local"].alias("satellite"),
            V.vec(0, 0, 0).alias("target"),
            q["v"]["light"].alias("sun_direction"),
            F.degrees(2.0 * F.atan2(F.lit(width_px * gsd_m / 2.0), q["sat"]["alt"])).alias("fov_deg"),
            F.acos(V.clipped(q["v"]["local"]["z"] / V.norm(q["v"]["local"]))).alias("off_nadir_rad"),
            F.pmod(F.atan2(q["v"]["local"]["x"], q["v"]["local"]["y"]), F.lit(2.0 * math.pi)).alias("azimuth_rad"),
        ),
    )


def tilt_deg(pitch_deg: Column, roll_deg: Column) -> Column:
    """Angle of a boresight from nadir after pitch and roll."""
    return F.degrees(F.acos(V.clipped(F.cos(F.radians(pitch_deg)) * F.cos(F.radians(roll_deg)))))


def point_in_polygon(lat: Column, lon: Column, polygon: Column, planar: bool = False) -> Column:
    """Even-odd test in an array of ``STRUCT<lat, lon>`` whose edges are straight in latitude and longitude.

    The edges north of the point on its meridian are counted. Each edge goes the short way round, so a ring may
    cross the date line; one that runs round the globe holds the pole on its side. ``planar`` takes longitudes as they
    are instead. A ring of less than three points, or with a null among them, holds nothing."""
    n = F.size(polygon)
    east = (lambda p: p["lon"] - lon) if planar else (lambda p: wrap_lon(p["lon"] - lon))

    def edge(i: Column) -> Column:
        a, b = F.get(polygon, i), F.get(polygon, F.pmod(i + 1, n))
        turn = F.lit(0.0) if planar else 360.0 * F.round((east(a) - east(b)) / 360.0)
        return F.struct(a["lat"].alias("lat"), (b["lat"] - a["lat"]).alias("rise"), east(a).alias("a"), (east(b) + turn).alias("b"))

    def crosses(e: Column) -> Column:
        at = e["lat"] - e["a"] * e["rise"] / F.nullif(e["b"] - e["a"], F.lit(0.0))
        return F.when(((e["a"] > 0.0) != (e["b"] > 0.0)) & (at > lat), 1).otherwise(0)

    def inside(edges: Column) -> Column:
        north = F.aggregate(edges, F.lit(0), lambda s, e: s + crosses(e))
        if planar:
            return north % 2 == 1
        round_pole = F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["b"] - e["a"])) > 180.0
        northern = F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["lat"]) > 0.0
        return (north % 2 == 1) != (round_pole & northern)

    whole = (n >= 3) & F.forall(polygon, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return F.coalesce(whole & V.let(F.transform(F.sequence(F.lit(0), n - 1), edge), inside), F.lit(False))


def ring_edges(polygon: Column) -> Column:
    """The edges of a whole ring of ``STRUCT<lat, lon>``: ``ARRAY<STRUCT<lat, lon, wide, slope>>``, where ``wide`` goes the short way east."""
    n = F.size(polygon)

    def edge(a: Column, i: Column) -> Column:
        b = F.get(polygon, F.pmod(i + 1, n))
        east = b["lon"] - a["lon"]
        wide = wrap_lon(east)
        return F.struct(a["lat"].alias("lat"), wrap_lon(a["lon"]).alias("lon"), wide.alias("wide"), F.coalesce((b["lat"] - a["lat"]) / F.nullif(wide, F.lit(0.0)), F.lit(0.0)).alias("slope"))

    return F.transform(polygon, edge)


def holds_north_pole(edges: Column) -> Column:
    """Whether a ring's edges run round the globe, on the northern side."""
    total = lambda c: F.aggregate(edges, F.lit(0.0), lambda s, e: s + e[c])
    return (F.abs(total("wide")) > 180.0) & (total("lat") > 0.0)


def crosses_north(lat: Column, lon: Column, a_lat: Column, a_lon: Column, wide: Column, slope: Column) -> Column:
    """1 if an edge of ``ring_edges`` passes north of a point on its meridian, else 0."""
    apart = a_lon - lon
    east = apart - 360.0 * F.floor((apart + 180.0) / 360.0)
    return F.when(((east > 0.0) != (east + wide > 0.0)) & (a_lat - east * slope > lat), 1).otherwise(0)


def grid_cell(lat: Column, lon: Column, res_deg: float) -> Column:
    """``STRUCT<row, col>`` of a north-up raster, clamped to its edges."""
    rows, cols = round(180.0 / res_deg), round(360.0 / res_deg)
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c).cast("int")))
    return F.struct(clamp((90.0 - lat) / res_deg, rows).alias("row"), clamp((lon + 180.0) / res_deg, cols).alias("col"))
