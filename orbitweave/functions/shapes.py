"""Boxes, polygons and image-plane rotations of annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate_point(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    """``STRUCT<x, y>`` turned about a centre."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.struct(((x - cx) * c - (y - cy) * s + cx).alias("x"), ((x - cx) * s + (y - cy) * c + cy).alias("y"))


def inverse_angle(degrees: Column) -> Column:
    return F.pmod(360 - degrees, F.lit(360))


def envelope(xs: Column, ys: Column) -> Column:
    """``STRUCT<x, y, w, h>`` around two arrays of coordinates."""
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def rotate_box(x: Column, y: Column, w: Column, h: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    """Envelope of the turned corners of a box."""
    corners = [rotate_point(a, b, cx, cy, degrees) for a in (x, x + w) for b in (y, y + h)]
    return envelope(F.array(*(c["x"] for c in corners)), F.array(*(c["y"] for c in corners)))


def rotate_rings(rings: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    """Every x, y pair of every flat ring turned about a centre."""

    def turned(ring: Column) -> Column:
        def pair(k: Column) -> Column:
            p = rotate_point(F.get(ring, 2 * k), F.get(ring, 2 * k + 1), cx, cy, degrees)
            return F.array(p["x"], p["y"])

        pairs = F.floor(F.size(ring) / 2).cast("int")
        return F.when(pairs == 0, F.array().cast("array<double>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), pair)))

    return F.transform(rings, turned)


def polygon_box(points: Column) -> Column:
    """Box of an array of ``STRUCT<x, y>``."""
    return envelope(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


def flat_ring(points: Column, digits: int | None = None) -> Column:
    """``[[x1, y1, x2, y2, ...]]``."""
    put = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return F.array(F.flatten(F.transform(points, lambda p: F.array(put(p["x"]), put(p["y"])))))


def display_scale(width: Column, height: Column, screen: int = 768) -> Column:
    return F.greatest(F.lit(1), F.floor(screen / F.greatest(width, height)).cast("int"))
