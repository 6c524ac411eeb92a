"""Three-vectors as ``STRUCT<x, y, z: DOUBLE>`` and rotations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Axis length below which two directions count as aligned.
ALIGNED = 1e-8


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: an expression that uses it many times doesn't copy its tree."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of a double by whole numbers, which makes no decimal of each; next to a half, and beyond 10^12 units, ``F.round`` itself."""
    unit = 10.0**digits
    y = x * unit
    plain = (F.abs(y) < 1e12) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(plain, F.floor(y + 0.5) / unit).otherwise(F.round(x, digits))


def vec(x, y, z) -> Column:
    """A vector from three columns or numbers."""
    x, y, z = (c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scale(a: Column, k) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda p: vec(
            p["a"]["y"] * p["b"]["z"] - p["a"]["z"] * p["b"]["y"], p["a"]["z"] * p["b"]["x"] - p["a"]["x"] * p["b"]["z"], p["a"]["x"] * p["b"]["y"] - p["a"]["y"] * p["b"]["x"]
        ),
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector; null for the zero vector."""
    unit = lambda v: F.when(norm(v) > 0, scale(v, 1.0 / F.nullif(norm(v), F.lit(0.0))))
    return let(a, unit)


def clipped(c: Column) -> Column:
    """Into [-1, 1], for arc functions."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def angle(a: Column, b: Column) -> Column:
    """Radians between two vectors."""
    return F.acos(clipped(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))))


def rotate_about(v: Column, axis: Column, radians: Column) -> Column:
    """Rodrigues: v turned about a unit axis."""

    def turned(q: Column) -> Column:
        p, k, c, s = q["v"], q["k"], q["c"], q["s"]
        along = dot(k, p) * (1.0 - c)
        crossed = lambda i, j: k[i] * p[j] - k[j] * p[i]
        return vec(*(p[x] * c + crossed(i, j) * s + k[x] * along for x, i, j in ("xyz", "yzx", "zxy")))

    return let(F.struct(v.alias("v"), axis.alias("k"), F.cos(radians).alias("c"), F.sin(radians).alias("s")), turned)


def align(v: Column, source: Column, target: Column) -> Column:
    """v under the least rotation that takes direction ``source`` to ``target``; v itself if they are aligned."""

    def measured(q: Column) -> Column:
        axis = cross(normalize(q["a"]), normalize(q["b"]))
        return let(F.struct(q["v"].alias("v"), axis.alias("k"), angle(q["a"], q["b"]).alias("turn")), lambda w: F.struct(w.alias("w"), norm(w["k"]).alias("n")))

    def turned(q: Column) -> Column:
        w = q["w"]
        return F.when(q["n"] < ALIGNED, w["v"]).otherwise(rotate_about(w["v"], scale(w["k"], 1.0 / F.nullif(q["n"], F.lit(0.0))), w["turn"]))

    # Each part is bound once: written out, the axis would stand in the tree some thousand times.
    return let(let(F.struct(v.alias("v"), source.alias("a"), target.alias("b")), measured), turned)


def plane_normal(a: Column, b: Column) -> Column:
    """Unit normal of the plane through two directions."""
    return normalize(cross(a, b))


def rotate_z(v: Column, radians: Column) -> Column:
    parts = F.struct(v.alias("v"), F.cos(radians).alias("c"), F.sin(radians).alias("s"))
    return let(parts, lambda q: vec(q["c"] * q["v"]["x"] - q["s"] * q["v"]["y"], q["s"] * q["v"]["x"] + q["c"] * q["v"]["y"], q["v"]["z"]))
