"""Sea surface and mesh: wave grids, curvature, triangles, texture coordinates, normals, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def centred(index: Column, n: int, extent: float) -> Column:
    """The n points of a line from -extent/2 to extent/2."""
    return -extent / 2.0 + index * (extent / (n - 1)) if n > 1 else F.lit(-extent / 2.0)


def grid(spark: SparkSession, height: int, width: int, gsd: float) -> DataFrame:
    """``i, j, x, y`` of a centred grid, i down the rows."""
    i, j = F.floor(F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")
    return spark.range(height * width).select(i.alias("i"), j.alias("j"), centred(j, width, width * gsd).alias("x"), centred(i, height, height * gsd).alias("y"))


def wave_field(points: DataFrame, sinusoids: DataFrame, low: float, high: float) -> DataFrame:
    """Adds ``z``: the sum of the sinusoids, stretched from its least and greatest value to [low, high].

    The sinusoids (some dozens, a parameter) travel as one array to every point; no row is multiplied."""
    bundle = sinusoids.agg(F.sort_array(F.collect_list(F.struct("wave", "amplitude", "kx", "ky", "phase"))).alias("__w"))
    term = lambda s, w: s + w["amplitude"] * F.sin(w["kx"] * F.col("x") + w["ky"] * F.col("y") + w["phase"])
    raw = points.crossJoin(F.broadcast(bundle)).withColumn("__z", F.aggregate("__w", F.lit(0.0), term)).drop("__w")
    ends = raw.agg(F.min("__z").alias("__lo"), F.max("__z").alias("__hi"))
    share = (F.col("__z") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    return raw.crossJoin(F.broadcast(ends)).withColumn("z", low + (high - low) * F.coalesce(share, F.lit(0.0))).drop("__z", "__lo", "__hi")


def curved(x: Column, y: Column, z: Column, radius: float = 6_371_000.0) -> Column:
    """Height lowered by the sphere's curvature away from the origin."""
    return z - (radius - F.sqrt(radius * radius - (x * x + y * y)))


def vertex_id(i: Column, j: Column, width: int) -> Column:
    return i * width + j


def faces(spark: SparkSession, height: int, width: int) -> DataFrame:
    """``face, a, b, c``: two triangles for each cell of the grid."""
    cells = (height - 1) * (width - 1)
    i, j = F.floor(F.col("id") / (width - 1)), F.col("id") % (width - 1)
    p, q, r, s = (vertex_id(i + di, j + dj, width) for di, dj in ((0, 0), (0, 1), (1, 0), (1, 1)))
    tri = lambda k, a, b, c: F.struct((F.col("id") * 2 + k).alias("face"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"))
    return spark.range(cells).select(F.explode(F.array(tri(0, p, r, q), tri(1, q, r, s))).alias("t")).select("t.*")


def faces_of(vertices: DataFrame, width: int) -> DataFrame:
    """``face, a, b, c``: two triangles for each cell that begins at a vertex ``id, i, j`` of a grid with rows of ``width``.

    Ids rise by one along a row and by ``width`` from row to row; whether the other corners are there isn't asked."""
    at = lambda k: F.col("id") + k
    tri = lambda n, a, b, c: F.struct((F.col("id") * 2 + n).alias("face"), at(a).alias("a"), at(b).alias("b"), at(c).alias("c"))
    return vertices.where(F.col("j") < width - 1).select(F.explode(F.array(tri(0, 0, width, 1), tri(1, 1, width, width + 1))).alias("t")).select("t.*")


def texture(i: Column, j: Column, height: int, width: int) -> Column:
    """``STRUCT<u, v>`` in [0, 1], v upwards."""
    return F.struct((j / float(max(1, width - 1))).alias("u"), (1.0 - i / float(max(1, height - 1))).alias("v"))


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """``id, nx, ny, nz``: the normalised sum of the normals of a vertex's faces. ``vertices`` has ``id, x, y, z``."""
    corner = lambda k: vertices.select(F.col("id").alias(k), F.struct("x", "y", "z").alias(f"p{k}"))
    full = triangles.join(corner("a"), "a").join(corner("b"), "b").join(corner("c"), "c")
    d = lambda p, q, k: F.col(f"{q}.{k}") - F.col(f"{p}.{k}")
    cross = lambda k, m: d("pa", "pb", k) * d("pa", "pc", m) - d("pa", "pb", m) * d("pa", "pc", k)
    each = full.select(F.explode(F.array("a", "b", "c")).alias("id"), cross("y", "z").alias("nx"), cross("z", "x").alias("ny"), cross("x", "y").alias("nz"))
    sums = each.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("nx", "ny", "nz")))
    n = F.nullif(F.sqrt(F.pow("nx", 2.0) + F.pow("ny", 2.0) + F.pow("nz", 2.0)), F.lit(0.0))
    return sums.select("id", *((F.col(c) / n).alias(c) for c in ("nx", "ny", "nz")))


def bounds(vertices: DataFrame) -> DataFrame:
    """Least, greatest and mean of each coordinate."""
    return vertices.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def resample(raster: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Bilinear resampling of ``i, j, z`` to another size; a missing height counts as 0.

    Each new cell lists its four source cells, which are found by an equi-join."""
    spark = raster.sparkSession
    i, j = F.floor(F.col("id") / new_width).cast("int"), (F.col("id") % new_width).cast("int")
    sy = F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), (i + 0.5) * (height / new_height) - 0.5))
    sx = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), (j + 0.5) * (width / new_width) - 0.5))
    y0, x0 = F.floor(sy).cast("int"), F.floor(sx).cast("int")
    fy, fx = sy - y0, sx - x0
    part = lambda dy, dx, w: F.struct(F.least(y0 + dy, F.lit(height - 1)).alias("i"), F.least(x0 + dx, F.lit(width - 1)).alias("j"), w.alias("w"))
    wanted = spark.range(new_height * new_width).select(
        i.alias("ni"), j.alias("nj"), F.explode(F.array(part(0, 0, (1 - fy) * (1 - fx)), part(0, 1, (1 - fy) * fx), part(1, 0, fy * (1 - fx)), part(1, 1, fy * fx))).alias("p")
    )
    source = raster.select("i", "j", F.coalesce(F.nanvl("z", F.lit(0.0)), F.lit(0.0)).alias("z"))
    hit = wanted.select("ni", "nj", "p.i", "p.j", "p.w").join(source, ["i", "j"], "left")
    return hit.groupBy(F.col("ni").alias("i"), F.col("nj").alias("j")).agg(F.sum(F.col("w") * F.coalesce("z", F.lit(0.0))).alias("z"))
