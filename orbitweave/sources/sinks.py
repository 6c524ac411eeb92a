"""Sinks: observation logs, nested annotation documents, spectra, meshes, rasters, copy manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.functions import textual
from orbitweave.sources import documents

LOG_FORMATS = {"target_lat": "%.4f", "target_lon": "%.4f", "target_alt": "%.1f", "x": "%.3f", "y": "%.3f", "z": "%.3f", "vx": "%.6f", "vy": "%.6f", "vz": "%.6f", "offnadir_angle_deg": "%.4f", "yaw": "%.2f", "pitch": "%.2f", "roll": "%.2f"}


def log_rows(observations: DataFrame) -> DataFrame:
    """Log columns as text with fixed digits and ISO times."""
    put = lambda c: F.format_string(LOG_FORMATS[c], F.col(c)).alias(c) if c in LOG_FORMATS else textual.iso(F.col(c)).alias(c) if c == "date" else F.col(c).cast("string").alias(c)
    return observations.select(*(put(c) for c in observations.columns))


def write_log(observations: DataFrame, path: str) -> None:
    log_rows(observations).write.mode("overwrite").option("header", True).csv(path)


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, licenses: DataFrame | None = None, partitions: int | None = None) -> None:
    """One document of any size, over part files in the order of their names; rows are ordered by ``id``.

    A column ``extra`` (``MAP<STRING, VARIANT>``) holds keys that stand beside the columns."""
    tables = {"images": images, "annotations": annotations, "categories": categories} | ({"licenses": licenses} if licenses is not None else {})
    documents.write_document(tables, "id", path, partitions or int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def copy_manifest(files: DataFrame, target: str, action: str = "copy") -> DataFrame:
    """``src, dst, action``; a destination that two sources share has action ``collision``."""
    dst = F.concat(F.lit(target.rstrip("/") + "/"), textual.basename(F.col("path")))
    rows = files.select(F.col("path").alias("src"), dst.alias("dst"))
    shared = rows.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst", F.lit(True).alias("__shared"))
    return rows.join(shared, "dst", "left").select("src", "dst", F.when(F.col("__shared"), "collision").otherwise(action).alias("action"))


def spectrum_lines(spectrum: DataFrame) -> DataFrame:
    return spectrum.select(F.format_string("%.2f %.6f", "wl_nm", "value").alias("value"))


def write_spectrum(spectrum: DataFrame, path: str) -> None:
    spectrum_lines(spectrum.orderBy("wl_nm")).coalesce(1).write.mode("overwrite").text(path)


def obj_lines(vertices: DataFrame, normals: DataFrame, triangles: DataFrame) -> DataFrame:
    """``part, nr, value``: vertex, texture, (negated) normal and 1-based face lines; ``vertices`` has ``id, x, y, z, u, v``."""
    v = vertices.select(F.lit(0).alias("part"), F.col("id").alias("nr"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("value"))
    t = vertices.select(F.lit(1).alias("part"), F.col("id").alias("nr"), F.format_string("vt %.6f %.6f", "u", "v").alias("value"))
    n = normals.select(F.lit(2).alias("part"), F.col("id").alias("nr"), F.format_string("vn %.6f %.6f %.6f", -F.col("nx"), -F.col("ny"), -F.col("nz")).alias("value"))
    corner = lambda c: F.concat_ws("/", *[(F.col(c) + 1).cast("string")] * 3)
    f = triangles.select(F.lit(3).alias("part"), F.col("face").alias("nr"), F.concat(F.lit("f "), F.concat_ws(" ", corner("a"), corner("b"), corner("c"))).alias("value"))
    return v.unionByName(t).unionByName(n).unionByName(f)


def write_obj(lines: DataFrame, path: str) -> None:
    """Part files in order: names sort as the lines do."""
    lines.repartitionByRange("part", "nr").sortWithinPartitions("part", "nr").select("value").write.mode("overwrite").text(path)


def write_land_cells(cells: DataFrame, path: str, band_rows: int = 100) -> None:
    """Land cells by bands of rows."""
    cells.withColumn("band", F.floor(F.col("row") / band_rows).cast("int")).write.mode("overwrite").partitionBy("band").parquet(path)


def write_heights(heights: DataFrame, path: str) -> None:
    heights.select("i", "j", F.col("z").cast("float").alias("z")).write.mode("overwrite").parquet(path)
