"""Queries that write files with the sinks and read them with the sources, and checks of single column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import geo, radiometry, shapes, textual
from orbitweave.functions import vectors as V
from orbitweave.plans.tables import LAND_SQL, TARGETS_SQL, land, table, targets
from orbitweave.sources import files, sinks
from orbitweave.sources.scratch import fresh_path


def _metadata_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as metadata rows in part order, written as CSV and read again: a chip for each brand, many rows a chip."""
    path = fresh_path(spark, "metadata")
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").select(
        F.col("p_brand").alias("BoxID/ImageChip"), F.col("p_size").cast("string").alias("NumWhale"), F.col("p_type").alias("Certainty2"),
        F.concat(F.col("p_partkey").cast("string"), F.lit("m")).alias("SpatialRes"), F.col("p_name").alias("Satellite"), F.lit("x").alias("Other"),
    )
    rows.write.option("header", True).csv(path)
    return files.read_metadata(spark, path, row_order=True)


def chip_lookup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each chip counts."""
    return files.chip_lookup(_metadata_file(spark, sf_dir))


LOOKUP_SQL = "SELECT p_brand || '.PNG' AS file_name, arg_max(CAST(p_size AS VARCHAR), p_partkey) AS count, arg_max(p_type, p_partkey) AS certainty FROM part GROUP BY p_brand"


def image_metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each chip tells an image's resolution and satellite."""
    images = table(spark, sf_dir, "part").select(F.concat(F.lit("/d/"), "p_brand", F.lit(".png")).alias("path")).distinct()
    return files.metadata_of(images, _metadata_file(spark, sf_dir))


IMAGE_METADATA_SQL = "SELECT '/d/' || p_brand || '.png' AS path, CAST(min(p_partkey) AS DOUBLE) AS space_res, trim(arg_min(p_name, p_partkey)) AS satellite FROM part GROUP BY p_brand"


def coco_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as images and suppliers as annotations of one document: written, read and joined again."""
    path = fresh_path(spark, "coco")
    images = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.lit(1).alias("license"), F.concat("n_name", F.lit(".png")).alias("file_name"), F.lit(64).alias("height"), F.lit(48).alias("width")
    )
    k = F.col("s_suppkey").cast("double")
    annotations = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("id"), F.col("s_nationkey").alias("image_id"), F.lit(0).alias("category_id"),
        F.array(k, k + 1, k + 2, F.lit(2.0)).alias("bbox"), (2 * (k + 2)).alias("area"), F.array(F.array(k, k, k + 1)).alias("segmentation"), F.lit(0).alias("iscrowd"),
    )
    categories = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("r").alias("supercategory"))
    sinks.write_coco(images, annotations, categories, path)
    back = files.read_coco(spark, path)
    named = back["annotations"].join(back["images"].select(F.col("id").alias("image_id"), "file_name"), "image_id").join(back["categories"].select(F.col("id").alias("category_id"), "name"), "category_id")
    return named.select("id", "file_name", "name", F.get("bbox", 2).alias("w"), "area", F.get(F.get("segmentation", 0), 2).alias("x2"))


COCO_SQL = """SELECT CAST(s_suppkey AS INTEGER) AS id, n_name || '.png' AS file_name, r_name AS name, s_suppkey + 2.0::DOUBLE AS w, 2 * (s_suppkey + 2.0::DOUBLE) AS area, s_suppkey + 1.0::DOUBLE AS x2
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = 0"""


def coco_lineitem_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images and line items as annotations of one document, with keys that the schema doesn't know."""
    path = fresh_path(spark, "coco-large")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file_name"), F.lit(64).alias("height"))
    ship = F.parse_json(F.to_json(F.struct(F.col("l_linestatus").alias("mode"), F.array("l_discount", "l_tax").alias("rates"), F.concat(F.lit('}{"\\'), "l_returnflag").alias("odd"))))
    items = table(spark, sf_dir, "lineitem").select(
        (k * 8 + n).cast("int").alias("id"), k.cast("int").alias("image_id"), F.lit(0).alias("category_id"), F.array("l_quantity", "l_extendedprice").cast("array<double>").alias("bbox"),
        F.col("l_extendedprice").cast("double").alias("area"), F.create_map(F.lit("ship"), ship).alias("extra"),
    )
    categories = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name"))
    licenses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    sinks.write_coco(orders, items, categories, path, licenses)
    back = files.read_coco(spark, path)
    got = lambda field, kind: F.variant_get(F.col("extra")["ship"], field, kind)
    named = back["annotations"].join(back["images"].select(F.col("id").alias("image_id"), "file_name", F.col("ordinal").alias("image_nr")), "image_id").join(F.broadcast(back["licenses"].select(F.col("id").alias("category_id"), F.col("name").alias("license"))), "category_id")
    return named.select("id", "file_name", "license", "bbox", "area", got("$.mode", "string").alias("mode"), got("$.rates[1]", "double").alias("tax"), got("$.odd", "string").alias("odd"))


COCO_LINEITEM_SQL = """SELECT CAST(l_orderkey * 8 + l_linenumber AS INTEGER) AS id, l_orderkey || '.png' AS file_name, n_name AS license, [CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE)] AS bbox,
 CAST(l_extendedprice AS DOUBLE) AS area, l_linestatus AS mode, CAST(l_tax AS DOUBLE) AS tax, '}{"\\' || l_returnflag AS odd FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = 0"""


def spectrum_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes by frequency as a spectrum."""
    path = fresh_path(spark, "spectrum")
    counted = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    sinks.write_spectrum(counted.select((F.col("p_size") + 300.0).alias("wl_nm"), (F.col("n") / 100.0).alias("value")), path)
    return files.read_spectrum(spark, path).select("wl_nm", "value")


SPECTRUM_SQL = "SELECT p_size + 300.0::DOUBLE AS wl_nm, count(*) / 100.0::DOUBLE AS value FROM part GROUP BY p_size"


def mesh_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as vertices of a mesh; what the reader finds are the vertices alone, in no order."""
    path = fresh_path(spark, "mesh")
    k = F.col("c_custkey")
    vertices = table(spark, sf_dir, "customer").select(k.alias("id"), k.cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"), (k / 8).alias("z"), F.lit(0.5).alias("u"), F.lit(0.25).alias("v"))
    normals = vertices.select("id", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    faces = table(spark, sf_dir, "customer").where("c_custkey > 2").select(k.alias("face"), (k - 3).alias("a"), (k - 2).alias("b"), (k - 1).alias("c"))
    sinks.write_obj(sinks.obj_lines(vertices, normals, faces), path)
    return files.read_obj_vertices(spark, path)


MESH_SQL = "SELECT CAST(c_custkey AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y, c_custkey / 8.0::DOUBLE AS z FROM customer"


def land_mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cells written by bands of rows and read again, counted by row."""
    path = fresh_path(spark, "land")
    sinks.write_land_cells(land(spark), path)
    return files.land_cells(spark, path).groupBy("row").agg(F.count("*").alias("n"), F.min("col").alias("west"), F.max("col").alias("east"))


LAND_FILES_SQL = f'WITH {LAND_SQL} SELECT r AS "row", count(*) AS n, min(c) AS west, max(c) AS east FROM land GROUP BY r'


def height_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a height field in single precision, built where it is not there yet."""
    path = fresh_path(spark, "heights")
    cells = lambda: table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("i"), F.floor(F.col("o_orderkey") / 1000).alias("j"), (F.col("o_totalprice") / 7.0).alias("z"))
    sinks.write_heights(cells(), path)
    kept = files.cached_table(spark, path, cells)
    return kept.select("i", "j", F.col("z").cast("double").alias("z"))


HEIGHT_SQL = "SELECT o_orderkey % 1000 AS i, CAST(o_orderkey // 1000 AS BIGINT) AS j, CAST(CAST(o_totalprice / 7.0::DOUBLE AS FLOAT) AS DOUBLE) AS z FROM orders"


def built_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is built since it isn't there, and read the second time."""
    path = fresh_path(spark, "built")
    files.cached_table(spark, path, lambda: table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")))
    return files.cached_table(spark, path, lambda: table(spark, sf_dir, "nation").select(F.raise_error("built twice")))


BUILT_SQL = "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"


def cue_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an observation log: written with fixed digits and read by position."""
    path = fresh_path(spark, "log")
    ev = table(spark, sf_dir, "events").where("value IS NOT NULL")
    k = F.col("event_id") % 1000
    rows = ev.select(
        F.col("ts").alias("date"), F.col("event_type").alias("actor"), F.col("user_id").alias("whale_id"), (k / 8 - 60).alias("target_lat"), (k / 16).alias("target_lon"), F.lit(0.0).alias("target_alt"),
        *((k / 8 + j).alias(c) for j, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))), (k / 32).alias("offnadir_angle_deg"), (F.col("value") > 50).alias("in_view"), F.lit(1).alias("in_footprint"),
        (k / 4).alias("yaw"), (-k / 4).alias("pitch"), (k / 2).alias("roll"),
    )
    sinks.write_log(rows, path)
    back = files.read_cue_log(spark, path)
    return back.select("date", "actor", "whale_id", "target_lat", "vz", "in_view", "in_footprint", "pitch", "roll")


LOG_SQL = """SELECT ts AS date, event_type AS actor, CAST(user_id AS INTEGER) AS whale_id, (event_id % 1000) / 8.0::DOUBLE - 60 AS target_lat, (event_id % 1000) / 8.0::DOUBLE + 5 AS vz,
 value > 50 AS in_view, true AS in_footprint, -(event_id % 1000) / 4.0::DOUBLE AS pitch, (event_id % 1000) / 2.0::DOUBLE AS roll FROM events WHERE value IS NOT NULL"""


def copy_manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files by type and brand: names that two folders share collide."""
    listed = table(spark, sf_dir, "part").select(F.concat(F.lit("/src/"), F.col("p_size").cast("string"), F.lit("/"), "p_brand", F.lit("-"), F.col("p_partkey").cast("string").substr(1, 2), F.lit(".png")).alias("path"))
    return sinks.copy_manifest(listed, "/dst/")


MANIFEST_SQL = """WITH p AS (SELECT '/src/' || p_size || '/' || p_brand || '-' || substr(CAST(p_partkey AS VARCHAR), 1, 2) || '.png' AS src, '/dst/' || p_brand || '-' || substr(CAST(p_partkey AS VARCHAR), 1, 2) || '.png' AS dst FROM part)
SELECT src, dst, CASE WHEN count(*) OVER (PARTITION BY dst) > 1 THEN 'collision' ELSE 'copy' END AS action FROM p"""


def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a folder for each region, without the folders of a prefix: which folders are listed, and whether names are whole."""
    path = fresh_path(spark, "listing")
    table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("region")).repartition("region").write.partitionBy("region").text(path)
    listed = files.list_files(spark, path, (".txt",), "region=0")
    return listed.groupBy(F.regexp_extract("path", r"region=(\d+)/", 1).alias("region")).agg(F.count("*").alias("files"), F.bool_and(F.col("name") == F.concat("stem", F.lit(".txt"))).alias("named"))


LISTING_SQL = "SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS region, CAST(1 AS BIGINT) AS files, true AS named FROM nation WHERE n_regionkey <> 0"


def value_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital numbers to linear values and back, display values, byte and latitude limits, screen factors."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    return p.select(
        key, F.round(radiometry.dn2047_to_linear(size * 45.0), 9).alias("linear"), F.round(radiometry.display_value(size / 40.0), 9).alias("shown"),
        radiometry.clip_byte(size * 9.7 - 60).alias("byte"), geo.clamp_lat(size * 5.0 - 120).alias("lat"), shapes.display_scale(size * 20, size * 30).alias("factor"),
        F.round(geo.wrap_lon(size * 20.0 - 500), 9).alias("lon"),
    )


CURVES_SQL = f"""SELECT p_partkey, round(least(1.0::DOUBLE, pow(p_size * 45.0::DOUBLE / 2047, {radiometry.GAMMA}::DOUBLE)), 9) AS linear, round(pow(least(1.0::DOUBLE, p_size / 40.0::DOUBLE), 1 / {radiometry.GAMMA}::DOUBLE), 9) AS shown,
 CAST(greatest(0, least(255, trunc(p_size * 9.7::DOUBLE - 60))) AS INTEGER) AS byte, greatest(-90.0::DOUBLE, least(90.0::DOUBLE, p_size * 5.0::DOUBLE - 120)) AS lat, CAST(greatest(1, floor(768.0::DOUBLE / (p_size * 30))) AS INTEGER) AS factor,
 round((p_size * 20.0::DOUBLE - 320) - 360 * floor((p_size * 20.0::DOUBLE - 320) / 360) - 180, 9) AS lon FROM part"""


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text and as hours of the day."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", textual.iso(F.col("ts")).alias("iso"), F.round(textual.decimal_hour(F.col("ts")), 9).alias("hours"))


TIME_SQL = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END AS iso,
 round(hour(ts) + minute(ts) / 60.0::DOUBLE, 9) AS hours FROM events"""


def turned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions turned about the pole by the heading, and taken onto another direction by the least rotation."""
    t = targets(spark, sf_dir).withColumn("a", geo.up(F.col("lat"), F.col("lon"))).withColumn("b", geo.up(F.col("lat") / 2, F.col("lon") + 40.0))
    t = t.withColumn("r", V.rotate_about(F.col("a"), V.vec(0, 0, 1), F.radians("heading"))).withColumn("q", V.align(F.col("a"), F.col("a"), F.col("b"))).withColumn("n", V.plane_normal(V.vec(0, 0, 1), F.col("a")))
    return t.select("whale_id", *(F.round(f"{v}.{c}", 6).alias(v + c) for v in "rqn" for c in "xyz" if v + c != "nz"))


_TURNED = {"rx": "cos(radians(lat)) * cos(radians(lon + heading))", "ry": "cos(radians(lat)) * sin(radians(lon + heading))", "rz": "sin(radians(lat))", "qx": "cos(radians(lat / 2)) * cos(radians(lon + 40))", "qy": "cos(radians(lat / 2)) * sin(radians(lon + 40))", "qz": "sin(radians(lat / 2))", "nx": "-sin(radians(lon))", "ny": "cos(radians(lon))"}
TURNED_SQL = f"WITH {TARGETS_SQL} SELECT whale_id, {', '.join(f'round({e}, 6) AS {c}' for c, e in _TURNED.items())} FROM targets"


QUERIES = {
    "chip_lookup_files": (chip_lookup_files, LOOKUP_SQL),
    "image_metadata_files": (image_metadata_files, IMAGE_METADATA_SQL),
    "coco_files": (coco_files, COCO_SQL),
    "coco_lineitem_files": (coco_lineitem_files, COCO_LINEITEM_SQL),
    "spectrum_files": (spectrum_files, SPECTRUM_SQL),
    "mesh_files": (mesh_files, MESH_SQL),
    "land_mask_files": (land_mask_files, LAND_FILES_SQL),
    "height_files": (height_files, HEIGHT_SQL),
    "built_table": (built_table, BUILT_SQL),
    "cue_log_files": (cue_log_files, LOG_SQL),
    "copy_manifest_rows": (copy_manifest_rows, MANIFEST_SQL),
    "folder_listing": (folder_listing, LISTING_SQL),
    "value_curves": (value_curves, CURVES_SQL),
    "time_texts": (time_texts, TIME_SQL),
    "turned_vectors": (turned_vectors, TURNED_SQL),
}
