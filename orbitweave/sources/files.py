"""Sources: metadata CSV, COCO JSON, spectra, meshes, file listings, image headers, land cells, simulation logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitweave.functions import textual
from orbitweave.sources import documents

METADATA = T.StructType([T.StructField(c, T.StringType()) for c in ("BoxID/ImageChip", "NumWhale", "Certainty2", "SpatialRes", "Satellite")])
COCO = {
    "images": "id INT, license INT, file_name STRING, height INT, width INT, date_captured STRING",
    "annotations": "id INT, image_id INT, category_id INT, bbox ARRAY<DOUBLE>, area DOUBLE, segmentation ARRAY<ARRAY<DOUBLE>>, iscrowd INT",
    "categories": "id INT, name STRING, supercategory STRING",
    "licenses": "id INT, name STRING, url STRING",
}
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")


#: Column that says where a row stands: file, place of the split in it, row within the split.
ROW_ORDER = "__row_order"


def read_metadata(spark: SparkSession, path: str, schema: T.StructType = METADATA, row_order: bool = False) -> DataFrame:
    """Metadata rows as text; columns are found by the header, others are ignored.

    With ``row_order`` a column ``ROW_ORDER`` follows, by which the first and the last row of several files are known."""
    header = spark.read.option("header", True).csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias(ROW_ORDER)
    return header.select(*(F.col(f"`{f.name}`") if f.name in header.columns else F.lit(None).cast("string").alias(f.name) for f in schema), *([place] if row_order else []))


def _row_order(rows: DataFrame) -> Column:
    """Where a row stands; of a table without ``ROW_ORDER`` only the order within one file is sure."""
    return F.col(ROW_ORDER) if ROW_ORDER in rows.columns else F.monotonically_increasing_id()


def chip_lookup(metadata: DataFrame) -> DataFrame:
    """``file_name, count, certainty`` by chip; of repeated chips the last in the file counts."""
    row = _row_order(metadata)
    return metadata.select((F.concat("BoxID/ImageChip", F.lit(".PNG"))).alias("file_name"), "NumWhale", "Certainty2", row.alias("row")).groupBy("file_name").agg(
        F.max_by("NumWhale", "row").alias("count"), F.max_by("Certainty2", "row").alias("certainty")
    )


def read_coco(spark: SparkSession, path: str, one_document: bool = True) -> dict[str, DataFrame]:
    """``images``, ``annotations``, ``categories`` and ``licenses`` of COCO documents of any size, read in byte ranges.

    Keys that the schema doesn't know are in ``extra``; ``ordinal`` is a row's place in its document. ``document``
    is what a document has besides arrays, as VARIANT. The files of a folder are one document, or one each."""
    objects = documents.read_objects(spark, path, one_document)
    tables = {name: documents.parse_objects(objects, name, schema) for name, schema in COCO.items()}
    return tables | {"document": objects.where("section IS NULL").select(F.parse_json("json").alias("document"))}


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """``file, wl_nm, value``; comments (#), short lines and lines that are no numbers are skipped."""
    lines = spark.read.text(path).select(textual.basename(F.col("_metadata.file_path")).alias("file"), F.trim("value").alias("line"))
    return parse_spectrum(lines)


def parse_spectrum(lines: DataFrame) -> DataFrame:
    """The same of rows ``file, line``."""
    parts = F.split("line", r"\s+")
    numbers = lines.where(~F.col("line").startswith("#")).select("file", F.get(parts, 0).try_cast("double").alias("wl_nm"), F.get(parts, 1).try_cast("double").alias("value"))
    return numbers.where("wl_nm IS NOT NULL AND value IS NOT NULL")


def spectrum_range(spectrum: DataFrame, margin: float = 200.0) -> DataFrame:
    """``lo, hi`` of all wavelengths with a margin, not below 0; no wavelength at all is an error."""
    some = F.when(F.count("wl_nm") == 0, F.raise_error("no wavelength in the spectra").cast("double"))
    return spectrum.agg(F.coalesce(some, F.greatest(F.lit(0.0), F.min("wl_nm") - margin)).alias("lo"), (F.max("wl_nm") + margin).alias("hi"))


def read_obj_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, z`` of the vertex lines of a mesh."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.col("value").startswith("v ")).select(*(F.get(parts, k + 1).cast("double").alias(c) for k, c in enumerate("xyz")))


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, skip_prefix: str | None = "0_", recursive: bool = True) -> DataFrame:
    """``path, name, stem, size`` of the files below a folder by suffix; folders right below it that begin with ``skip_prefix`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", F.col("length").alias("size"))
    files = files.select("path", textual.basename(F.col("path")).alias("name"), textual.stem(F.col("path")).alias("stem"), "size").where(textual.extension(F.col("path")).isin(*suffixes))
    if skip_prefix:
        base = root.split("://")[-1].rstrip("/")
        files = files.where(~F.contains("path", F.lit(f"{base}/{skip_prefix}")))
    return files


def image_headers(spark: SparkSession, root: str) -> DataFrame:
    """``path, width, height`` of PNG files, from their first bytes (others have null sizes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            png = [bytes(b[:8]) == b"\x89PNG\r\n\x1a\n" for b in frame["head"]]
            at = lambda k: [int.from_bytes(bytes(b[k : k + 4]), "big") if ok else None for b, ok in zip(frame["head"], png, strict=True)]
            yield pd.DataFrame({"path": frame["path"], "width": pd.array(at(16), dtype="Int64"), "height": pd.array(at(20), dtype="Int64")})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.substring("content", 1, 24).alias("head")).mapInPandas(run, "path string, width long, height long")


def metadata_of(images: DataFrame, metadata: DataFrame, path: str = "path") -> DataFrame:
    """Images with ``space_res`` (metres) and ``satellite`` of their chip, by file stem; the first row of a chip counts.

    An image without metadata is an error when its row is taken."""
    keyed = metadata.select(F.trim("BoxID/ImageChip").alias("__chip"), "SpatialRes", "Satellite", _row_order(metadata).alias("__row"))
    first = keyed.groupBy("__chip").agg(F.min_by("SpatialRes", "__row").alias("__res"), F.min_by("Satellite", "__row").alias("__sat"), F.lit(True).alias("__known"))
    joined = images.join(first, textual.stem(F.col(path)) == F.col("__chip"), "left")
    missing = F.raise_error(F.concat(F.lit("no metadata for "), F.col(path)))
    space = F.when(F.col("__known"), textual.metres(F.col("__res"))).otherwise(missing.cast("double"))
    return joined.select(*images.columns, space.alias("space_res"), F.when(F.col("__known"), F.trim("__sat")).otherwise(missing.cast("string")).alias("satellite"))


def parse_polygons(rows: DataFrame, wkt: str, out: str = "ring") -> DataFrame:
    """Adds the outer ring of a WKT polygon as ``ARRAY<STRUCT<lat, lon>>``; null for other text."""
    inner = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\(([^()]*)\)", 1)
    point = lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), 1).try_cast("double").alias("lat"), F.get(F.split(F.trim(p), r"\s+"), 0).try_cast("double").alias("lon"))
    return rows.withColumn(out, F.when(inner != "", F.transform(F.split(inner, ","), point)))


def parse_rings(rows: DataFrame, wkt: str, out: str = "rings") -> DataFrame:
    """Adds all rings of a WKT polygon or multipolygon, holes too, as ``ARRAY<ARRAY<STRUCT<lat, lon>>>``; null for other text.

    By the even-odd rule holes need no mark; a ring's last point, which repeats its first, is dropped."""
    number = lambda p, k: F.get(F.split(F.trim(p), r"\s+"), k).try_cast("double")
    point = lambda p: F.struct(number(p, 1).alias("lat"), number(p, 0).alias("lon"))
    ring = lambda text: F.transform(F.split(text, ","), point)
    open_ = lambda r: F.when(F.get(r, F.lit(0)).eqNullSafe(F.element_at(r, -1)) & (F.size(r) > 1), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)
    texts = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    return rows.withColumn(out, F.when(F.rlike(wkt, F.lit(r"(?i)^\s*(MULTI)?POLYGON\s*\(")), F.transform(texts, lambda t: open_(ring(t)))))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a table with a ``wkt`` column (for layers exported from shape files), with their ``rings``."""
    return parse_rings(spark.read.parquet(path), "wkt")


def land_cells(spark: SparkSession, path: str) -> DataFrame:
    """``row, col`` of the land cells of a raster that was written with ``write_land_cells``."""
    return spark.read.parquet(path).select("row", "col")


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; built and written first if nothing has been written there to the end."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def read_cue_log(spark: SparkSession, path: str) -> DataFrame:
    """Observation log rows, by position: the header of old logs lacks the target's id."""
    numbers = ["target_lat", "target_lon", "target_alt", "x", "y", "z", "vx", "vy", "vz", "offnadir_angle_deg"]
    parts = F.transform(F.split("value", ","), lambda p: F.trim(p))
    rows = spark.read.text(path).where(F.regexp_like("value", F.lit(r"^\d{4}-")))
    at = lambda k: F.get(parts, k)
    return rows.select(
        at(0).cast("timestamp_ntz").alias("date"), at(1).alias("actor"), at(2).cast("int").alias("whale_id"),
        *(at(3 + k).cast("double").alias(c) for k, c in enumerate(numbers)),
        (F.lower(F.regexp_replace(at(13), r"[\[\] ]", "")).isin("true", "1")).alias("in_view"), (at(14) == "1").alias("in_footprint"),
        *(at(15 + k).cast("double").alias(c) for k, c in enumerate(("yaw", "pitch", "roll"))),
    )
