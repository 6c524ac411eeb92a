"""Queries of datasets and images: orders are images, line items annotations, parts metadata, documents files, embeddings 8 x 8 images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.functions import radiometry as R
from orbitweave.functions import shapes, textual
from orbitweave.functions.noise import lcg
from orbitweave.operators import coco, imaging, matching, ordinal, terrain
from orbitweave.plans.tables import lcg_sql, table
from orbitweave.sources import files

r6 = lambda c, name: F.round(c, 6).alias(name)


# Files and names.
def chip_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text."""
    return matching.name_contains(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "text", "text").select("doc_id")


def chip_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.name_contains(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "text", "text", found=False).select("doc_id")


_CHIP = "SELECT doc_id FROM documents d WHERE {} EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))"


def prefix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with underscores as file stems; the first word of a name is a base."""
    stems = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("stem"))
    bases = stems.select(F.element_at(F.split("stem", "_"), 1).alias("base")).distinct()
    return matching.prefix_candidates(stems, bases, "stem", "base").select("p_partkey", "base")


PREFIX_SQL = """WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') AS stem FROM part), b AS (SELECT DISTINCT split_part(stem, '_', 1) AS base FROM s)
SELECT p_partkey, base FROM s JOIN b ON stem = base OR starts_with(stem, base || '_')"""


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    path = F.regexp_replace(u, r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", textual.basename(path).alias("name"), textual.stem(path).alias("stem"), textual.extension(path).alias("suffix"))


NAME_SQL = r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages), n AS (SELECT page_id, list_extract(string_split(path, '/'), -1) AS name FROM p)
SELECT page_id, name, CASE WHEN strpos(substr(name, 2), '.') > 0 THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS stem,
CASE WHEN strpos(substr(name, 2), '.') > 0 THEN lower(regexp_extract(name, '(\.[^.]*)$', 1)) ELSE '' END AS suffix FROM n"""


def space_res_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes written as metres; one in eleven is no number."""
    text = F.when(F.col("p_partkey") % 11 == 0, F.lit("n/a")).otherwise(F.concat((F.col("p_size") / 100.0).cast("string"), F.lit("m ")))
    return table(spark, sf_dir, "part").select("p_partkey", r6(textual.metres(text), "metres"))


SPACE_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE round(p_size / 100.0::DOUBLE, 6) END AS metres FROM part"


# Joins of images and annotations.
def image_annotations_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select("o_orderkey")
    anns = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_quantity")
    full = coco.with_annotations(images, anns, "o_orderkey", ["l_partkey", "l_quantity"], [F.col("l_linenumber"), F.col("l_partkey")])
    listed = F.array_join(F.transform("annotations", lambda a: a["l_partkey"].cast("string")), ",")
    return full.select("o_orderkey", F.size("annotations").cast("long").alias("n"), listed.alias("parts"))


OUTER_SQL = """SELECT o_orderkey, count(l_partkey) AS n, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""


def first_metadata_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with its first line item by order and line."""
    parts, items = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return matching.first_match(parts, items, "p_partkey", [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity")], ["l_orderkey", "l_linenumber", "l_quantity"])


FIRST_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS k FROM lineitem)
SELECT p_partkey, l_orderkey, l_linenumber, l_quantity FROM part LEFT JOIN r ON p_partkey = l_partkey AND k = 1"""


def _file_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("file")), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("file"))


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.missing_and_extra(*_file_sets(spark, sf_dir), "file")[0]


def extra_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.missing_and_extra(*_file_sets(spark, sf_dir), "file")[1]


def file_check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coco.check_files(*_file_sets(spark, sf_dir), "file")


_SETS = "e AS (SELECT o_orderkey, o_custkey AS file FROM orders), p AS (SELECT c_custkey AS file FROM customer WHERE c_acctbal > 0)"
MISSING_SQL = f"WITH {_SETS} SELECT file, o_orderkey FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.file = e.file)"
EXTRA_SQL = f"WITH {_SETS} SELECT DISTINCT file FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE p.file = e.file)"
CHECK_SQL = f"""WITH {_SETS} SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(DISTINCT file) FROM p) AS present,
(SELECT count(*) FROM e WHERE file NOT IN (SELECT file FROM p)) AS missing, (SELECT count(DISTINCT file) FROM p WHERE file NOT IN (SELECT file FROM e)) AS extra"""


def category_default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("category_id"))
    known = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("category_id"), F.col("r_name").alias("name"))
    return coco.categories_used(used, known)


CATEGORY_SQL = "SELECT n_regionkey AS category_id, coalesce(r_name, 'Unknown') AS name, count(*) AS n FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey GROUP BY ALL"


def size_mode_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes: width is the size, height its remainder by 7 and 1."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").alias("w"), (F.col("p_size") % 7 + 1).alias("h"))
    rep = coco.size_report(p, "w", "h", "p_name", "p_partkey")
    return rep.select("most_common.w", "most_common.h", "most_common_n", F.col("smallest.p_name").alias("smallest"), F.col("largest.p_name").alias("largest"))


SIZE_SQL = """WITH p AS (SELECT p_partkey, p_name, p_size AS w, p_size % 7 + 1 AS h FROM part), c AS (SELECT w, h, count(*) AS n, min(p_partkey) AS f FROM p GROUP BY w, h ORDER BY n DESC, f LIMIT 1)
SELECT c.w, c.h, n AS most_common_n, (SELECT p_name FROM p ORDER BY w * h, p_partkey LIMIT 1) AS smallest, (SELECT p_name FROM p ORDER BY w * h DESC, p_partkey LIMIT 1) AS largest FROM c"""


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("categories"), F.bool_or(F.col("l_suppkey") == 0).alias("has_zero"), F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("lines")
    )


SUMMARY_SQL = "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS categories, bool_or(l_suppkey = 0) AS has_zero, (SELECT string_agg(CAST(l AS VARCHAR), ',' ORDER BY l) FROM (SELECT DISTINCT l_linenumber AS l FROM lineitem)) AS lines FROM lineitem"


# Splits and ids.
def _order_key():
    return F.pmod(F.col("o_orderkey") * 1103515245 + 12345, F.lit(2147483648))


def split_70_20_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.positional_split(table(spark, sf_dir, "orders").select("o_orderkey"), _order_key(), [F.col("o_orderkey")])


_SPLIT = """r AS (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 1103515245 + 12345) % 2147483648, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders),
s AS (SELECT o_orderkey, CASE WHEN k < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train' WHEN k < CAST(floor(n * (0.7::DOUBLE + 0.2::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM r)"""
SPLIT_SQL = f"WITH {_SPLIT} SELECT o_orderkey, split FROM s"


def split_with_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = split_70_20_10(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    per = placed.join(items, "o_orderkey", "left")
    return per.groupBy("split").agg(F.countDistinct("o_orderkey").alias("images"), F.count("l_quantity").alias("annotations"))


SPLIT_ANN_SQL = f"WITH {_SPLIT} SELECT split, count(DISTINCT o_orderkey) AS images, count(l_quantity) AS annotations FROM s LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY split"


def renumber_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select("o_orderkey")
    anns = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    _, numbered = coco.renumber(images, anns, "o_orderkey", [F.col("o_orderkey")], order)
    return numbered.select("new_image_id", "new_id", "l_partkey", "l_linenumber")


RENUMBER_SQL = """WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS new_image_id FROM orders)
SELECT new_image_id, row_number() OVER (ORDER BY new_image_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS new_id, l_partkey, l_linenumber FROM lineitem JOIN i ON l_orderkey = o_orderkey"""


def remap_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    anns = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("category_id"))
    return coco.one_category(anns).groupBy("category_id").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("images"))


REMAP_SQL = "SELECT 0 AS category_id, count(*) AS n, count(DISTINCT l_orderkey) AS images FROM lineitem"


def merged_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three splits with different columns in one table."""
    o = table(spark, sf_dir, "orders")
    parts = [o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus"), o.where("o_orderkey % 3 = 1").select("o_orderkey"), o.where("o_orderkey % 3 = 2").select("o_orderkey", "o_orderpriority")]
    return coco.merge(parts).select("o_orderkey", "o_orderstatus", "o_orderpriority")


MERGE_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS o_orderpriority FROM orders"


def coco_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties parsed, nested, written as JSON and parsed again."""
    ev = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT").alias("p"), "value")
    text = coco.as_json(ev.select("event_id", F.struct(F.col("p.k").alias("k"), F.col("value").alias("v")).alias("a")), ["event_id"])
    back = text.select("event_id", F.from_json("json", "a STRUCT<k: INT, v: DOUBLE>").alias("j"))
    return back.select("event_id", F.col("j.a.k").alias("k"), r6(F.col("j.a.v"), "v"))


JSON_SQL = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, round(value, 6) AS v FROM events"


# Boxes.
def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes ``x, y, w, h`` and angles; keyed by order, line and part."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), (F.col("l_partkey") % 97).cast("double").alias("y"), (F.col("l_suppkey") % 13 + 1).cast("double").alias("w"), (F.col("l_linenumber") * 3).cast("double").alias("h"), ((F.col("l_partkey") % 4) * 90).alias("angle"))


_BOX = "b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, CAST(l_partkey % 97 AS DOUBLE) AS y, CAST(l_suppkey % 13 + 1 AS DOUBLE) AS w, CAST(l_linenumber * 3 AS DOUBLE) AS h, radians(CAST((l_partkey % 4) * 90 AS DOUBLE)) AS a FROM lineitem)"
_PX = lambda x, y: f"(({x} - 62) * cos(a) - ({y} - 62) * sin(a) + 62)"
_PY = lambda x, y: f"(({x} - 62) * sin(a) + ({y} - 62) * cos(a) + 62)"
_C = [("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x", "y + h")]
_XS, _YS = ", ".join(_PX(*c) for c in _C), ", ".join(_PY(*c) for c in _C)
KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def bbox_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.lit(62.0)
    box = shapes.rotate_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), c, c, F.col("angle"))
    return _boxes(spark, sf_dir).withColumn("r", box).select(*KEYS, *(F.round(F.col(f"r.{k}") + 1000, 4).alias(k) for k in "xywh"))


BBOX_SQL = f"WITH {_BOX} SELECT {', '.join(KEYS)}, round(least({_XS}) + 1000, 4) AS x, round(least({_YS}) + 1000, 4) AS y, round(greatest({_XS}) - least({_XS}) + 1000, 4) AS w, round(greatest({_YS}) - least({_YS}) + 1000, 4) AS h FROM b"


def segmentation_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.lit(62.0)
    ring = F.array(F.array("x", "y", F.col("x") + F.col("w"), "y", F.col("x"), F.col("y") + F.col("h")))
    turned = _boxes(spark, sf_dir).withColumn("s", F.get(shapes.rotate_rings(ring, c, c, F.col("angle")), 0))
    return turned.select(*KEYS, *(F.round(F.get("s", k) + 1000, 4).alias(f"c{k}") for k in range(6)))


_P3 = [("x", "y"), ("x + w", "y"), ("x", "y + h")]
SEG_SQL = f"WITH {_BOX} SELECT {', '.join(KEYS)}, " + ", ".join(f"round({f(*p)} + 1000, 4) AS c{2 * k + d}" for k, p in enumerate(_P3) for d, f in enumerate((_PX, _PY))) + " FROM b"


def polygon_to_coco(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles (two points, which don't count, where the line number is 1) as annotations."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    points = F.when(F.col("l_linenumber") == 1, F.array(p(x, y), p(x + w, y))).otherwise(F.array(p(x, y), p(x + w, y + h), p(x, y + h)))
    made = _boxes(spark, sf_dir).withColumn("a", coco.polygon_annotation(points)).where("a IS NOT NULL")
    flat = F.array_join(F.transform(F.get("a.segmentation", 0), lambda v: v.cast("int").cast("string")), " ")
    return made.select(*KEYS, *(F.get("a.bbox", k).alias(c) for k, c in enumerate("xywh")), F.col("a.area").alias("area"), flat.alias("ring"))


POLYGON_SQL = f"WITH {_BOX} SELECT {', '.join(KEYS)}, x, y, w, h, w * h AS area, concat_ws(' ', CAST(x AS INTEGER), CAST(y AS INTEGER), CAST(x + w AS INTEGER), CAST(y + h AS INTEGER), CAST(x AS INTEGER), CAST(y + h AS INTEGER)) AS ring FROM b WHERE l_linenumber <> 1"


# Images.
def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images of grey values 0 to 255."""
    grey = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("int") % 256)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", grey.alias("grey"))


_PIX = "px AS (SELECT vec_id, CAST(k AS INTEGER) // 8 AS y, CAST(k AS INTEGER) % 8 AS x, CAST(floor(abs(CAST(embedding[CAST(k + 1 AS BIGINT)] AS DOUBLE)) * 1000) AS INTEGER) % 256 AS v FROM embeddings, (SELECT range AS k FROM range(64)))"


def best_match_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 20, the most similar of its label."""
    e = table(spark, sf_dir, "embeddings")
    return matching.best_match(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "label").select("query", "match", r6(F.col("score"), "score"))


MATCH_SQL = """WITH p AS (SELECT q.vec_id AS query, c.vec_id AS match, (SELECT sum(CAST(q.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE)) / sqrt(sum(CAST(q.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)) * sum(CAST(c.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE))) FROM (SELECT unnest(range(1, 65)) AS i)) AS s
FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, match) AS k FROM p) SELECT query, match, round(s, 6) AS score FROM r WHERE k = 1"""


def best_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image against itself turned by its id's quarter turns: the angle that undoes it."""
    img = _images(spark, sf_dir)
    turned = F.when(F.col("vec_id") % 4 == 0, F.col("grey"))
    for k in (1, 2, 3):
        turned = turned.when(F.col("vec_id") % 4 == k, imaging.rotated(F.col("grey"), 8, k))
    return imaging.best_rotation(img.withColumn("turned", turned), ["vec_id"], "grey", "turned", 8, 255.0).select("vec_id", "angle", r6(F.col("score"), "score"))


ROTATION_SQL = "SELECT vec_id, CAST((4 - vec_id % 4) % 4 * 90 AS INTEGER) AS angle, round(1.0::DOUBLE, 6) AS score FROM embeddings"


def crop_black_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with their border set to 0, cropped: size and sum."""
    pix = imaging.pixels(_images(spark, sf_dir), "vec_id", "grey", 8)
    edge = F.col("x").isin(0, 7) | F.col("y").isin(0, 7) | (F.col("vec_id") % 10 == 0)
    pix = pix.withColumn("v", F.when(edge, 0).otherwise(F.col("v")))
    out = imaging.crop_border(pix, "vec_id", F.col("v").cast("double"), 10.0)
    return out.groupBy("vec_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sum("v").alias("total"))


CROP_SQL = f"""WITH {_PIX}, e AS (SELECT vec_id, y, x, CASE WHEN x IN (0, 7) OR y IN (0, 7) OR vec_id % 10 = 0 THEN 0 ELSE v END AS v FROM px),
b AS (SELECT vec_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM e WHERE v > 10 GROUP BY vec_id)
SELECT e.vec_id, CAST(max(y) - coalesce(min(y0), 0) + 1 AS INTEGER) AS height, CAST(max(x) - coalesce(min(x0), 0) + 1 AS INTEGER) AS width, CAST(sum(v) AS BIGINT) AS total
FROM e LEFT JOIN b ON e.vec_id = b.vec_id WHERE y0 IS NULL OR (y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1) GROUP BY e.vec_id"""


def pixel_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image against its mirror image; mean absolute difference too."""
    pix = imaging.pixels(_images(spark, sf_dir), "vec_id", "grey", 8)
    mirror = pix.select("vec_id", "y", (7 - F.col("x")).alias("x"), F.col("v").alias("m"))
    both = pix.join(mirror, ["vec_id", "y", "x"])
    return both.groupBy("vec_id").agg(r6(imaging.rmse(F.col("v"), F.col("m")), "rmse"), r6(F.avg(imaging.absolute_difference(F.col("v"), F.col("m"))), "mad"))


RMSE_SQL = f"WITH {_PIX} SELECT a.vec_id, round(sqrt(avg(CAST((a.v - b.v) * (a.v - b.v) AS DOUBLE))), 6) AS rmse, round(avg(abs(a.v - b.v)), 6) AS mad FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = 7 - b.x GROUP BY a.vec_id"


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.pixels(_images(spark, sf_dir), "vec_id", "grey", 8).join(F.broadcast(R.band_table(spark, "WV3")))


_BANDS = "bands AS (SELECT * FROM (VALUES ('red', 0.945::DOUBLE, -1.350::DOUBLE, 0.0585::DOUBLE), ('green', 0.907::DOUBLE, -3.287::DOUBLE, 0.0618::DOUBLE), ('blue', 0.905::DOUBLE, -4.189::DOUBLE, 0.0540::DOUBLE)) t(band, gain, off, bw))"


def _cal():
    return [F.col(c) for c in ("gain", "offset", "eff_bw", "abs_cal")]


def dn_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DN 255 to DN 2047, to radiance, and the gamma curve and back, as sums by image and band."""
    p = _banded(spark, sf_dir).withColumn("dn", R.dn255_to_dn2047(F.col("v")))
    p = p.withColumn("l", R.dn2047_to_radiance(F.col("dn"), *_cal())).withColumn("back", R.dn2047_to_dn255(F.col("dn"))).withColumn("g", R.dn255_to_linear(F.col("v")))
    return p.groupBy("vec_id", "band").agg(F.sum("dn").alias("dn"), r6(F.sum("l"), "radiance"), F.sum("back").alias("back"), r6(F.sum("g"), "linear"), F.sum(R.linear_to_dn255(F.col("g") + 1e-9)).alias("dn255"))


DN_SQL = f"""WITH {_PIX}, {_BANDS}, p AS (SELECT vec_id, band, v, CAST(trunc(v / 255.0::DOUBLE * 2047.0::DOUBLE) AS INTEGER) AS dn, gain, off, bw FROM px, bands),
q AS (SELECT *, gain * dn * (0.009295654::DOUBLE / bw) + off AS l, pow(v / 255.0::DOUBLE, 2.2::DOUBLE) AS g FROM p)
SELECT vec_id, band, CAST(sum(dn) AS BIGINT) AS dn, round(sum(l), 6) AS radiance, CAST(sum(CAST(trunc(dn / 2047.0::DOUBLE * 255.0::DOUBLE) AS INTEGER)) AS BIGINT) AS back, round(sum(g), 6) AS linear,
CAST(sum(CAST(trunc(least(255.0::DOUBLE * pow(g + 0.000000001::DOUBLE, 1.0::DOUBLE / 2.2::DOUBLE), 255.0::DOUBLE)) AS INTEGER)) AS BIGINT) AS dn255 FROM q GROUP BY vec_id, band"""


def combined_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off-nadir plus glint radiance to digital numbers; brightest pixel by image and band, with totals over bands."""
    pix = _banded(spark, sf_dir).select("vec_id", "y", "x", "v", "band")
    out = imaging.combine_bands(pix, R.band_table(spark, "WV3"), F.col("v") / 4.0, F.col("x") * 0.125)
    return out.groupBy("vec_id", "band").agg(F.max("dn2047").alias("dn2047"), F.max("dn255").alias("dn255"), F.sum("radiance").alias("radiance"))


COMBINED_SQL = f"""WITH {_PIX}, {_BANDS}, p AS (SELECT vec_id, band, v / 4.0::DOUBLE + x * 0.125::DOUBLE AS l, gain, off, bw FROM px, bands), q AS (SELECT *, CAST(trunc((l - off) / gain / (0.009295654::DOUBLE / bw)) AS INTEGER) AS dn FROM p)
SELECT vec_id, band, max(dn) AS dn2047, max(CAST(trunc(dn / 2047.0::DOUBLE * 255.0::DOUBLE) AS INTEGER)) AS dn255, sum(l) AS radiance FROM q GROUP BY vec_id, band"""


def image_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean structural similarity of each image to its mirror image."""
    img = _images(spark, sf_dir)
    order = [8 * (k // 8) + 7 - k % 8 for k in range(64)]
    pairs = img.select("vec_id", "grey", F.array(*(F.get("grey", k) for k in order)).alias("mirror"))
    return imaging.ssim(pairs, "grey", "mirror", 8).select("vec_id", r6(F.col("ssim"), "ssim"))


_C1, _C2 = "6.5025::DOUBLE", "58.5225::DOUBLE"
SSIM_SQL = f"""WITH {_PIX}, m AS (SELECT a.vec_id, a.y, a.x, CAST(a.v AS DOUBLE) AS p, CAST(b.v AS DOUBLE) AS q FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = 7 - a.x),
s AS (SELECT vec_id, oy, ox, sum(p) / 49 AS mp, sum(q) / 49 AS mq, sum(p * p) / 49 AS pp, sum(q * q) / 49 AS qq, sum(p * q) / 49 AS pq
 FROM m, (SELECT unnest([0, 1]) AS oy), (SELECT unnest([0, 1]) AS ox) WHERE y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY vec_id, oy, ox),
v AS (SELECT *, 49.0::DOUBLE / 48 * (pp - mp * mp) AS vp, 49.0::DOUBLE / 48 * (qq - mq * mq) AS vq, 49.0::DOUBLE / 48 * (pq - mp * mq) AS cov FROM s)
SELECT vec_id, round(avg((2 * mp * mq + {_C1}) * (2 * cov + {_C2}) / ((mp * mp + mq * mq + {_C1}) * (vp + vq + {_C2}))), 6) AS ssim FROM v GROUP BY vec_id"""


def best_ssim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose id is divisible by 20, turned by quarters and with other grey values in every third pixel, against all images in four turns."""
    img = _images(spark, sf_dir)
    noisy = F.transform("grey", lambda v, k: F.when((k + F.col("vec_id")) % 3 == 0, (v * 7 + k * 31) % 256).otherwise(v))
    asked = img.where("vec_id % 20 = 0").withColumn("grey", noisy)
    turned = F.when((F.col("vec_id") / 20) % 4 == 0, F.col("grey"))
    for k in (1, 2, 3):
        turned = turned.when((F.col("vec_id") / 20) % 4 == k, imaging.rotated(F.col("grey"), 8, k))
    found = imaging.best_windowed_match(asked.withColumn("grey", turned), img, "vec_id", "grey", 8)
    return found.select("query", "match", "angle", r6(F.col("score"), "score"))


# A quarter turn takes the value at (y, x) to (7 - x, y).
_QUARTERS = "CASE {k} WHEN 0 THEN {y} WHEN 1 THEN 7 - {x} WHEN 2 THEN 7 - {y} ELSE {x} END", "CASE {k} WHEN 0 THEN {x} WHEN 1 THEN {y} WHEN 2 THEN 7 - {x} ELSE 7 - {y} END"
SSIM_MATCH_SQL = f"""WITH {_PIX},
n AS (SELECT vec_id, y, x, CASE WHEN (y * 8 + x + vec_id) % 3 = 0 THEN (v * 7 + (y * 8 + x) * 31) % 256 ELSE v END AS v FROM px WHERE vec_id % 20 = 0),
q AS (SELECT vec_id AS query, {_QUARTERS[0].format(k="vec_id // 20 % 4", y="y", x="x")} AS y, {_QUARTERS[1].format(k="vec_id // 20 % 4", y="y", x="x")} AS x, CAST(v AS DOUBLE) AS p FROM n),
c AS (SELECT vec_id AS match, t AS turn, {_QUARTERS[0].format(k="t", y="y", x="x")} AS y, {_QUARTERS[1].format(k="t", y="y", x="x")} AS x, CAST(v AS DOUBLE) AS q FROM px, (SELECT unnest([0, 1, 2, 3]) AS t)),
w AS (SELECT unnest([0, 1]) AS oy), u AS (SELECT unnest([0, 1]) AS ox),
mq AS (SELECT query, oy, ox, sum(p) / 49 AS mp, sum(p * p) / 49 AS pp FROM q, w, u WHERE y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY ALL),
mc AS (SELECT match, turn, oy, ox, sum(q) / 49 AS mq, sum(q * q) / 49 AS qq FROM c, w, u WHERE y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY ALL),
lq AS (SELECT query, oy, ox, list(p ORDER BY y, x) AS ps FROM q, w, u WHERE y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY ALL),
lc AS (SELECT match, turn, oy, ox, list(q ORDER BY y, x) AS qs FROM c, w, u WHERE y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY ALL),
s AS (SELECT query, match, turn, mp, mq, 49.0::DOUBLE / 48 * (pp - mp * mp) AS vp, 49.0::DOUBLE / 48 * (qq - mq * mq) AS vq, 49.0::DOUBLE / 48 * (list_dot_product(ps, qs) / 49 - mp * mq) AS cov
 FROM lq JOIN mq USING (query, oy, ox) JOIN lc USING (oy, ox) JOIN mc USING (match, turn, oy, ox)),
r AS (SELECT query, match, turn, avg((2 * mp * mq + {_C1}) * (2 * cov + {_C2}) / ((mp * mp + mq * mq + {_C1}) * (vp + vq + {_C2}))) AS score FROM s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, match, turn) AS n FROM r)
SELECT query, match, CAST(turn * 90 AS INTEGER) AS angle, round(score, 6) AS score FROM k WHERE n = 1"""


# Spectra.
def _response(spark: SparkSession) -> DataFrame:
    """Triangular responses around three wavelengths, every 5 nm."""
    peak = F.array(F.struct(F.lit("red").alias("band"), F.lit(630.0).alias("peak")), F.struct(F.lit("green").alias("band"), F.lit(545.0).alias("peak")), F.struct(F.lit("blue").alias("band"), F.lit(480.0).alias("peak")))
    return spark.range(13).select(F.explode(peak).alias("b"), ((F.col("id") - 6) * 5.0).alias("d")).select("b.band", (F.col("b.peak") + F.col("d")).alias("wl_nm"), (1.0 - F.abs("d") / 35.0).alias("value"))


def _solar(spark: SparkSession) -> DataFrame:
    """A curve every half nm from 280 to 1 000 nm."""
    wl = 280.0 + F.col("id") * 0.5
    return spark.range(1441).select(wl.alias("wl_nm"), ((wl - 280.0) * (1000.0 - wl) / 129600.0).alias("value"))


def spectrum_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made from parts: numbers, comments and broken lines."""
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), "p_name")).when(F.col("p_partkey") % 7 == 0, "p_name").otherwise(F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(".5 \t 0.25 x")))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.trim(line).alias("line"))
    return files.parse_spectrum(lines)


PARSE_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS file, p_size + 0.5::DOUBLE AS wl_nm, 0.25::DOUBLE AS value FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0"


def spectrum_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spectrum_range(table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("wl_nm")), 200.0).select(r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"))


RANGE_SQL = "SELECT round(greatest(0, min(p_retailprice) - 200), 6) AS lo, round(max(p_retailprice) + 200, 6) AS hi FROM part"


def spectral_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.band_radiance(_solar(spark), _response(spark)).select("band", r6(F.col("radiance"), "radiance"))


OVERLAP_SQL = """WITH r AS (SELECT band, peak + (k - 6) * 5 AS wl, 1 - abs((k - 6) * 5) / 35.0::DOUBLE AS v FROM (VALUES ('red', 630.0::DOUBLE), ('green', 545.0::DOUBLE), ('blue', 480.0::DOUBLE)) t(band, peak), (SELECT range AS k FROM range(13))),
p AS (SELECT band, wl, v * (wl - 280) * (1000 - wl) / 129600.0::DOUBLE AS p FROM r),
a AS (SELECT band, (p + lag(p) OVER (PARTITION BY band ORDER BY wl)) / 2 * (wl - lag(wl) OVER (PARTITION BY band ORDER BY wl)) AS a FROM p)
SELECT band, round(sum(a), 6) AS radiance FROM a GROUP BY band"""


def irradiance_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photon fluxes at the ground, in W per m2 and micrometre, for suns above and below the horizon."""
    s = _solar(spark).withColumn("cz", (F.col("wl_nm") - 600.0) / 400.0)
    e = R.per_micrometre(R.ground_irradiance(R.photon_flux_to_irradiance(F.col("value") * 1e14, F.col("wl_nm")), F.col("cz")))
    return s.select("wl_nm", r6(e, "irradiance"))


IRRADIANCE_SQL = """WITH s AS (SELECT 280 + range * 0.5::DOUBLE AS wl FROM range(1441))
SELECT wl AS wl_nm, round((wl - 280) * (1000 - wl) / 129600.0::DOUBLE * 1e14::DOUBLE * (6.62607015e-34::DOUBLE * 299792458.0::DOUBLE) / (wl * 1e-9::DOUBLE) * 1e4::DOUBLE * greatest((wl - 600) / 400.0::DOUBLE, 0.0::DOUBLE) * 1000, 6) AS irradiance FROM s"""


def glint_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 15 minutes from 6 to 21:45: sun height over the day, glint by band, with the day's maximum by band and in all."""
    slots = spark.range(64).select((F.col("id") * 15 + 360).alias("minute"))
    zenith = F.abs(F.col("minute") - 720.0) / 720.0 * 1.5
    light = R.glint_reflectance(zenith, F.lit(0.3), F.lit(3.0), 10.0)
    each = slots.withColumn("g", light).join(F.broadcast(R.band_table(spark, "WV3")))
    best = each.rollup("band").agg(F.max("g").alias("g"), F.count("*").alias("renders"))
    return best.select(F.coalesce("band", F.lit("all")).alias("band"), r6(F.col("g"), "glint"), "renders")


GLINT_SWEEP_SQL = """WITH s AS (SELECT 360 + range * 15 AS m FROM range(64)), z AS (SELECT abs(m - 720.0::DOUBLE) / 720.0::DOUBLE * 1.5::DOUBLE AS z FROM s),
c AS (SELECT z, sqrt((1 + greatest(-1.0::DOUBLE, least(1.0::DOUBLE, cos(z) * cos(0.3::DOUBLE) + sin(z) * sin(0.3::DOUBLE) * cos(3.0::DOUBLE)))) / 2) AS w FROM z),
t AS (SELECT w, (cos(z) + cos(0.3::DOUBLE)) / (2 * w) AS ct FROM c), n AS (SELECT *, 1.3330::DOUBLE / 1.000277::DOUBLE AS n, 0.003::DOUBLE + 0.00512::DOUBLE * 10 AS var FROM t),
f AS (SELECT *, sqrt(1 - (1 - w * w) / (n * n)) AS wt FROM n),
g AS (SELECT pi() * (exp(-(1 / (ct * ct) - 1) / var) / (pi() * var)) * (pow((w - n * wt) / (w + n * wt), 2) + pow((n * w - wt) / (n * w + wt), 2)) / 2 / (4 * cos(0.3::DOUBLE) * pow(ct, 4)) AS g FROM f)
SELECT coalesce(band, 'all') AS band, round(max(g), 6) AS glint, count(*) AS renders FROM g, (VALUES ('red'), ('green'), ('blue')) b(band) GROUP BY ROLLUP (band)"""


# Terrain.
SIDE = 32


def dem_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 32 x 32 sea of 50 sinusoids from the linear congruence, between 0.05 and 0.5 m."""
    g = terrain.grid(spark, SIDE, SIDE, 1.0)
    k = F.col("id")
    w = spark.range(50).select(k.alias("wave"), lcg(k, 1).alias("amplitude"), lcg(k, 2).alias("kx"), lcg(k, 3).alias("ky"), (lcg(k, 4) * 6.0).alias("phase"))
    return terrain.wave_field(g, w, 0.05, 0.5).select("i", "j", r6(F.col("z"), "z"))


WAVES_SQL = f"""WITH g AS (SELECT CAST(range // 32 AS INTEGER) AS i, CAST(range % 32 AS INTEGER) AS j, -16.0::DOUBLE + (range % 32) * (32.0::DOUBLE / 31) AS x, -16.0::DOUBLE + (range // 32) * (32.0::DOUBLE / 31) AS y FROM range(1024)),
w AS (SELECT {lcg_sql('range', 1)} AS a, {lcg_sql('range', 2)} AS kx, {lcg_sql('range', 3)} AS ky, {lcg_sql('range', 4)} * 6 AS ph FROM range(50)),
z AS (SELECT i, j, sum(a * sin(kx * x + ky * y + ph)) AS z FROM g, w GROUP BY i, j)
SELECT i, j, round(0.05::DOUBLE + 0.45::DOUBLE * (z - (SELECT min(z) FROM z)) / ((SELECT max(z) FROM z) - (SELECT min(z) FROM z)), 6) AS z FROM z"""


def dem_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = terrain.grid(spark, SIDE, SIDE, 500.0)
    return g.select("i", "j", r6(terrain.curved(F.col("x"), F.col("y"), F.lit(0.0)), "z"))


CURVE_SQL = """WITH g AS (SELECT CAST(range // 32 AS INTEGER) AS i, CAST(range % 32 AS INTEGER) AS j, -8000.0::DOUBLE + (range % 32) * (16000.0::DOUBLE / 31) AS x, -8000.0::DOUBLE + (range // 32) * (16000.0::DOUBLE / 31) AS y FROM range(1024))
SELECT i, j, round(0 - (6371000.0::DOUBLE - sqrt(6371000.0::DOUBLE * 6371000.0::DOUBLE - (x * x + y * y))), 6) AS z FROM g"""


def dem_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.faces(spark, SIDE, SIDE)


FACES_SQL = """WITH c AS (SELECT range AS k, range // 31 * 32 + range % 31 AS p FROM range(961))
SELECT k * 2 AS face, p AS a, p + 32 AS b, p + 1 AS c FROM c UNION ALL SELECT k * 2 + 1, p + 1, p + 32, p + 33 FROM c"""


def dem_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = terrain.grid(spark, SIDE, SIDE, 1.0).withColumn("t", terrain.texture(F.col("i"), F.col("j"), SIDE, SIDE))
    return g.select("i", "j", r6(F.col("t.u"), "u"), r6(F.col("t.v"), "v"))


UV_SQL = "SELECT CAST(range // 32 AS INTEGER) AS i, CAST(range % 32 AS INTEGER) AS j, round((range % 32) / 31.0::DOUBLE, 6) AS u, round(1 - (range // 32) / 31.0::DOUBLE, 6) AS v FROM range(1024)"


def mesh_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals of a tilted plane: all the same."""
    v = terrain.grid(spark, SIDE, SIDE, 1.0).select((F.col("i") * SIDE + F.col("j")).cast("long").alias("id"), "x", "y", (F.col("x") * 0.5 + F.col("y") * 0.25).alias("z"))
    return terrain.vertex_normals(v, terrain.faces(spark, SIDE, SIDE)).select("id", *(r6(F.abs(F.col(c)), c) for c in ("nx", "ny", "nz")))


NORMALS_SQL = "SELECT range AS id, round(0.5::DOUBLE / sqrt(1.3125::DOUBLE), 6) AS nx, round(0.25::DOUBLE / sqrt(1.3125::DOUBLE), 6) AS ny, round(1 / sqrt(1.3125::DOUBLE), 6) AS nz FROM range(1024)"


def dem_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane at twice the cells: inner values lie on the same plane."""
    g = terrain.grid(spark, SIDE, SIDE, 1.0).select("i", "j", (F.col("i") * 2.0 + F.col("j")).alias("z"))
    return terrain.resample(g, SIDE, SIDE, 2 * SIDE, 2 * SIDE).select("i", "j", r6(F.col("z"), "z"))


RESAMPLE_SQL = """WITH g AS (SELECT CAST(range // 64 AS INTEGER) AS i, CAST(range % 64 AS INTEGER) AS j FROM range(4096))
SELECT i, j, round(2 * greatest(0.0::DOUBLE, least(31.0::DOUBLE, (i + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)) + greatest(0.0::DOUBLE, least(31.0::DOUBLE, (j + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)), 6) AS z FROM g"""

QUERIES = {
    "chip_semi_join": (chip_semi_join, _CHIP.format("")),
    "chip_anti_join": (chip_anti_join, _CHIP.format("NOT")),
    "prefix_candidates": (prefix_candidates, PREFIX_SQL),
    "name_parts": (name_parts, NAME_SQL),
    "space_res_parse": (space_res_parse, SPACE_SQL),
    "image_annotations_outer": (image_annotations_outer, OUTER_SQL),
    "first_metadata_match": (first_metadata_match, FIRST_SQL),
    "missing_files": (missing_files, MISSING_SQL),
    "extra_files": (extra_files, EXTRA_SQL),
    "file_check_report": (file_check_report, CHECK_SQL),
    "category_default_lookup": (category_default_lookup, CATEGORY_SQL),
    "size_mode_min_max": (size_mode_min_max, SIZE_SQL),
    "category_summary": (category_summary, SUMMARY_SQL),
    "split_70_20_10": (split_70_20_10, SPLIT_SQL),
    "split_with_annotations": (split_with_annotations, SPLIT_ANN_SQL),
    "renumber_ids": (renumber_ids, RENUMBER_SQL),
    "remap_category": (remap_category, REMAP_SQL),
    "merged_splits": (merged_splits, MERGE_SQL),
    "coco_json_roundtrip": (coco_json_roundtrip, JSON_SQL),
    "bbox_rotation": (bbox_rotation, BBOX_SQL),
    "segmentation_rotation": (segmentation_rotation, SEG_SQL),
    "polygon_to_coco": (polygon_to_coco, POLYGON_SQL),
    "best_match_similarity": (best_match_similarity, MATCH_SQL),
    "best_rotation": (best_rotation, ROTATION_SQL),
    "crop_black_border": (crop_black_border, CROP_SQL),
    "pixel_rmse": (pixel_rmse, RMSE_SQL),
    "dn_roundtrip": (dn_roundtrip, DN_SQL),
    "combined_dn": (combined_dn, COMBINED_SQL),
    "image_ssim": (image_ssim, SSIM_SQL),
    "best_ssim_match": (best_ssim_match, SSIM_MATCH_SQL),
    "spectrum_parse": (spectrum_parse, PARSE_SQL),
    "spectrum_range": (spectrum_range, RANGE_SQL),
    "spectral_overlap": (spectral_overlap, OVERLAP_SQL),
    "irradiance_ground": (irradiance_ground, IRRADIANCE_SQL),
    "glint_sweep": (glint_sweep, GLINT_SWEEP_SQL),
    "dem_waves": (dem_waves, WAVES_SQL),
    "dem_curvature": (dem_curvature, CURVE_SQL),
    "dem_faces": (dem_faces, FACES_SQL),
    "dem_uv": (dem_uv, UV_SQL),
    "mesh_normals": (mesh_normals, NORMALS_SQL),
    "dem_resample": (dem_resample, RESAMPLE_SQL),
}
