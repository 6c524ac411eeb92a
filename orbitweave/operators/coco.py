"""Annotation datasets: images and their annotations as tables, joined, renumbered, split, checked and nested again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.functions import shapes
from orbitweave.operators.matching import missing_and_extra, mode
from orbitweave.operators.ordinal import MAX_RANGES, ROWS_PER_RANGE, positional_split, with_ordinal


def with_annotations(images: DataFrame, annotations: DataFrame, image_id: str, fields: list[str], order: list[Column]) -> DataFrame:
    """Images with a sorted ``annotations`` array, empty where there are none (left outer 1:N)."""
    nested = annotations.groupBy(image_id).agg(F.sort_array(F.collect_list(F.struct(*(o.alias(f"__o{k}") for k, o in enumerate(order)), *fields))).alias("__all"))
    picked = F.transform("__all", lambda a: F.struct(*(a[f].alias(f) for f in fields)))
    joined = images.join(nested.select(image_id, picked.alias("annotations")), image_id, "left")
    empty = F.array().cast(nested.select(picked.alias("a")).schema["a"].dataType)
    return joined.withColumn("annotations", F.coalesce("annotations", empty))


def renumber(images: DataFrame, annotations: DataFrame, image_id: str, image_order: list[Column], annotation_order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Both tables with gapless ids from 1 (``new_image_id``, ``new_id``); annotations follow their image."""
    total = images.count()
    numbered = with_ordinal(images, image_order[0], image_order[1:], "new_image_id", total=total)
    linked = annotations.join(numbered.select(image_id, "new_image_id"), image_id)
    # Image numbers have no gaps, so equal steps of them cut the annotations: no quantiles of the join are needed.
    ranges = min(MAX_RANGES, max(1, annotations.count() // ROWS_PER_RANGE), max(1, total))
    cuts = [total * k / ranges + 0.5 for k in range(1, ranges)]
    return numbered, with_ordinal(linked, F.col("new_image_id"), annotation_order, "new_id", cuts=cuts)


def one_category(annotations: DataFrame, column: str = "category_id", value: int = 0) -> DataFrame:
    """Every annotation in one category."""
    return annotations.withColumn(column, F.lit(value))


def split_dataset(images: DataFrame, annotations: DataFrame, image_id: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Images and their annotations with ``split``: train, val, test by place in a seeded order."""
    order = F.pmod(F.xxhash64(F.lit(seed), image_id), F.lit(1 << 52))
    placed = positional_split(images, order, [F.col(image_id)])
    return placed, annotations.join(placed.select(image_id, "split"), image_id)


def polygon_annotation(points: Column, digits: int | None = None) -> Column:
    """``STRUCT<bbox, area, segmentation, iscrowd>`` of an array of ``STRUCT<x, y>``; null for fewer than three. Area is the box's."""
    box = shapes.polygon_box(points)
    put = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    made = F.struct(
        F.array(*(put(box[k]) for k in "xywh")).alias("bbox"), put(box["w"] * box["h"]).alias("area"), shapes.flat_ring(points, digits).alias("segmentation"), F.lit(0).alias("iscrowd")
    )
    return F.when(F.size(points) >= 3, made)


def rotate_annotation(bbox: Column, segmentation: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    """``STRUCT<bbox, segmentation>`` in the frame of an image that was turned by ``degrees``."""
    back = shapes.inverse_angle(degrees)
    box = shapes.rotate_box(F.get(bbox, 0), F.get(bbox, 1), F.get(bbox, 2), F.get(bbox, 3), cx, cy, back)
    return F.struct(F.array(box["x"], box["y"], box["w"], box["h"]).alias("bbox"), shapes.rotate_rings(segmentation, cx, cy, back).alias("segmentation"))


def size_report(images: DataFrame, width: str, height: str, name: str, order: str) -> DataFrame:
    """``most_common, most_common_n, smallest, largest``: sizes by frequency and by area, the first in order on ties."""
    area = F.col(width) * F.col(height)
    item = F.struct(width, height, name)
    ends = images.agg(F.min_by(item, F.struct(area, F.col(order))).alias("smallest"), F.min_by(item, F.struct(-area, F.col(order))).alias("largest"))
    top = mode(images, [width, height], F.col(order)).select(F.struct(width, height).alias("most_common"), F.col("n").alias("most_common_n"))
    return ends.join(top, how="left")  # a row each


def check_files(images: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """``expected, present, missing, extra`` counts of a dataset against a folder."""
    missing, extra = missing_and_extra(images, listing, name)
    count = lambda df, label: df.agg(F.count("*").alias(label))
    return count(images, "expected").join(count(listing.select(name).distinct(), "present")).join(count(missing, "missing")).join(count(extra, "extra"))


def categories_used(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """``category_id, name, n``: used ids with their name or ``Unknown``."""
    used = annotations.groupBy("category_id").agg(F.count("*").alias("n"))
    return used.join(categories, "category_id", "left").select("category_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "n")


def merge(parts: list[DataFrame]) -> DataFrame:
    """Union of splits whose columns may differ; annotations keep their split's other fields."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def as_json(rows: DataFrame, keys: list[str], out: str = "json") -> DataFrame:
    """Each row's other columns as a JSON object."""
    return rows.select(*keys, F.to_json(F.struct(*(c for c in rows.columns if c not in keys))).alias(out))
