"""Attitudes carried on from row to row: running products of rotations, over many tasks.

A rotation is a unit quaternion ``STRUCT<w, x, y, z>``. Products of quaternions are associative but keep their order,
so a long group is cut into ranges of its order: each range multiplies its own rows, the products of whole ranges
(a row each) are multiplied up, and each row's attitude is what all ranges before give, times what its range gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitweave.operators.ordinal import MAX_RANGES, ROWS_PER_RANGE, quantile_cuts, range_of
from orbitweave.sources.scratch import fresh_path

QUATERNION = T.StructType([T.StructField(c, T.DoubleType()) for c in "wxyz"])
_PARTS = [f"__{c}" for c in "wxyz"]


def turn(axis: Column, degrees: Column) -> Column:
    """The rotation by an angle about a unit vector ``STRUCT<x, y, z>``."""
    half = F.radians(degrees) / 2.0
    return F.struct(F.cos(half).alias("w"), *((axis[c] * F.sin(half)).alias(c) for c in "xyz"))


def times(p: Column, q: Column) -> Column:
    """First ``p``, then ``q`` in the frame that ``p`` has turned."""
    return F.struct(
        (p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"]).alias("w"),
        (p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"]).alias("x"),
        (p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"]).alias("y"),
        (p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"]).alias("z"),
    )


def running_products(q: np.ndarray) -> np.ndarray:
    """Row k of the result is the product of rows 0 to k (of n x 4), in log n vectorised steps."""
    out, step = q.copy(), 1
    while step < len(out):
        (a, b, c, d), (e, f, g, h) = out[:-step].T, out[step:].T
        out[step:] = np.stack([a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e], axis=1)
        step *= 2
    return out


def _scan(order: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        q = np.stack([table[c].to_numpy() for c in _PARTS], axis=1) if table.num_rows else np.empty((0, 4))
        done = running_products(q)
        for k, c in enumerate(_PARTS):
            table = table.set_column(table.column_names.index(c), c, pa.array(done[:, k]))
        return table

    return run


def carried(rows: DataFrame, keys: list[str], order: list[str], rotation: str, before: str = "before", after: str = "after", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds the attitude ``before`` and ``after`` each row's rotation: of a group's rows so far, in order; at first no turn.

    ``order[0]`` is a number; the others tell rows of the same number apart. A null rotation, or one with a null part,
    turns nothing; rows with null keys are one group."""
    names = [c for c in rows.columns if c not in (before, after)]
    none = F.col(rotation).isNull() | F.greatest(*(F.col(rotation)[c].isNull() for c in "wxyz"))
    parts = [F.when(none, 1.0 if c == "w" else 0.0).otherwise(F.col(rotation)[c].cast("double")).alias(f"__{c}") for c in "wxyz"]
    ranges = min(MAX_RANGES, max(1, rows.count() // rows_per_range))
    cuts = quantile_cuts(rows.select(F.col(order[0]).cast("double").alias("__o")), "__o", ranges)
    placed = rows.select(*names, range_of(F.col(order[0]), cuts).alias("__range"), *parts)
    path = fresh_path(rows.sparkSession, "attitudes")
    placed.groupBy(*keys, "__range").applyInArrow(_scan(order), placed.schema).write.parquet(path)
    local = rows.sparkSession.read.schema(placed.schema).parquet(path)
    # The product of a range is its last row's.
    last = F.max_by(F.struct(*_PARTS), F.struct(*order)).alias("__last")
    totals = local.groupBy(*keys, "__range").agg(last).select(*keys, "__range", "__last.*")
    through = totals.groupBy(*keys).applyInArrow(_scan(["__range"]), totals.schema)
    # Each range begins with what its group has turned before it: a row for each range, so MAX_RANGES in a window at most.
    start = F.lag(F.struct(*(F.col(f"__{c}").alias(c) for c in "wxyz"))).over(Window.partitionBy(*keys).orderBy("__range"))
    starts = through.select(*(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)), F.col("__range").alias("__r"), start.alias("__start"))
    joined = local.join(starts, [F.col("__range") == F.col("__r"), *(F.col(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys))], "left")
    start = F.coalesce("__start", F.struct(*(F.lit(1.0 if c == "w" else 0.0).alias(c) for c in "wxyz")))
    here = times(start, F.struct(*(F.col(f"__{c}").alias(c) for c in "wxyz")))
    back = F.struct(F.col(f"{rotation}.w").alias("w"), *((-F.col(f"{rotation}.{c}")).alias(c) for c in "xyz"))
    out = joined.select(*names, here.alias(after))
    return out.withColumn(before, F.when(none, F.col(after)).otherwise(times(F.col(after), back)))
