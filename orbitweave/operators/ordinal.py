"""Global row numbers and positional splits without a single-partition sort."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window numbers at once on average, and how many ranges there are at most.
ROWS_PER_RANGE, MAX_RANGES = 200_000, 16_384


def quantile_cuts(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Up to ``ranges`` - 1 approximate quantiles of a numeric column, rising and distinct."""
    if ranges <= 1:
        return []
    return sorted(set(df.approxQuantile(column, [k / ranges for k in range(1, ranges)], 0.2 / ranges)))


def range_of(column: Column, cuts: list[float]) -> Column:
    """In which range between the cuts a value lies, from 0 (binary search over Arrow batches); a null is in the first."""
    if not cuts:
        return F.lit(0)
    edges = np.array(cuts, dtype=np.float64)

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.where(values.isna(), 0, np.searchsorted(edges, values.to_numpy(dtype=np.float64, na_value=-np.inf), side="right")).astype(np.int32))

    return place(column.cast("double"))


def with_ordinal(df: DataFrame, key: Column, ties: list[Column], out: str, start: int = 1, total: int | None = None, cuts: list[float] | None = None) -> DataFrame:
    """Adds a gapless number by (key, ties); ``key`` is a number.

    Approximate quantiles cut the key into ranges; rows are numbered within their range, plus the exact
    count of the ranges before. The quantiles only balance the work, they don't change a number.
    A caller who knows them may give the number of rows (``total``) or the cuts, so that ``df`` is run less often."""
    keyed = df.withColumn("__key", key.cast("double"))
    if cuts is None:
        ranges = min(MAX_RANGES, max(1, (df.count() if total is None else total) // ROWS_PER_RANGE))
        cuts = quantile_cuts(keyed, "__key", ranges)
    if not cuts:  # one range, so one window
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key, *ties))
        return df.withColumn(out, (rank + (start - 1)).cast("long"))
    keyed = keyed.withColumn("__range", range_of(F.col("__key"), cuts))
    sizes = keyed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(key, *ties))
    return keyed.withColumn("__rank", rank).join(F.broadcast(before), "__range").withColumn(out, (F.col("__rank") + F.col("__before") + (start - 1)).cast("long")).drop("__key", "__range", "__rank", "__before")


def split_cuts(n: int, train: float = 0.7, val: float = 0.2) -> tuple[int, int]:
    """Row counts at which the validation and the test part begin: products in binary floating point, cut."""
    return int(n * train), int(n * (train + val))


def positional_split(df: DataFrame, order: Column, ties: list[Column], out: str = "split") -> DataFrame:
    """Adds train, val or test by place in the order."""
    total = df.count()
    a, b = split_cuts(total)
    numbered = with_ordinal(df, order, ties, "__at", start=0, total=total)
    return numbered.withColumn(out, F.when(F.col("__at") < a, "train").when(F.col("__at") < b, "val").otherwise("test")).drop("__at")
