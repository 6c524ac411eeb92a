"""Intermediate tables in the folder that all executors share.

``materialise`` cuts lineage: the rows go to Parquet under ``spark.checkpoint.dir`` and are read
again, so a lost executor costs a re-read and not a recomputation. Where that setting is absent
a local master gets a temporary folder of this process; a cluster's executors could not share one, so
there it is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.sources.scratch import fresh_path

_made: list[str] = []


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this process has written; results that read them must have been taken before."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids (8 bytes each) up to which a list of them may be broadcast.
BROADCAST_IDS = 300_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str | Column = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in the only column of ``ids``; rows without an id stay, rows that share one go together."""
    gone = materialise(ids.select(F.col(ids.columns[0]).cast("long").alias("__gone")).where("__gone IS NOT NULL").distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, (F.col(id_col) if isinstance(id_col, str) else id_col).cast("long") == F.col("__gone"), "left_anti")
