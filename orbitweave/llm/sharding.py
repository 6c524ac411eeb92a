"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together and go, largest first, to the least-loaded shard. The heap works
on size classes: a class holds the groups of one size (sizes above ``2**EXACT_BITS`` share a class
within one part in ``2**EXACT_BITS``), and popping the heap n times for n groups of one size has a
closed form, so the driver sees a table whose length is bounded by ``(64 - EXACT_BITS) * 2**EXACT_BITS``
whatever the corpus. Texts are never shuffled, only hashes and sizes.

Cases: a null text counts as empty (size 8); equal texts, repeated rows included, form one group; equal
sizes are ordered by text hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.llm.storage import materialise

EXACT_BITS = 10
#: Rows that one window sorts at once on average; the number of salts follows the table.
ROWS_PER_CHUNK = 20_000
#: A group of more rows than this, and than one in HOT_GROUPS of all, is looked up by a broadcast: fewer than HOT_GROUPS are.
HOT_GROUP, HOT_GROUPS = 1_000, 5_000


def _size_class(size: Column) -> Column:
    """Sizes up to 2**EXACT_BITS as they are; above, EXACT_BITS leading bits after the first and the exponent."""
    exponent = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - EXACT_BITS, F.lit(0))
    lead = F.floor(size / F.pow(F.lit(2.0), exponent)).cast("long")
    return lead + exponent.cast("long") * (1 << EXACT_BITS)


def deal(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """For size classes in falling order: (class index, shard, first rank, end rank) of the groups a shard gets.

    Equals one heap pop per group: whole rounds are taken at once where the pops would be cyclic."""
    load = np.zeros(shards)
    out = []
    for k, (size, left) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        got = np.zeros(shards, dtype=np.int64)
        if left > 4 * shards:
            lo, hi = load.min(), load.max()
            for _ in range(60):  # the highest level below the fullest shard to which the groups suffice
                level = hi if _ == 0 else (lo + hi) / 2
                fill = np.floor(np.maximum(level - load, 0) / size).astype(np.int64)
                if fill.sum() <= left:
                    lo, got = level, fill
                    if level == hi:
                        break
                else:
                    hi = level
            left -= int(got.sum())
            if lo == load.max():  # from here on the pops are cyclic
                got += left // shards
                left %= shards
            load += got * size
        heap = [(x, s) for s, x in enumerate(load.tolist())]
        heapq.heapify(heap)
        for _ in range(left):
            x, s = heap[0]
            got[s] += 1
            load[s] = x + size
            heapq.heapreplace(heap, (x + size, s))
        ends = np.cumsum(got)
        out += [(k, s, int(ends[s] - got[s]), int(ends[s])) for s in np.flatnonzero(got).tolist()]
    return out


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: size is UTF-8 bytes plus 8, slot is gapless from 0 in each shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("key"),
        ),
        "shard-rows",
    )
    total = rows.count()
    salts = max(1, total // ROWS_PER_CHUNK)
    groups = rows.groupBy("key", "size").agg(F.count("*").alias("rows")).select("key", "rows", (F.col("size") * F.col("rows")).alias("bytes"))
    salt = F.pmod(F.xxhash64("key"), F.lit(salts))
    groups = materialise(
        groups.select("key", "rows", "bytes", _size_class(F.col("bytes")).alias("cls"), salt.alias("salt"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("cls", "salt").orderBy(F.desc("bytes"), "key")) - 1),
        "shard-groups",
    )
    chunks = groups.groupBy("cls", "salt").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    # One row for each salt of a class: at most ``salts`` rows in a window.
    starts = chunks.select("cls", "salt", (F.sum("n").over(Window.partitionBy("cls").orderBy("salt")) - F.col("n")).alias("start"))
    classes = chunks.groupBy("cls").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).orderBy(F.desc("cls")).collect()
    counts = np.array([r.n for r in classes], dtype=np.int64)
    means = np.array([r.b for r in classes], dtype=np.float64) / np.maximum(counts, 1)
    quotas = [(int(classes[k].cls), s, a, b) for k, s, a, b in deal(means, counts, shards)]
    quota = spark.createDataFrame(quotas, "cls long, shard int, lo long, hi long")
    placed = (
        groups.join(starts, ["cls", "salt"])
        .withColumn("place", F.col("rank") + F.col("start"))
        .join(F.broadcast(quota), "cls")  # some rows for each size class, of which there are a bounded number
        .where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
        .select("key", "rows", "shard")
    )
    # The largest groups are looked up by a broadcast, so that no task gets all rows of one text.
    placed = materialise(placed, "shard-placed")
    hot = F.col("rows") > F.lit(max(HOT_GROUP, total // HOT_GROUPS))
    often = F.broadcast(placed.where(hot).drop("rows"))
    joined = rows.join(often, "key").unionByName(rows.join(often, "key", "left_anti").join(placed.where(~hot).drop("rows"), "key"))
    # Slots: a rank within a chunk of the shard plus the rows of the chunks before it.
    chunk = F.pmod(F.xxhash64("doc_id", "key"), F.lit(max(1, total // ROWS_PER_CHUNK)))
    dealt = materialise(joined.withColumn("chunk", chunk), "shard-dealt")
    sizes = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "key")) - 1
    return (
        dealt.withColumn("rank", rank)
        .join(before, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("before")).cast("long").alias("slot"))
    )
