"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, the
others as named users and system messages as they are. Training masks cover what the assistant says, the
end mark included. A dialogue is cut into parts of ``PART_TURNS`` consecutive turn numbers, and a part of more
than ``PIECE_ROWS`` messages, as repeated or null turn numbers can make it, into pieces of that many. So a row,
a window and a join key are bounded, also where one conversation, or the null one, holds a third of all rows.
The pieces of a perspective, in order of part and piece, are the whole dialogue.

Messages of long parts are numbered by ranges: sorted in range partitions, with the counts of earlier
partitions added. Messages that are alike in turn, speaker and text are dealt over ranges by a seeded number.

Cases: turns are ordered by number, then speaker and text (null first); repeated rows are rendered each;
a null text is empty; a null speaker is a user named ``unknown`` and no perspective; messages of
``CONTEXT`` roles are no perspective; a conversation without participants gives no row; a null
conversation id is a conversation of its own; the marks' opening in a text is broken by a space; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.llm.storage import BROADCAST_IDS, materialise

PART_TURNS, PIECE_ROWS = 256, 4096
CONTEXT = ("system",)
START, END = "<|im_start|>", "<|im_end|>"


#: A conversation's key without nulls, so that joins and windows share a partitioning.
_KEY = ["key", "keyless", "part"]


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``piece``: their places in the order of their part, in steps of ``PIECE_ROWS``."""
    order = [*_KEY, "turn", "speaker", "text", "salt"]
    # The sign bits of these ids tell the partition, the lower 33 the place in it.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).withColumn("place", place), "turns-ordered")
    ranges = ordered.groupBy(*_KEY, "range").agg(F.min("place").alias("lo"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*_KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = materialise(ranges.select(*_KEY, "range", (F.coalesce(earlier, F.lit(0)) - F.col("lo")).alias("shift")), "turns-ranges")
    side = F.broadcast(ranges) if ranges.count() <= BROADCAST_IDS else ranges
    return ordered.join(side, [*_KEY, "range"]).withColumn("piece", F.floor((F.col("place") + F.col("shift")) / PIECE_ROWS).cast("long")).select(*rows.columns, "piece")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, perspective, part, piece, rendered, spans, n_turns, n_trained``; spans are the masks' ``start, end`` in characters."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("key"),
        F.col(conv_col).isNull().alias("keyless"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(speaker_col).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|im_"), F.lit("< |im_")).alias("text"),
        F.rand(9).alias("salt"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(0)).cast("long"))
    parts = materialise(rows.groupBy(*_KEY).agg(F.count("*").alias("n")), "turns-parts")
    long_parts = parts.where(F.col("n") > PIECE_ROWS).select(*_KEY)
    n_long = long_parts.count()
    if n_long:
        side = F.broadcast(long_parts) if n_long <= BROADCAST_IDS else long_parts
        short = rows.join(side, _KEY, "left_anti").withColumn("piece", F.lit(0).cast("long"))
        rows = short.unionByName(_numbered(rows.join(side, _KEY, "left_semi")))
    else:
        rows = rows.withColumn("piece", F.lit(0).cast("long"))
    people = rows.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*CONTEXT)).select("key", "keyless", F.col("speaker").alias("perspective")).distinct()
    pieces = parts.select(*_KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE_ROWS).cast("long"))).alias("piece"))
    seen = rows.join(pieces.join(people, ["key", "keyless"]), [*_KEY, "piece"])
    trained = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    head = (
        F.when(trained, F.lit(f"{START}assistant\n"))
        .when(F.col("speaker").isin(*CONTEXT), F.concat(F.lit(START), F.col("speaker"), F.lit("\n")))
        .otherwise(F.concat(F.lit(f"{START}user name="), F.coalesce("speaker", F.lit("unknown")), F.lit("\n")))
    )
    seen = seen.withColumn("trained", trained).withColumn("head", head).withColumn("body", F.concat("text", F.lit(END)))
    own = [*_KEY, "piece", "perspective"]
    part = Window.partitionBy(*own).orderBy("turn", "speaker", "text")
    length = F.char_length("head") + F.char_length("body") + 1
    seen = seen.withColumn("nr", F.row_number().over(part)).withColumn("stop", F.sum(length).over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # stop is after the line feed that follows the end mark
    span = F.struct((F.col("stop") - 1 - F.char_length("body")).alias("start"), (F.col("stop") - 1).alias("end"))
    message = F.struct("nr", F.concat("head", "body", F.lit("\n")).alias("said"))
    return (
        seen.groupBy(*own)
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.array_join(F.transform(F.sort_array(F.collect_list(message)), lambda m: m["said"]), "").alias("rendered"),
            F.sort_array(F.collect_list(F.when(F.col("trained"), span))).alias("spans"),
            F.count("*").alias("n_turns"),
            F.count_if("trained").alias("n_trained"),
        )
        .select("conv_id", "perspective", "part", "piece", "rendered", "spans", "n_turns", "n_trained")
    )


def digest(rendered: DataFrame) -> DataFrame:
    """What each piece looks like: sizes, a checksum of the text and the masks as text."""
    spans = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return rendered.select(
        "conv_id", "perspective", "part", "piece", "n_turns", "n_trained",
        F.char_length("rendered").cast("long").alias("n_chars"),
        F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"),
        F.array_join(spans, ",").alias("masks"),
    )


DIGEST_SQL = """
WITH m AS (SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS text, CAST(coalesce(floor(turn / 256.0), 0) AS BIGINT) AS part FROM conversations),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text) - 1) // 4096 AS piece FROM m),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
s AS (SELECT t.conv_id, perspective, part, piece, turn, speaker, text, coalesce(speaker = perspective, false) AS trained,
  CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10) WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) ELSE '<|im_start|>user name=' || coalesce(speaker, 'unknown') || chr(10) END AS head,
  text || '<|im_end|>' AS body FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text) AS nr FROM s),
x AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY nr) AS stop FROM w)
SELECT conv_id, perspective, part, piece, count(*) AS n_turns, CAST(count(*) FILTER (WHERE trained) AS BIGINT) AS n_trained, CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars,
  md5(string_agg(head || body || chr(10), '' ORDER BY nr)) AS rendered_md5,
  coalesce(string_agg(CASE WHEN trained THEN CAST(CAST(stop - 1 - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY nr), '') AS masks
FROM x GROUP BY conv_id, perspective, part, piece
"""
