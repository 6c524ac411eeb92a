"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, piece ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, with the columns of ``documents`` for
all but the last. ``run`` writes each stage's rows to the shared folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.llm import decontam, langid, linededup, neardup, pieces
from orbitweave.llm.storage import materialise, without_ids

#: Calibrated probability of the best language below which a document is rejected.
MIN_CONFIDENCE = 0.5


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, without text, or of no clear language; equal texts fare alike.

    A document without a language or an id is judged, but never learned from; without any labelled document
    no language is known and all are rejected; an empty table stays empty."""
    model = langid.train(docs.where(~langid.held_out()))
    pred, score = (_unused(docs, name) for name in ("pred", "score"))
    judged = langid.predict(docs, model, pred_col=pred, score_col=score)
    return judged.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= MIN_CONFIDENCE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines, short ones too, out of the texts; a document that has lost all it said goes.

    A document without text, or of blank lines only, stays as it is; of rows equal in id and text all keep the
    same lines; a row without an id comes before all others; an empty table stays empty."""
    own = {c: _unused(docs, c) for c in ("n_lines", "n_exact", "n_near") if c in docs.columns}
    deduped = linededup.dedup_lines(docs.withColumnsRenamed(own), exact_chars=1)
    lost = (F.col("n_exact") + F.col("n_near") > 0) & (F.trim("text") == "")
    return deduped.where(~F.coalesce(lost, F.lit(False))).withColumn("n_chars", F.char_length("text").cast("long")).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates.

    Rows that share an id are one document and stay or go together; rows without an id, without words or
    without text stay; an empty table stays empty."""
    return without_ids(docs, neardup.near_components(docs).where(~F.col("kept")).select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark text; one that only mentions an item of one to three words stays.

    Rows are told apart by their texts, so one without an id goes too if its text holds an item; rows without
    text stay; an empty table or benchmark changes nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(F.xxhash64("text").alias("key"), "text")
    leaks = decontam.find_leaks(rows, benchmark, id_col="key").where(F.col("kind") != "mention")
    return without_ids(docs, leaks.select("doc_id"), F.xxhash64("text"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it; a row without text has null ids and counts as exact."""
    encoded = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"))
    count = F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long")
    return encoded.select("doc_id", "lang", "source", count.alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("SentencePiece", sentencepiece),
]

#: SQL expresses neither the first nor the last two stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
