"""Document fingerprints by a homomorphic multiset hash.

A paragraph (line) is hashed to two wide vectors: ``EQ_LANES`` pseudo-random lanes that decide equality,
and ``LIKE_LANES`` signed counts of the hashes of its word trigrams that measure likeness. A document's
fingerprint is the lane-wise sum over its paragraphs modulo 2**16. The sum ignores order, and a paragraph
is inserted or deleted by adding or subtracting its vector. The modulus is the sum's: a paragraph that occurs
65,536 times in a text adds nothing. Two paragraphs are told apart by 64 bits of their hash. The squared distance of two count vectors
estimates in how many trigrams the texts differ (each trigram adds +-1 to one lane).

Cases: a null text counts as empty; blank paragraphs have the zero vector, so an empty text has the zero
fingerprint; texts with the same multiset of paragraphs have equal fingerprints; rows with equal ids are
neighbours ordered by text; null ids come first; an only document is its own neighbour; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.textblocks import U64, group_shingles, map_batches, mix, row_blocks, words
from orbitweave.operators.ordinal import MAX_RANGES, quantile_cuts, range_of

EQ_LANES, LIKE_LANES, GRAM = 64, 256, 3
_LANE = np.arange(1, EQ_LANES // 4 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)


def paragraph_sum(paragraphs: list[str]) -> np.ndarray:
    """The sum of the paragraphs' vectors: EQ_LANES + LIKE_LANES lanes modulo 2**16."""
    said = [p for p in paragraphs if p.strip()]
    equal, like = np.zeros(EQ_LANES, dtype=np.uint16), np.zeros(LIKE_LANES, dtype=np.int64)
    seeds = np.frombuffer(b"".join(hashlib.blake2b(p.encode(), digest_size=8).digest() for p in said), dtype=U64)
    for lo in range(0, len(seeds), 4096):
        equal += mix(seeds[lo : lo + 4096, None] + _LANE).view(np.uint16).sum(axis=0, dtype=np.uint16)
    column = pa.array(said, type=pa.large_string())
    for lo, hi in row_blocks(column):
        w = words(column.slice(lo, hi - lo))
        grams = group_shingles(w.hashes, np.asarray(w.first), GRAM)
        lanes = (grams & U64(LIKE_LANES - 1)).astype(np.int64)
        # Each trigram counts +1 or -1: twice the positive ones less all.
        like += 2 * np.bincount(lanes[grams >> U64(63) == 1], minlength=LIKE_LANES) - np.bincount(lanes, minlength=LIKE_LANES)
    return np.concatenate([equal, like.astype(np.uint16)])


def insert(fingerprint: np.ndarray, paragraphs: list[str]) -> np.ndarray:
    """Fingerprint after adding paragraphs."""
    return fingerprint + paragraph_sum(paragraphs)


def delete(fingerprint: np.ndarray, paragraphs: list[str]) -> np.ndarray:
    """Fingerprint after taking paragraphs away."""
    return fingerprint - paragraph_sum(paragraphs)


def fingerprint(text: str | None) -> np.ndarray:
    """Lanes of a whole text; a null text counts as empty."""
    return insert(np.zeros(EQ_LANES + LIKE_LANES, dtype=np.uint16), (text or "").split("\n"))


def encode(lanes: np.ndarray) -> str:
    return base64.b64encode(lanes.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, about 0 for texts without a common trigram; in between, 1 - |a - b|^2 / (|a|^2 + |b|^2)."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EQ_LANES:].view(np.int16).astype(np.float64) for v in (a, b))
    both = float(x @ x + y @ y)
    return 0.0 if both == 0 else float(min(1.0, max(0.0, 1.0 - float((x - y) @ (x - y)) / both)))


def edited(text: str, following: str) -> str:
    """The last quarter of the text (rounded down, code points) replaced by as many code points of the next one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def edited_lanes(own: np.ndarray, text: str, new: str) -> np.ndarray:
    """Fingerprint of the edited text from the original's: only paragraphs from the cut on are exchanged."""
    at = text.rfind("\n", 0, len(text) - len(text) // 4) + 1
    return insert(delete(own, text[at:].split("\n")), new[at:].split("\n"))


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (bucket, guest, doc_id, text): each is paired with the next of its bucket; a guest is only a next one."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    held = None
    rows: list[tuple] = []
    for batch in batches:
        buckets, guests, ids, texts = (batch.column(k).to_pylist() for k in range(4))
        for bucket, guest, doc_id, text in zip(buckets, guests, ids, texts, strict=True):
            text = text or ""
            lanes = fingerprint(text)
            if held is not None and held[0] == bucket:
                _, prior_id, prior, prior_lanes = held
                new = edited(prior, text)
                other = edited_lanes(prior_lanes, prior, new)
                rows.append((prior_id, len(prior), hashlib.sha256(new.encode()).hexdigest(), encode(prior_lanes), encode(other), likeness(prior_lanes, other), likeness(prior_lanes, lanes)))
            held = None if guest else (bucket, doc_id, text, lanes)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 2_000) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness and that to the next document by id.

    Ids are cut into ranges at approximate quantiles; each range also gets, as a guest, the first document
    of the next range (the last one that of the first), so one shuffle of the texts brings neighbours together."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.count()
    cuts = quantile_cuts(rows, "doc_id", min(MAX_RANGES, max(1, total // rows_per_bucket)))
    rows = rows.withColumn("bucket", range_of(F.col("doc_id"), cuts))
    first = rows.groupBy("bucket").agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()  # a row a bucket
    guest_of = [(r["first"], first[k - 1].bucket) for k, r in enumerate(first)]
    # Of rows that share the first id, the least text is the guest.
    guests = spark.createDataFrame(guest_of, "doc_id long, guest_bucket int")
    least = rows.join(F.broadcast(guests), "doc_id").groupBy("doc_id", "guest_bucket").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    both = rows.select("bucket", F.lit(False).alias("guest"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(
        least.select(F.col("guest_bucket").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text")
    )
    # Buckets are numbered, so each is its own task: a hash of the number would put several into one.
    dealt = both.repartitionById(len(cuts) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", "doc_id", "text")
    ids = F.when(F.col("doc_id") == F.lit(-(2**63)), F.lit(None).cast("long")).otherwise(F.col("doc_id"))
    return map_batches(dealt.select("bucket", "guest", "doc_id", "text"), _pairs, FINGERPRINTS).withColumn("doc_id", ids)
