"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A text's features are its words (runs without white space, as they are written), the runs of 3 to 5 code
points of each word between two boundary marks, and one for each word that stands there again right after
itself, hashed to ``BUCKETS`` rows of ``DIM`` learned numbers. The average of the rows of all features goes through a linear layer and a softmax. Rows and layer are trained in
numpy by stochastic gradient descent with a falling rate, on a bounded sample of labelled documents: at most
``SAMPLE`` of them, chosen by a hash of id and text. Whole texts are learned from and scored.

Averaging and layer are linear, so a text's score needs of each row only its product with the layer: scoring
adds up one number a feature, which is the same sum in another order. ``Model.embed`` gives the averages.

Cases: a null or empty text, or one of white space only, gets the score of the output's bias alone, and so
does every text if nothing is labelled; a null label or id is never learned from; of several labels of a
document the mean counts, 1 from a half on; equal texts are scored alike; a word of ``CHUNK`` code points
without white space is cut there; an empty table gives an empty result; extra columns are kept, but the score
columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitweave.llm.textblocks import bound_batches, give_back, map_batches

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIM = 10
#: Code points of the runs inside words.
GRAMS = (3, 4, 5)
#: Bucket of the feature that a word repeats the one before it.
AGAIN = 0
#: Bound of the training sample, in documents.
SAMPLE = 3000
#: Code points handled at once.
CHUNK = 1 << 16
#: Score from which a document is predicted to be of label 1.
THRESHOLD = 0.3

_K = np.uint32(0x9E3779B1)
_SPACES = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint32)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKET_BITS)


def pieces(text: str | None) -> Iterator[str]:
    """The text in parts of at most ``CHUNK`` code points, cut after white space where there is some."""
    at, text = 0, text or ""
    while len(text) - at > CHUNK:
        cut = max(text.rfind(c, at, at + CHUNK) for c in " \t\n\v\f\r") + 1
        cut = cut if cut > at else at + CHUNK
        yield text[at:cut]
        at = cut
    yield text[at:]


def features(text: str) -> np.ndarray:
    """Buckets of all features of a part of a text, in no stated order and as often as they occur."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    c = np.full(len(code) + 2, 32, dtype=np.uint32)
    c[1:-1] = np.where((code == 32) | ((code >= 9) & (code <= 13)), np.uint32(32), code)
    space = c == 32
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(starts):
        return np.empty(0, dtype=np.uint32)
    # A word's hash is the sum of its code points times powers of a constant by their place in it.
    place = np.arange(len(c)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(c)]])))
    powers = np.full(int((ends - starts).max()) + 1, _K, dtype=np.uint32).cumprod(dtype=np.uint32)
    placed = np.where(space, np.uint32(0), c * powers[np.minimum(place, len(powers) - 1)])
    words = _hash(np.add.reduceat(placed, starts, dtype=np.uint32))
    again = np.full(int((words[1:] == words[:-1]).sum()), AGAIN, dtype=np.uint32)
    found = [words, again]
    run, inner = c.copy(), np.zeros(len(c), dtype=bool)  # inner: a run from here on has white space inside
    for n in range(2, max(GRAMS) + 1):
        if len(c) < n:
            break
        if n > 2:
            inner = inner[:-1] | space[n - 2 : len(c) - 1]
        else:
            inner = inner[:-1]
        run = run[:-1] * _K + c[n - 1 :]
        if n in GRAMS:
            found.append(_hash(run[~inner] + np.uint32(n)))
    return np.concatenate(found)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of a whole text, in rising order, and how often each occurs."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for piece in pieces(text):
        counts += np.bincount(features(piece), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIM
    layer: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def embed(self, text: str | None) -> np.ndarray:
        """The average of the vectors of all features; zeros without any."""
        at, counts = counted(text)
        return counts @ self.vectors[at] / counts.sum() if len(at) else np.zeros(self.vectors.shape[1])

    def projected(self) -> tuple[np.ndarray, float]:
        """For each bucket, and for the bias, how far it moves the odds of label 1."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train_sgd(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], *, dim: int = DIM, rate: float = 2.0, pull: float = 0.1, epochs: int = 5, seed: int = 0) -> Model:
    """Vectors, layer and bias by stochastic gradient descent on the log loss; ``rows`` are buckets and counts.

    An average of thousands of vectors has a gradient of thousandths for each: the step of the vectors is divided
    by the squared length of the document's shares, so that its average moves by ``pull`` of the rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    shares = [(c / max(1, c.sum())).astype(np.float32) for _, c in rows]
    done, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, share = rows[k][0], shares[k]
            hidden = share @ vectors[at]
            error = softmax(hidden @ layer + bias)
            error[labels[k]] -= 1.0
            r = np.float32(rate * (1.0 - done / total))
            back = layer @ error
            layer -= r * np.outer(hidden, error)
            bias -= np.float32(pull) * r * error
            if len(at):
                vectors[at] -= np.outer(share * (np.float32(pull / 2) * r / (share @ share)), back)
            done += 1
    return Model(vectors, layer, bias)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counted(t.as_py()) for t in batch.column(2)]
        packed = [pa.array([x[k].astype(np.int32).tobytes() for x in found], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["draw", "label", "at", "counts"])


def train(learn: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the rows of ``learn`` that have a label in ``labels``; of these at most ``sample``, by the least hashes."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.avg("label").alias("label"))
    draw = F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw")
    # Texts stay where they are: only ids and hashes meet the labels, and the few hashes that are chosen the texts.
    drawn = learn.select(F.col(id_col).alias("id"), draw).join(marked, "id").select("draw", (F.col("label") >= 0.5).cast("int").alias("label"))
    least = drawn.groupBy("draw").agg(F.max("label").alias("label")).orderBy("draw").limit(sample).collect()
    if not least:
        return Model(np.zeros((BUCKETS, DIM), dtype=np.float32), np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32))
    picked = learn.sparkSession.createDataFrame([(r.draw, r.label) for r in least], "draw long, label int")
    texts = learn.select(draw, F.col(text_col).alias("text")).where(F.col("draw") <= least[-1].draw).join(F.broadcast(picked), "draw").select("draw", "label", "text")
    found = sorted(map_batches(texts, _sample_features, "draw long, label int, at binary, counts binary").dropDuplicates(["draw"]).collect(), key=lambda r: r.draw)
    data = [(np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["counts"], dtype=np.int32)) for r in found]
    return train_sgd(data, [r.label for r in found])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the probability of label 1, from the text alone; only the texts go to Python."""
    table, bias = model.projected()

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in texts:
                odds = np.empty(len(column))
                for k, text in enumerate(column):
                    total, n = 0.0, 0
                    for piece in pieces(text.as_py()):
                        at = features(piece)
                        total, n = total + float(table[at].sum(dtype=np.float64)), n + len(at)
                    odds[k] = bias + (total / n if n else 0.0)
                yield pa.array(1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700))), pa.float64())
        finally:
            give_back()

    bound_batches(docs.sparkSession)
    judge.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(score_col, F.arrow_udf(judge, T.DoubleType())(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents that are never learned from; also for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents, by a model of those that aren't held out."""
    model = train(docs.where(~held_out()), labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
