"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased letters (anything else is a space) give 1- to 3-grams, hashed to ``DIM`` features with weight
(1 + log tf) * idf and unit length. Document frequencies cover every learnable document. The weights are
trained with follow-the-regularised-leader (proximal, per coordinate, elastic net) on a bounded sample of
labelled documents: at most about ``PER_LANG`` of each language, chosen by a hash of the id. One fifth of
that sample is kept back to fit the softmax temperature.

Cases: a null text or one without a letter is ``und`` with score 0; so is every text if nothing is
labelled; a null lang is never learned from, nor is one that isn't among the ``MAX_LANGS`` with the most rows; equal texts get equal predictions; repeated rows are
predicted alike; an empty table gives an empty result; columns ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitweave.llm.textblocks import bound_batches, give_back, map_batches

DIM_BITS = 14
DIM = 1 << DIM_BITS
#: Bound of the training sample: documents of each language (the hash may bring a few per cent more).
PER_LANG = 500
#: Languages that are learned at most: those with the most rows, and of equal ones the first by name.
MAX_LANGS = 100
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for the code points of letters."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids in rising order and how often each occurs; none without a letter."""
    none = np.empty(0, dtype=np.int64)
    if not text:
        return none, none
    table = _letters()
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = table[code]
    if not letter.any():
        return none, none
    c = np.full(len(code) + 2, 32, dtype=np.uint32)
    c[1:-1][letter] = code[letter]
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    shift, k = np.uint32(32 - DIM_BITS), np.uint32(0xC2B2AE35)
    spaces = c[:-1] + c[1:] == 64
    ids = np.concatenate([(c[c != 32] * k) >> shift, ((two[~spaces] ^ (two[~spaces] >> np.uint32(15))) * k) >> shift, ((three ^ (three >> np.uint32(13))) * k) >> shift])
    counts = np.bincount(ids, minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1.0 + np.log(counts)) * self.idf[at]
        return v / np.sqrt(v @ v)

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = features(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax((self.vector(at, counts) @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM x classes, zeros where the l1 part wins) and bias by per-coordinate FTRL-proximal."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weight(at: np.ndarray) -> np.ndarray:
        penalty = np.where(at == DIM, 0.0, l1)[:, None]
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty, 0.0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x = np.append(rows[k][0], DIM), np.append(rows[k][1], 1.0)
            w = weight(at)
            error = softmax(x @ w)
            error[labels[k]] -= 1.0
            g = x[:, None] * error[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weight(np.arange(DIM + 1))
    return w[:DIM].astype(np.float32), w[DIM].astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least mean log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()
    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(DIM + 1, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            df[features(text)[0]] += 1
            docs += 1
    if docs:
        df[DIM] = docs
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "df"])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())],
            ["lang", "draw", "at", "counts"],
        )


def train(learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Fit idf on all rows of ``learn`` and the classifier on its bounded, labelled sample."""
    learn = learn.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    frequencies = map_batches(learn.select("text"), _document_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()  # DIM + 1 rows at most
    df = np.zeros(DIM + 1)
    for r in frequencies:
        df[r.feature] = r.df
    idf = np.log((1.0 + df[DIM]) / (1.0 + df[:DIM])) + 1.0
    sizes = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not sizes:
        return Model([], idf, np.zeros((DIM, 0)), np.zeros(0), 1.0)
    scale = 1 << 30
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(int(min(1.0, per_lang / r["count"]) * scale)))]), F.col("lang"))
    draw = F.xxhash64(F.lit("sample"), "id")
    sample = learn.select("lang", draw.alias("draw"), "text").where(F.pmod("draw", F.lit(scale)) < share)
    rows = sorted(map_batches(sample, _sample_features, "lang string, draw long, at binary, counts binary").collect(), key=lambda r: (r.draw, r.lang, r["at"]))
    langs = sorted({r.lang for r in sizes})
    model = Model(langs, idf, np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32), 1.0)
    data = []
    for r in rows:
        at = np.frombuffer(r["at"], dtype=np.int32).astype(np.int64)
        if len(at):
            data.append((at, model.vector(at, np.frombuffer(r["counts"], dtype=np.int32)), langs.index(r.lang)))
    fit, kept = [d for k, d in enumerate(data) if k % 5], [d for k, d in enumerate(data) if k % 5 == 0]
    model.weights, model.bias = train_ftrl([d[:2] for d in fit], [d[2] for d in fit], len(langs))
    logits = np.array([x @ model.weights[at] + model.bias for at, x, _ in kept]).reshape(len(kept), len(langs))
    model.temperature = fit_temperature(logits, np.array([d[2] for d in kept], dtype=np.int64))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (or columns of other names) from the text alone; only the texts go to Python."""
    judged = "__judged"
    while judged in docs.columns:
        judged += "_"

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in texts:
                found = [model.predict(t) for lo in range(0, len(column), 512) for t in column.slice(lo, 512).to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["pred", "score"])
        finally:
            give_back()

    bound_batches(docs.sparkSession)
    judge.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(judge, T.StructType([T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return docs.drop(pred_col, score_col).withColumn(judged, found(F.col(text_col))).withColumns({pred_col: F.col(f"`{judged}`.pred"), score_col: F.col(f"`{judged}`.score")}).drop(judged)


def held_out(id_col: str = "doc_id"):
    """True for the documents that are never learned from; also for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))
