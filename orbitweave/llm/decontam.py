"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts are cut into passages of up to ``WINDOW`` words. Their TF-IDF matrix (idf from all
document passages) is factored by a distributed randomised SVD; passages and document windows are folded
into the space of its leading right singular vectors, and windows whose cosine to a passage reaches
``COSINE`` are candidates. A candidate is confirmed by the longest common subsequence of words between
the passage and places of one and a half of its length in the window and its surroundings: nearly the whole
passage in order is a copy; at least ``PARAPHRASE`` of it is a paraphrase if the item's answer (its last
sentence, or quarter) is near too. So words that lie scattered over a longer stretch are no match.

The leading vectors hold little of a passage that shares few words with the others, so its cosine says
nothing, and a window dilutes a short passage. Every place that has enough of a passage's words is
therefore a candidate as well, whatever its cosine: of the words that a passage can do without and a few
more, rarest first, as many as those few must be there. This loses no place with ``PARAPHRASE`` of the
words close together, that is in a span of one and a quarter of the passage's length (and of some up to
one and a half); such candidates are confirmed within such a span. Their reported cosine may be small.

Of an item of more than ``WINDOW`` words an excerpt is a copy as well, wherever it begins: ``EXCERPT`` words
in order, among ``WINDOW`` of the document and ``WINDOW`` of the item. It is measured against stretches of
the item that reach ``MARGIN`` words beyond a passage on both sides, so each such excerpt lies in one.

Items of fewer than ``MIN_WORDS`` words have no passage: their words must stand in a row. From ``RUN`` words
on, or as a whole line, that is a copy; inside a line a shorter item is only a ``mention``, since such a
run of one to three words proves nothing.

The benchmark is the stated query set, taken in blocks of ``BLOCK_BYTES`` of text, so what is broadcast
is bounded; every window of every document meets every block. Texts are never shuffled. The work is two
passes over the documents for each block, so it grows in proportion to both.

Cases: letters A-Z are lower-cased; null or empty texts on either side match nothing; equal items are
reported each; of rows with equal ids one pair with the best match is reported; a null doc_id or item_id
stays null; a long text is searched whole, by blocks; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.textblocks import U64, Words, map_batches, row_blocks, shingles, words

WINDOW, HALF, MIN_WORDS, RUN = 64, 32, 8, 4
COSINE, COPY, PARAPHRASE, ANSWER = 0.45, 0.8, 0.6, 0.6
#: Words in order that make an excerpt of a longer item a copy, whatever their share of it.
EXCERPT, MARGIN = 50, HALF // 2
RANK, OVERSAMPLING, POWER_ROUNDS = 128, 8, 2
#: Benchmark text that is searched for at once: bounds the vocabulary and with it all that is broadcast.
BLOCK_BYTES = 1 << 19
#: Halves whose vectors are gathered at once, windows whose cosines are held at once, masks that are remembered.
HALVES, WINDOWS, MASKS = 256, 512, 1024


def item_passages(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, part, hashes, answer, stretch``: word hashes (64-bit, as bytes) of each passage, of the item's
    answer, and of the passage with its margins if the item is longer than a passage (else none). An item of
    fewer than ``MIN_WORDS`` words is one row of these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, passages, answers, stretches = [], [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(pa.array([text or ""])).hashes
                if not len(own):
                    continue
                if len(own) < MIN_WORDS:
                    ids.append(item), parts.append(0), passages.append(own.tobytes()), answers.append(b""), stretches.append(b"")
                    continue
                last = words(pa.array([(text or "").rstrip().rstrip(".!?").replace("!", ".").replace("?", ".").rpartition(".")[2]])).hashes
                answer = own[-max(3, len(last) if 3 <= len(last) <= len(own) // 2 else len(own) // 4) :]
                for part, at in enumerate(range(0, max(1, len(own) - HALF), HALF)):
                    ids.append(item)
                    parts.append(part)
                    passages.append(own[at : at + WINDOW].tobytes())
                    answers.append(answer.tobytes())
                    stretches.append(own[max(0, at - MARGIN) : at + WINDOW + MARGIN].tobytes() if len(own) > WINDOW else b"")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(passages, pa.binary()), pa.array(answers, pa.binary()), pa.array(stretches, pa.binary())], ["item_id", "part", "hashes", "answer", "stretch"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "item_id long, part int, hashes binary, answer binary, stretch binary")


class Vocabulary:
    """Places of word hashes among the sorted hashes of a benchmark block."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(hashes & U64(0xFFFFF)).astype(np.int64)] = True

    def find(self, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known words, their places)."""
        at = np.flatnonzero(self.maybe[(words_ & U64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, words_[at]), len(self.hashes) - 1)
        known = self.hashes[place] == words_[at]
        return at[known], place[known]


def _halves(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with words first[i]:first[i + 1]: where each half window begins, and its row."""
    n = np.diff(first)
    count = -(-n // HALF)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return first[row] + k * HALF, row


def _passage_frequencies(vocabulary: Vocabulary):
    """In how many document passages (two halves, not overlapping) each word of the vocabulary occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages = np.zeros(len(vocabulary.hashes) + 1, dtype=np.int64), 0
        for batch in batches:
            for lo, hi in row_blocks(batch.column(0)):
                w = words(batch.column(0).slice(lo, hi - lo))
                starts = _halves(w.first)[0]
                if not len(starts):
                    continue
                at, place = vocabulary.find(w.hashes)
                pair = np.unique((np.searchsorted(starts, at, side="right") - 1) // 2 * len(df) + place)
                df[:-1] += np.bincount(pair % len(df), minlength=len(df))[:-1]
                passages += (len(starts) + 1) // 2
        df[-1] = passages
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["place", "df"])

    return run


def _gram_product(vocabulary: Vocabulary, idf: np.ndarray, factor: np.ndarray):
    """Rows ``place, row``: this partition's part of A^T (A factor) for unit-length TF-IDF passages A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros_like(factor)
        for batch in batches:
            for hashes in batch.column(0):
                place, tf = np.unique(vocabulary.find(np.frombuffer(hashes.as_buffer(), dtype=U64))[1], return_counts=True)
                x = tf * idf[place]
                x /= np.sqrt(x @ x) or 1.0
                out[place] += x[:, None] * (x @ factor[place])[None, :]
        at = np.flatnonzero(np.abs(out).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(out[at]), pa.list_(pa.float64()))], ["place", "row"])

    return run


def randomised_svd(passages: DataFrame, vocabulary: Vocabulary, idf: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors (words x rank) of the passages' TF-IDF matrix.

    Range finder with power rounds: each round multiplies by A^T A on the executors; only matrices of
    (block vocabulary) x (rank + oversampling) come to the driver."""
    width = min(rank + OVERSAMPLING, len(vocabulary.hashes))
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(vocabulary.hashes), width)))[0]

    def times(factor: np.ndarray) -> np.ndarray:
        parts = map_batches(passages.select("hashes"), _gram_product(vocabulary, idf, factor), "place long, row array<double>")
        sums = parts.select("place", F.posexplode("row").alias("k", "x")).groupBy("place", "k").agg(F.sum("x").alias("x")).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("row"))
        out = np.zeros_like(factor)
        for r in sums.toLocalIterator():
            out[r.place] = [e.x for e in r.row]
        return out

    for _ in range(POWER_ROUNDS):
        q = np.linalg.qr(times(q))[0]
    small = q.T @ times(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(values)[::-1][:rank]
    return q @ vectors[:, keep[values[keep] > 1e-9]]


def lcs(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: masks has the places of each word in the first sequence."""
    full = (1 << size) - 1
    row = full
    for w in other:
        m = masks.get(w)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def word_masks(sequence: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(sequence):
        out[w] = out.get(w, 0) | (1 << k)
    return out


def _least(size: int, excerpts: bool) -> int:
    """Words of a passage that any match has; an excerpt may have ``MARGIN`` of its words outside."""
    least = next(k for k in range(size + 1) if k / size >= PARAPHRASE)
    return min(least, EXCERPT - MARGIN) if excerpts else least


def _span(size: int) -> int:
    """Words among which those of a passage must stand where the latent space says nothing."""
    return size + size // 2


class RareWords:
    """Places that may hold at least ``need`` words of a passage, found by the passages' rarest words.

    ``n - need`` words of ``n`` may be missing, so of any ``n - need + few`` words ``few`` are there."""

    def __init__(self, vocabulary: Vocabulary, df: np.ndarray, passages: Sequences, needs: list[int]):
        sizes = np.diff(passages.first)
        self.few = np.minimum(np.array(needs, dtype=np.int64), np.maximum(2, sizes // 8))
        #: Halves that a span may touch.
        self.reach = (sizes + sizes // 2 + HALF - 2) // HALF + 1
        posts = []
        for k, need in enumerate(needs):
            at = np.searchsorted(vocabulary.hashes, passages[k])
            rarest = at[np.lexsort((at, df[at]))][: len(at) - need + int(self.few[k])]
            place, weight = np.unique(rarest, return_counts=True)
            posts.append((place, np.full(len(place), k), weight))
        place, passage, weight = (np.concatenate([x[i] for x in posts]) for i in range(3))
        order = np.argsort(place, kind="stable")
        self.passage, self.weight = passage[order], weight[order]
        self.first = np.searchsorted(place[order], np.arange(len(vocabulary.hashes) + 1))

    def candidates(self, half: np.ndarray, place: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first half, passage), given the known words' halves and places, and each half's row."""
        n = len(self.few)
        pair = np.unique(half * len(self.first) + place)
        half, place = pair // len(self.first), pair % len(self.first)
        count = self.first[place + 1] - self.first[place]
        keys, sums = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        ends = np.cumsum(count)
        a = 0
        while a < len(count):  # some postings at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), side="right")))
            c = count[a:b]
            post = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.first[place[a:b]], c)
            key, inverse = np.unique(np.repeat(half[a:b], c) * n + self.passage[post], return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(inverse, self.weight[post], len(key)).astype(np.int64))
            a = b
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.bincount(inverse, np.concatenate(sums), len(key)).astype(np.int64)
        if not len(key):
            return
        h, p = key // n, key % n
        total = own.copy()
        for step in range(1, int(self.reach.max())):
            at = np.minimum(np.searchsorted(key, key + step * n), len(key) - 1)
            here = (key[at] == key + step * n) & (step < self.reach[p])
            here &= row[np.minimum(h + step, len(row) - 1)] == row[h]
            total += np.where(here, own[at], 0)
        good = np.flatnonzero(total >= self.few[p])
        yield from zip(h[good].tolist(), p[good].tolist(), strict=True)


@dataclass
class Sequences:
    """Word hashes of many sequences in one array."""

    hashes: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(parts: list[bytes]) -> Sequences:
        return Sequences(np.frombuffer(b"".join(parts), dtype=U64), np.r_[0, np.cumsum([len(p) // 8 for p in parts])].astype(np.int64))

    def __len__(self) -> int:
        return len(self.first) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]

    def size(self, k: int) -> int:
        return int(self.first[k + 1] - self.first[k])


class ShortItems:
    """Items of fewer than ``MIN_WORDS`` words, by their number of words and the hash of the run."""

    def __init__(self, ids: list, runs: Sequences):
        self.by_size: dict[int, tuple[np.ndarray, list]] = {}
        for size in sorted({runs.size(k) for k in range(len(runs))}):
            own = [(int(shingles(runs[k], size)[0]), ids[k]) for k in range(len(runs)) if runs.size(k) == size]
            own.sort(key=lambda x: x[0])
            self.by_size[size] = np.array([h for h, _ in own], dtype=U64), [i for _, i in own]

    def find(self, w: Words) -> Iterator[tuple[int, object, int]]:
        """(row, item, 2 for a copy or 1 for a mention) for every run of a short item's words."""
        for size, (known, ids) in self.by_size.items():
            if len(w.hashes) < size:
                continue
            runs = shingles(w.hashes, size)
            lo = np.searchsorted(known, runs)
            at = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == runs)
            row = np.searchsorted(w.first, at, side="right") - 1
            inside = at + size <= w.first[row + 1]
            at, row = at[inside], row[inside]
            feeds = np.flatnonzero(w.data == 10)
            before = np.searchsorted(feeds, w.starts[at])  # line feeds up to the run, and up to the word before it
            opens = (at == w.first[row]) | (before > np.searchsorted(feeds, w.ends[np.maximum(at - 1, 0)]))
            after = np.searchsorted(feeds, w.ends[at + size - 1])
            closes = (at + size == w.first[row + 1]) | (np.searchsorted(feeds, w.starts[np.minimum(at + size, len(w.starts) - 1)]) > after)
            sure = opens & closes | (size >= RUN)
            for x, doc, copy in zip(at.tolist(), row.tolist(), sure.tolist(), strict=True):
                for k in range(int(lo[x]), int(np.searchsorted(known, runs[x], side="right"))):
                    yield doc, ids[k], 1 + copy


MATCHES = "doc_id long, item_id long, cosine double, coverage double, answer double, excerpt int, short int"


@dataclass
class Index:
    """What a task needs of a benchmark block: all of a size that follows ``BLOCK_BYTES``."""

    ids: list
    passages: Sequences
    answers: Sequences
    stretches: Sequences
    vocabulary: Vocabulary
    fold_in: np.ndarray
    latent: np.ndarray
    rare: RareWords | None
    shorts: ShortItems


def _search(index: Index):
    """Every window of every text against every passage: cosine or rare words, then subsequence and answer checks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, vocabulary, fold_in, latent = index.passages, index.vocabulary, index.fold_in, index.latent
        masks = lru_cache(MASKS)(lambda of, p: word_masks(getattr(index, of)[p].tolist()))

        def judge(p: int, region: list[int]) -> tuple[float, float] | None:
            """(coverage within a span, answer within the region) of the best place, if it is a match."""
            size = passages.size(p)
            if lcs(masks("passages", p), size, region) / size < PARAPHRASE:
                return None
            span, step = _span(size), max(1, size // 4)
            coverage = max(lcs(masks("passages", p), size, region[at : at + span]) for at in range(0, max(1, len(region) - span + step), step)) / size
            if coverage < PARAPHRASE:
                return None
            answer = lcs(masks("answers", p), index.answers.size(p), region) / index.answers.size(p)
            return (coverage, answer) if coverage >= COPY or answer >= ANSWER else None

        def matches(w: Words) -> Iterator[tuple]:
            """(row, passage, coverage, answer, cosine, words of an excerpt)."""
            starts, row = _halves(w.first)
            at, place = vocabulary.find(w.hashes)
            if not len(at):
                return
            half = np.searchsorted(starts, at, side="right") - 1
            change = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
            sums = np.zeros((len(starts) + 1, fold_in.shape[1]), dtype=np.float32)
            for a in range(0, len(change), HALVES):
                some = change[a : a + HALVES]
                end = change[a + HALVES] if a + HALVES < len(change) else len(at)
                sums[half[some]] = np.add.reduceat(fold_in[place[some[0] : end]], some - some[0], axis=0)
            follows = np.r_[row[1:] == row[:-1], False]
            window = sums[:-1] + np.where(follows[:, None], sums[1:], np.float32(0))
            del sums
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            excerpts: dict[tuple[int, int], tuple[int, float]] = {}
            for a in range(0, len(window), WINDOWS):
                cosine = window[a : a + WINDOWS] @ latent.T
                hit_w, hit_p = np.nonzero(cosine >= COSINE * np.maximum(norm[a : a + WINDOWS, None], 1e-12))
                for x, p in zip((hit_w + a).tolist(), hit_p.tolist(), strict=True):
                    size, doc = passages.size(p), int(row[x])
                    b, e = max(int(w.first[doc]), int(starts[x]) - size), min(int(w.first[doc + 1]), int(starts[x]) + WINDOW + size)
                    match = judge(p, w.hashes[b:e].tolist())
                    if match:
                        best = (*match, float(cosine[x - a, p] / norm[x]))
                        found[doc, p] = max(found.get((doc, p), best), best)
            for x, p in index.rare.candidates(half, place, row):
                doc, span, long = int(row[x]), _span(passages.size(p)), index.stretches.size(p)
                if found.get((doc, p), (0.0,))[0] == 1.0:
                    continue
                # A match may begin before the half of its first counted word.
                b, e = max(int(w.first[doc]), int(starts[x]) - span), min(int(w.first[doc + 1]), int(starts[x]) + HALF + span)
                region = w.hashes[b:e].tolist()
                near = float(window[x] @ latent[p] / max(norm[x], 1e-12))
                if long >= EXCERPT and lcs(masks("stretches", p), long, region) >= EXCERPT:
                    # The counted words lie in the passage; the excerpt may reach beyond the span.
                    b, e = max(int(w.first[doc]), int(starts[x]) - WINDOW), min(int(w.first[doc + 1]), int(starts[x]) + HALF + WINDOW)
                    most = max(lcs(masks("stretches", p), long, w.hashes[y : min(y + WINDOW, e)].tolist()) for y in range(b, max(b + 1, e - EXCERPT + 1)))
                    if most >= EXCERPT:
                        excerpts[doc, p] = max(excerpts.get((doc, p), (0, 0.0)), (most, near))
                match = judge(p, region)
                if match:
                    found[doc, p] = max(found.get((doc, p), (0.0, 0.0, 0.0)), (*match, near))
            for (doc, p), best in found.items():
                yield doc, p, *best, excerpts.get((doc, p), (0,))[0]
            for (doc, p), (most, near) in excerpts.items():
                if (doc, p) not in found:
                    yield doc, p, min(1.0, most / passages.size(p)), 0.0, near, most

        for batch in batches:
            rows: list[tuple] = []
            for lo, hi in row_blocks(batch.column(1)):
                w = words(batch.column(1).slice(lo, hi - lo))
                if len(passages):
                    rows += [(lo + doc, index.ids[p], cosine, coverage, answer, excerpt, 0) for doc, p, coverage, answer, cosine, excerpt in matches(w)]
                rows += [(lo + doc, item, None, 1.0, 1.0, 0, short) for doc, item, short in index.shorts.find(w)]
            ids = batch.column(0)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
            columns = [ids.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(1, 7))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "cosine", "coverage", "answer", "excerpt", "short"])

    return run


def _index(own: DataFrame, texts: DataFrame) -> Index | None:
    """The index of a benchmark block, from its passages and the document frequencies of their words."""
    known = own.select("item_id", "hashes", "answer", "stretch").collect()  # about BLOCK_BYTES of text
    if not known:
        return None
    long, short = [r for r in known if len(r.hashes) >= 8 * MIN_WORDS], [r for r in known if len(r.hashes) < 8 * MIN_WORDS]
    passages, answers, stretches = (Sequences.of([bytes(r[c]) for r in long]) for c in ("hashes", "answer", "stretch"))
    shorts = ShortItems([r.item_id for r in short], Sequences.of([bytes(r.hashes) for r in short]))
    vocabulary = Vocabulary(np.unique(passages.hashes))
    fold_in, latent, rare = np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0), dtype=np.float32), None
    if long:
        df = np.zeros(len(vocabulary.hashes) + 1)
        for r in map_batches(texts, _passage_frequencies(vocabulary), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toLocalIterator():
            df[r.place] = r.df
        idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 0.01
        vectors = randomised_svd(own.where(F.octet_length("hashes") >= 8 * MIN_WORDS), vocabulary, idf, RANK)
        fold_in = (idf[:, None] * vectors).astype(np.float32)
        latent = np.zeros((len(passages), fold_in.shape[1]), dtype=np.float32)
        for k in range(len(passages)):
            place, tf = np.unique(vocabulary.find(passages[k])[1], return_counts=True)
            v = tf @ fold_in[place]
            latent[k] = v / (np.sqrt(v @ v) or 1.0)
        rare = RareWords(vocabulary, df, passages, [_least(passages.size(k), stretches.size(k) > 0) for k in range(len(passages))])
    return Index([r.item_id for r in long], passages, answers, stretches, vocabulary, fold_in, latent, rare, shorts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, cosine, coverage, answer, kind`` for every document that holds a benchmark text.

    ``kind`` is ``copy``, ``paraphrase``, or ``mention`` for an item of one to three words inside a line; the
    cosine of items of fewer than ``MIN_WORDS`` words is null."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = benchmark.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    leaks = spark.createDataFrame([], MATCHES)
    for block in range(blocks):
        index = _index(item_passages(benchmark.where(F.pmod(F.xxhash64(item_col, item_text_col), F.lit(blocks)) == block), item_col, item_text_col), texts)
        if index:
            leaks = leaks.unionByName(map_batches(rows, _search(index), MATCHES))
    best = F.max(F.struct("coverage", "answer", "cosine")).alias("best")
    kind = F.when(F.col("short") == 1, "mention").when((F.col("best.coverage") >= COPY) | (F.col("excerpt") >= EXCERPT), "copy").otherwise("paraphrase")
    return leaks.groupBy("doc_id", "item_id").agg(best, F.max("excerpt").alias("excerpt"), F.max("short").alias("short")).select("doc_id", "item_id", "best.cosine", "best.coverage", "best.answer", kind.alias("kind"))
