"""Language-model scoring by deleted interpolation.

Bigram, unigram and uniform maximum-likelihood estimates are mixed; the mixture weights depend on the
frequency bucket of the context and are learned by expectation-maximisation on held-out counts: one fold
of the training documents is deleted from the counts and its tokens are predicted by the rest.

Counting and looking up is an exchange of requests and answers. Documents are gathered in blocks of some
MB of text; a block sends each distinct n-gram once, with its counts, to the partition of its hash, and
gets the corpus totals back in the same order. So the shuffled bytes follow the distinct n-grams of
blocks, not the tokens, no vocabulary is broadcast, and frequent words cost one entry a block.

A block sends a row to each partition, so rows would grow with the square of the corpus. From ``FAN``
partitions on the exchange therefore takes several steps, as a radix sort does: blocks send to at most
``FAN`` bins, the rows of some blocks in a bin are added up, and the sums go on as a block would, to the next
digit of the hash; answers come back the same way. A row keeps some thousand n-grams at any size, and rows
grow with the corpus times the number of steps (2 up to 0.5 TB of text, 3 up to 100 TB).

Cases: a null text counts as empty, whose only token is the end; a null id is never learned from and
counts as held out; repeated rows are counted and scored each; without training documents every score is
that of the uniform model; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.storage import materialise
from orbitweave.llm.textblocks import U64, crc_mod, map_batches, mix, row_blocks, words

FOLDS, HELD_OUT, DELETED = 7, 2, 5
END = np.array([0x656E642D6F662D74], dtype=U64)
#: Text bytes of a block, and distinct n-grams that a partition of requests is meant for.
BLOCK_TEXT, PART_KEYS = 8 << 20, 1_000_000
#: Bins to which one block or sum sends rows at most.
FAN = 256
#: Grid of the held-out table: steps an octave, octaves, and context-frequency buckets.
STEPS, OCTAVES, BUCKETS = 4, 48, 40
_LEVELS = STEPS * OCTAVES + 1


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as byte planes, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays)]
    head = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _blocks(block_text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        tokens: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            lens = np.concatenate(lengths)
            distinct, index = np.unique(np.concatenate(tokens), return_inverse=True)
            missing = np.array([i is None for i in ids])
            payload = pack(np.array([i or 0 for i in ids], dtype=np.int64), missing, crc_mod(ids, FOLDS), lens, distinct, index.astype(np.int32))
            block = (task << 24) | made
            made += 1
            held = 0
            ids.clear(), tokens.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([payload], pa.binary())], ["block", "payload"])

        for batch in batches:
            texts = batch.column(1)
            for lo, hi in row_blocks(texts):
                w = words(texts.slice(lo, hi - lo))
                n = np.diff(w.first)
                flat = np.insert(w.hashes, w.first[1:], END[0])  # an end after the words of each row
                tokens.append(flat)
                lengths.append(n + 1)
                ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                held += len(w.data) + 16 * (hi - lo)
                if held >= block_text:
                    yield flush()
        if ids:
            yield flush()

    return run


class Block:
    """A block's documents and distinct n-grams, in the order in which totals are asked for."""

    def __init__(self, payload: bytes, fan: int):
        self.ids, self.missing, self.fold, self.lens, self.unigrams, index = unpack(payload)
        index = index.astype(np.int64)
        first = np.cumsum(self.lens) - self.lens
        end = int(np.searchsorted(self.unigrams, END[0]))
        before = np.empty_like(index)
        before[1:] = index[:-1]
        before[first] = end  # the end of one document begins the next
        n = len(self.unigrams)
        pairs, self.token_pair = np.unique(before * n + index, return_inverse=True)
        self.context, self.word = pairs // n, pairs % n
        self.token_word = index
        fold = np.repeat(self.fold, self.lens)
        self.train = (fold != HELD_OUT) & (fold >= 0)
        self.deleted = fold == DELETED
        self.keys = [self.unigrams, mix(self.unigrams[self.context] * U64(0x9E3779B97F4A7C15) + mix(self.unigrams[self.word]))]
        self.order = [np.lexsort((k, bin_of(k, fan))) for k in self.keys]

    def requests(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for level, (keys, token) in enumerate(zip(self.keys, (self.token_word, self.token_pair), strict=True)):
            train, deleted = (np.bincount(token[m], minlength=len(keys)) for m in (self.train, self.deleted))
            o = self.order[level]
            yield level, keys[o], train[o].astype(np.int64), deleted[o].astype(np.int64)

    def totals(self, level: int, answers: list[np.ndarray]) -> np.ndarray:
        """Answers, part after part, in the order of this block's n-grams."""
        out = np.empty(len(self.keys[level]), dtype=np.int64)
        out[self.order[level]] = np.concatenate(answers)
        return out


def bin_of(keys: np.ndarray, bins: int) -> np.ndarray:
    return (keys >> U64(20)) % U64(bins)


def _sent(level: int, source: int, bins: int, keys: np.ndarray, train: np.ndarray, deleted: np.ndarray) -> pa.RecordBatch:
    """A row for each bin of n-grams that are ordered by bin and key."""
    part = bin_of(keys, bins)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part[:0].astype(np.int64)
    ends = np.r_[starts[1:], len(part)]
    rows = [pack(np.diff(keys[a:b], prepend=U64(0)), train[a:b], deleted[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return _answers(level, part[starts].astype(np.int64), [source] * len(rows), rows)


def _answers(level: int, parts, sources: list[int], rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([level] * len(rows), pa.int32()), pa.array(parts, pa.int64()), pa.array(sources, pa.int64()), pa.array(rows, pa.binary())], ["level", "part", "block", "payload"])


def _ask(fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for level, keys, train, deleted in Block(payload, fan).requests():
                    yield _sent(level, block, fan, keys, train.astype(np.int32), deleted.astype(np.int32))

    return run


def _by_key(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come ordered by their first ``columns`` values: each key with the rest of its rows."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:columns] != at:
                if rows:
                    yield at, rows
                at, rows = row[:columns], []
            rows.append(row[columns:])
    if rows:
        yield at, rows


def _added(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct n-grams of requests with the sums of both counts, and the places of each request's n-grams."""
    opened = [unpack(p) for p in payloads]
    sizes = np.cumsum([len(x[0]) for x in opened])[:-1]
    distinct, index = np.unique(np.concatenate([np.cumsum(x[0], dtype=U64) for x in opened]), return_inverse=True)
    train, deleted = (np.bincount(index, weights=np.concatenate([x[k] for x in opened]), minlength=len(distinct)).astype(np.int64) for k in (1, 2))
    return distinct, train, deleted, np.split(index, sizes)


def _merge(bins: int):
    """Requests by (level, part, group): their sum as requests to finer bins, and the places of each request in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tagged(rows: pa.RecordBatch, group: int, what: str) -> pa.RecordBatch:
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array([group] * n, pa.int64()), pa.array([what] * n)], [*rows.schema.names, "group", "what"])

        for (level, part, group), asked in _by_key(batches, 3):
            distinct, train, deleted, index = _added([p for _, p in asked])
            order = np.lexsort((distinct, bin_of(distinct, bins)))
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            yield tagged(_sent(level, group, bins, distinct[order], train[order], deleted[order]), group, "sum")
            yield tagged(_answers(level, [part] * len(asked), [b for b, _ in asked], [pack(place[i].astype(np.int32)) for i in index]), group, "place")

    return run


ANSWERS = "level int, part long, block long, payload binary"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests by (level, part): adds them up and answers each in the order it asked; the sums of both counts and
    of their distinct n-grams go in the last columns of a row of block -1."""

    def counted(rows: pa.RecordBatch, stats: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([x] * rows.num_rows, pa.int64()) for x in stats)], [*rows.schema.names, *STATS])

    for (level, part), asked in _by_key(batches, 2):
        _, train, deleted, index = _added([p for _, p in asked])
        left = train - deleted
        yield counted(_answers(level, [part], [-1], [b""]), [int(train.sum()), int((train > 0).sum()), int(left.sum()), int((left > 0).sum())])
        for lo in range(0, len(asked), 64):
            some = range(lo, min(lo + 64, len(asked)))
            yield counted(_answers(level, [part] * len(some), [asked[k][0] for k in some], [pack(train[index[k]], deleted[index[k]]) for k in some]), [None] * 4)


STATS = ["n", "v", "n_left", "v_left"]


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (level, part, group), the answers to a sum before the places of what was added up: answers to the latter."""
    for (level, part, _), rows in _by_key(batches, 3):
        answers = [unpack(p) for block, p in rows if block == -1]
        train, deleted = (np.concatenate([x[k] for x in answers]) for k in (0, 1))
        for block, p in rows:
            if block != -1:
                place = unpack(p)[0]
                yield _answers(level, [part], [block], [pack(train[place], deleted[place])])


def exchange(asked: DataFrame, parts: int, fan: int, steps: int) -> tuple[DataFrame, DataFrame]:
    """Answers to requests (``level, part, block, payload``), and the table with the corpus' sums in its ``STATS``."""
    key, places = ["level", "part", "group"], []
    for step in range(1, steps):
        groups = max(1, -(-parts // fan**step))
        dealt = asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).repartition(parts, *key).sortWithinPartitions(*key, "block")
        merged = materialise(map_batches(dealt.select(*key, "block", "payload"), _merge(fan ** (step + 1)), f"{ANSWERS}, group long, what string"), "lm-sums", "what")
        places.append(merged.where("what = 'place'"))
        asked = merged.where("what = 'sum'").select("level", "part", "block", "payload")
    dealt = asked.repartition(parts, "level", "part").sortWithinPartitions("level", "part", "block")
    sums = materialise(map_batches(dealt, _answer, f"{ANSWERS}, " + ", ".join(f"{s} long" for s in STATS)), "lm-answers")
    answers = sums.where("block >= 0").select("level", "part", "block", "payload")
    for step in range(steps - 1, 0, -1):
        back = answers.select("level", F.pmod("part", F.lit(fan**step)).alias("part"), F.col("block").alias("group"), F.lit(-1).cast("long").alias("block"), F.col("part").alias("of"), "payload")
        both = back.unionByName(places.pop().select(*key, "block", F.lit(0).cast("long").alias("of"), "payload"))
        dealt = both.repartition(parts, *key).sortWithinPartitions(*key, "block", "of")
        answers = map_batches(dealt.select(*key, "block", "payload"), _hand_down, ANSWERS)
    return answers, sums


def _matched():
    """Rows by (block, level, part), the block itself at level -1: blocks together with the totals of their n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(block: int, payload: bytes, answers: list) -> pa.RecordBatch:
            totals = [[np.concatenate([x[k] for lv, x in answers if lv == level]) for k in (0, 1)] for level in (0, 1)]
            row = [block, payload, *(pack(*t) for t in totals)]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([p], pa.binary()) for p in row[1:])], ["block", "payload", "unigrams", "bigrams"])

        now, payload, answers = None, b"", []
        for batch in batches:
            for level, _, block, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if level == -1:
                    if now is not None:
                        yield close(now, payload, answers)
                    now, payload, answers = block, data, []
                else:
                    answers.append((level, unpack(data)))
        if now is not None:
            yield close(now, payload, answers)

    return run


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole octaves of its frequency."""
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, v: int) -> np.ndarray:
    """Bigram, unigram and uniform maximum-likelihood estimates, one column each."""
    return np.stack([pair / np.maximum(context, 1), word / max(n, 1), np.full(len(pair), 1.0 / (v + 1))], axis=1)


def _held_out_table(fan: int, n: int, v: int):
    """How many deleted tokens fall in each cell (bucket, bigram estimate, unigram estimate) of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(BUCKETS * _LEVELS * _LEVELS, dtype=np.int64)
        for batch in batches:
            for payload, one, two in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                block = Block(payload, fan)
                left1, left2 = (block.totals(k, [np.subtract(*unpack(x))]) for k, x in enumerate((one, two)))
                weight = np.bincount(block.token_pair[block.deleted], minlength=len(left2))
                at = np.flatnonzero(weight)
                context = left1[block.context[at]]
                p = estimates(left2[at], context, left1[block.word[at]], n, v)
                grid = [np.where(p[:, k] > 0, np.clip(np.rint(STEPS * np.log2(np.maximum(p[:, k], 1e-300) / p[:, 2])) + 1, 1, _LEVELS - 1), 0).astype(np.int64) for k in (0, 1)]
                cells += np.bincount((bucket_of(context) * _LEVELS + grid[0]) * _LEVELS + grid[1], weights=weight[at], minlength=len(cells)).astype(np.int64)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    return run


def learn_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights for each bucket by expectation-maximisation over the held-out table."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    bucket, grid = cells // (_LEVELS * _LEVELS), np.stack([cells // _LEVELS % _LEVELS, cells % _LEVELS], axis=1)
    p = np.concatenate([np.where(grid > 0, 2.0 ** ((grid - 1) / STEPS), 0.0), np.ones((len(cells), 1))], axis=1)
    for b in range(BUCKETS):
        own = bucket == b
        if own.any():
            w, x, c = weights[b], p[own], counts[own].astype(np.float64)
            for _ in range(rounds):
                share = x * w
                share *= (c / share.sum(axis=1))[:, None]
                w = share.sum(axis=0) / c.sum()
            w = np.maximum(w, [0.0, 1e-6, 1e-6])
            weights[b] = w / w.sum()
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(fan: int, n: int, v: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, one, two in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                block = Block(payload, fan)
                c1, c2 = (block.totals(k, [unpack(x)[0]]) for k, x in enumerate((one, two)))
                context = c1[block.context]
                p = (estimates(c2, context, c1[block.word], n, v) * weights[bucket_of(context)]).sum(axis=1)
                first = np.cumsum(block.lens) - block.lens
                add = lambda per_token: np.add.reduceat(per_token, first)  # noqa: E731  a document has one token at least
                base = np.log10((c1 + 1) / (n + (v + 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.ids, mask=block.missing),
                        pa.array((block.fold == HELD_OUT) | block.missing),
                        pa.array(block.lens.astype(np.int64)),
                        pa.array(add((c1 > 0)[block.token_word].astype(np.int64))),
                        pa.array(np.full(len(first), n)),
                        pa.array(add(base[block.token_word])),
                        pa.array(add(np.log10(p)[block.token_pair])),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_text: int = BLOCK_TEXT, part_keys: int = PART_KEYS, fan: int = FAN) -> DataFrame:
    """Scores every document with a model of those whose crc32(id) mod 7 is not 2."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialise(map_batches(rows, _blocks(block_text), "block long, payload binary"), "lm-blocks")
    # A block of 8 MB has about a million distinct n-grams.
    n_blocks = blocks.count()
    parts = max(1, int(n_blocks * block_text / 8 / part_keys))
    steps = next(k for k in range(1, 64) if fan**k >= parts)
    own = next(k for k in range(1, fan + 1) if k**steps >= parts)
    answers, sums = exchange(map_batches(blocks, _ask(own), ANSWERS), parts, own, steps)
    n, v, n_left, v_left = (int(x or 0) for x in sums.where("block = -1 AND level = 0").agg(*(F.sum(s) for s in STATS)).first())
    both = blocks.select(F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("part"), "block", "payload").unionByName(answers)
    matched = both.repartition(parts, "block").sortWithinPartitions("block", "level", "part")
    matched = materialise(map_batches(matched, _matched(), "block long, payload binary, unigrams binary, bigrams binary"), "lm-matched")
    table = map_batches(matched, _held_out_table(own, n_left, v_left), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")  # cells of a fixed grid
    weights = learn_weights(table["cell"].to_numpy(), table["n"].to_numpy())
    return map_batches(matched, _scores(own, n, v, weights), SCORES)
