"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct runs of five words. ``BANDS * ROWS`` MinHash samples of the set are
banded to find candidates, and folded into a parity bitmap (odd sketch) of ``SKETCH_BITS``: the population
count of two sketches' XOR estimates how many samples differ, precisely for high similarities, and
discards candidates far below the threshold. A second odd sketch folds the set itself: two sets differ in
at least as many shingles as their sketches in bits, a bound that loses nothing and is sharp for short
texts. What remains is confirmed on the full sets.

No pairs are made inside groups. Documents with equal sets are one node. In each bucket every node is
compared with the bucket's least one. Nodes that then are in another component than that one may still
be linked with others of the bucket; of those pairs only the ones that share a shingle among their rarest
quarter (prefix filter: no link is without one) are looked at, which two copies with different edits do
not; their places in that order and the set sketches are compared before a pair leaves the join. So every
candidate pair is compared, connected already, or known to be too different.
At similarity 0.75 a pair shares no band with probability below 3e-7.

Cases: letters A-Z are lower-cased; fewer than five words form one run; a document without words or text
is linked with nothing and kept; rows with an equal id are one document with the sets of all of them; rows without an id are returned unlinked, kept, with a null component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.components import connected_components
from orbitweave.llm.storage import materialise
from orbitweave.llm.textblocks import U64, map_batches, mix, row_blocks, shingles, words

SHINGLE, BANDS, ROWS, SKETCH_BITS = 5, 40, 4, 512
_U32 = np.uint32
_rng = np.random.default_rng(20)
_MULT = _rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.int64).astype(_U32) * _U32(2) + _U32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.int64).astype(_U32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=U64))
_SAMPLE = mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=U64))
#: Rows of a similarity test that go to one task at most.
BLOCK = 512
#: Holders of a shingle outside their bucket's component that are compared with all its holders under one key.
HOLDERS = 1024
#: A shingle with more than one in HOT_TOKENS of all rows is looked up by a broadcast: there are fewer of them.
HOT_TOKENS = 5_000
#: Ids up to this number (8 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 300_000
#: XOR population count above which a pair is taken to be below the threshold without looking at its sets.
#: At similarity 0.75, 40 of 160 samples differ (deviation 5.5) and set 69 bits (deviation 11 with the
#: sampling): 136 bits are six deviations away.
FAR_BITS = 136


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a document's words."""
    return np.unique(shingles(hashes, SHINGLE))


def samples(shingle_hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set, one for each permutation."""
    low, high = shingle_hashes.astype(_U32), (shingle_hashes >> U64(32)).astype(_U32)
    out = np.full(len(_MULT), 0xFFFFFFFF, dtype=_U32)
    for lo in range(0, len(low), 256):
        x = low[lo : lo + 256, None] * _MULT + (high[lo : lo + 256, None] ^ _ADD)
        x ^= x >> _U32(16)
        x *= _U32(0x7FEB352D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    """One key for each band."""
    key = _BAND.copy()
    for column in sample.reshape(BANDS, ROWS).T:
        key = mix(key + column.astype(U64))
    return key


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: bit h(position, value) is set if it is hit an odd number of times."""
    at = mix(_SAMPLE ^ sample.astype(U64)) & U64(SKETCH_BITS - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def set_sketch(own: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: its XOR with another's has at most as many bits as the sets differ in shingles."""
    odd = (np.bincount((own >> U64(32) & U64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


_SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
_SET = [f"t{k}" for k in range(SKETCH_BITS // 64)]
_KEYS = ["key1", "key2", "n_shingles"]
SIGNATURES = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, " + ", ".join(f"{s} long" for s in [*_SKETCH, *_SET])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in row_blocks(batch.column(1)):
            w = words(batch.column(1).slice(lo, hi - lo))
            n, keys, band_keys, offsets, sketches = [], [], [], [0], []
            for k in range(hi - lo):
                own = shingle_set(w.hashes[w.first[k] : w.first[k + 1]])
                n.append(len(own))
                if len(own):
                    sample = samples(own)
                    band_keys.append(bands(sample))
                    sketches.append(np.concatenate([odd_sketch(sample), set_sketch(own)]))
                    keys.append((np.bitwise_xor.reduce(mix(own + U64(7))), np.add.reduce(mix(own ^ _BAND[0]))))
                else:
                    sketches.append(np.zeros(len(_SKETCH) + len(_SET), dtype=np.int64))
                    keys.append((U64(0), U64(0)))
                offsets.append(offsets[-1] + (BANDS if len(own) else 0))
            flat = np.concatenate(band_keys).view(np.int64) if band_keys else np.empty(0, dtype=np.int64)
            key = np.array(keys, dtype=U64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), *(pa.array(c.copy()) for c in np.array(sketches).T)],
                ["doc_id", "n_shingles", "key1", "key2", "bands", *_SKETCH, *_SET],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.names.index("text"))
        rest = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        for lo, hi in row_blocks(text):
            w = words(text.slice(lo, hi - lo))
            sets = [shingle_set(w.hashes[w.first[k] : w.first[k + 1]]).tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in rest), pa.array(sets, pa.large_binary()).cast(pa.binary())], [*(batch.schema.names[k] for k in rest), "hashes"])


TOKENS = "token long, doc_id long, set_key long, n int"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each row's text, with a key and the size of their set."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in row_blocks(batch.column(1)):
            w = words(batch.column(1).slice(lo, hi - lo))
            sets = [shingle_set(w.hashes[w.first[k] : w.first[k + 1]]) for k in range(hi - lo)]
            n = np.array([len(s) for s in sets])
            keys = np.array([np.bitwise_xor.reduce(mix(s + U64(7))) for s in sets], dtype=U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(ids[lo:hi], n)), pa.array(np.repeat(keys, n)), pa.array(np.repeat(n, n).astype(np.int32))], ["token", "doc_id", "set_key", "n"])


def rarest(texts: DataFrame, threshold: int) -> DataFrame:
    """``token, doc_id, n, at``: the first n - ceil(threshold * n) + 1 shingles of each set by their number of
    sets, then by hash, with their places in that order; shingles of one set only count, but are left out.

    Two sets whose similarity reaches the threshold share one of these, whatever the common order is."""
    tokens = materialise(map_batches(texts, _tokens, TOKENS), "near-tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    own = tokens.join(often, "token").groupBy("doc_id", "set_key", "n").agg(F.sort_array(F.collect_set(F.struct("sets", "token"))).alias("own"))
    alone = F.col("n") - F.size("own")
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") / 100).cast("int") + 1 - alone
    kept = own.where(first > 0).select("doc_id", "n", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), first)).alias("k", "s"))
    return kept.select(F.col("s.token").alias("token"), "doc_id", "n", (F.col("alone") + F.col("k")).alias("at"))


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """100 * intersection >= threshold * union of two sorted sets that are not empty."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < threshold * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _confirm(threshold: int):
    """Rows by (centre, block), the centre itself first: keeps members with 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre_sets = None, []
        for batch in batches:
            centres, blocks, members, ids, sets = (batch.column(k) for k in range(5))
            a, b = [], []
            for k in range(batch.num_rows):
                at, s = (centres[k].as_py(), blocks[k].as_py()), np.frombuffer(sets[k].as_buffer(), dtype=U64)
                if not members[k].as_py():
                    centre_sets = [*centre_sets, s.copy()] if group == at else [s.copy()]
                    group = at
                    continue
                if group != at:
                    raise ValueError(f"no centre for {at}")
                if any(similar(s, own, threshold) for own in centre_sets):
                    a.append(at[0])
                    b.append(ids[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirm_pairs(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a, b`` of ids whose full sets are similar enough; ``docs`` has ``doc_id, text``.

    A centre's set is sent once to each block of its members, so a centre of many members is not one task."""
    members = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(members, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).cast("long").alias("block"), "b")
    roles = materialise(
        dealt.select(F.col("b").alias("doc_id"), F.col("a").alias("centre"), "block", F.lit(True).alias("member"))
        .unionByName(dealt.select(F.col("a").alias("doc_id"), F.col("a").alias("centre"), "block", F.lit(False).alias("member")).distinct()),
        "near-roles",
    )
    side = F.broadcast(roles) if roles.count() <= BROADCAST_IDS else roles
    sets = map_batches(docs.join(side, "doc_id").select("centre", "block", "member", "doc_id", "text"), _sets, "centre long, block long, member boolean, doc_id long, hashes binary")
    dealt = sets.repartition("centre", "block").sortWithinPartitions("centre", "block", "member")
    return map_batches(dealt, _confirm(threshold), "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents linked at ``threshold`` per cent of Jaccard similarity or more."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(map_batches(docs, _signatures, SIGNATURES), "near-signatures")
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialise(full.groupBy(*_KEYS).agg(F.min("doc_id").alias("rep")), "near-classes")
    nodes = full.join(classes, _KEYS).where(F.col("doc_id") == F.col("rep"))
    keyed = nodes.select(F.explode("bands").alias("bucket"), "rep").distinct()
    shared = keyed.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where(F.col("centre") < F.col("last")).drop("last")
    buckets = materialise(keyed.join(shared, "bucket"), "near-buckets")

    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    traits = [*_SKETCH, *_SET, "n_shingles"]
    # Null for an id with several sets. Written once: six joins read it, and its many aggregates in each of their plans took the driver's memory.
    sketches = materialise(full.select(F.col("doc_id").alias("id"), *traits).groupBy("id").agg(*(same(c) for c in traits)), "near-sketches")

    def sketched(df: DataFrame, column: str, prefix: str, columns: list[str] = traits) -> DataFrame:
        return df.join(sketches.select(F.col("id").alias(column), *(F.col(c).alias(prefix + c) for c in columns)), column)

    def differing(columns: list[str]) -> Column:
        return sum((F.bit_count(F.col("x" + s).bitwiseXOR(F.col("y" + s))) for s in columns), F.lit(0))

    # Sets as similar as the threshold differ in no more than this share of both sizes.
    bounded = F.coalesce((100 + threshold) * differing(_SET) <= (100 - threshold) * (F.col("xn_shingles") + F.col("yn_shingles")), F.lit(True))
    near = F.coalesce(differing(_SKETCH) <= FAR_BITS, F.lit(True)) & bounded
    stars = buckets.where(F.col("rep") != F.col("centre")).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    stars = sketched(sketched(stars, "a", "x"), "b", "y").where(near).select("a", "b")
    # An id with several different sets is one node: an edge to the representative of each.
    several = full.groupBy("doc_id").agg(*(F.min(c).alias("lo" + c) for c in _KEYS), *(F.max(c).alias("hi" + c) for c in _KEYS)).where(" OR ".join(f"lo{c} < hi{c}" for c in _KEYS)).select("doc_id")
    tied = full.join(several, "doc_id").join(classes, _KEYS).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
    first = materialise(confirm_pairs(stars, docs, threshold).unionByName(tied), "near-edges")
    joined = materialise(connected_components(first), "near-components")

    # Nodes of a bucket outside the component of its least one, against all the others of the bucket.
    of = joined.withColumnRenamed("node", "rep").withColumnRenamed("component", "own")
    centre = joined.withColumnRenamed("node", "centre").withColumnRenamed("component", "middle")
    placed = buckets.join(of, "rep", "left").join(centre, "centre", "left").select("bucket", "rep", "centre", F.coalesce("own", "rep").alias("own"), F.coalesce("middle", "centre").alias("middle"))
    placed = materialise(placed, "near-placed")
    apart = F.col("own") != F.col("middle")
    open_buckets = placed.where(apart).select("bucket").distinct()
    people = materialise(placed.join(open_buckets, "bucket", "left_semi").groupBy(F.col("rep").alias("doc_id")).agg(F.min("own").alias("own"), F.max(apart).alias("outside")), "near-people")
    few = F.broadcast(people) if people.count() <= BROADCAST_IDS else people
    rare = materialise(rarest(docs.join(few.select("doc_id"), "doc_id").select("doc_id", "text"), threshold).join(few, "doc_id"), "near-rare")
    # The outside holders of a token are dealt over blocks, and all its holders repeated for each, so a token of many is many keys.
    dealt = F.ceil(F.count_if("outside") / HOLDERS).cast("int").alias("blocks")
    shared = rare.groupBy("token").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("held"), dealt)
    shared = materialise(shared.where("lo < hi AND blocks > 0").select("token", "blocks", "held"), "near-shared")
    # Tokens of the most rows, fewer than HOT_TOKENS of them, are looked up without a shuffle of their rows.
    hot = F.col("held") > rare.count() // HOT_TOKENS
    often, seldom = (shared.where(which).drop("held") for which in (hot, ~hot))
    slim = rare.join(F.broadcast(often), "token").unionByName(rare.join(F.broadcast(often.select("token")), "token", "left_anti").join(seldom, "token"))
    alive = materialise(slim.distinct(), "near-alive")
    whole = ["doc_id", "own", "outside", "n", "at"]

    def side(k: str, block: Column) -> DataFrame:
        return sketched(alive.select("token", block.alias("block"), *(F.col(c).alias(k + c) for c in whole)), f"{k}doc_id", k, [*_SET, "n_shingles"])

    # The first common shingle of two sets leaves no more for both than what follows it in either.
    left = (100 + threshold) * F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat")) >= threshold * (F.col("xn") + F.col("yn"))
    outside = side("x", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).where("xoutside")
    rest = outside.join(side("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), ["token", "block"]).where((F.col("xown") != F.col("yown")) & left & bounded)
    rest = rest.select(F.least("xdoc_id", "ydoc_id").alias("a"), F.greatest("xdoc_id", "ydoc_id").alias("b")).distinct()
    rest = sketched(sketched(rest, "a", "x"), "b", "y").where(near).select("a", "b")
    second = materialise(confirm_pairs(rest, docs, threshold), "near-edges")
    components = connected_components(first.unionByName(second))

    return (
        signed.select("doc_id", "n_shingles", "key1", "key2")
        .join(classes, _KEYS, "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


#: The same in SQL, with all pairs that share a shingle: for small tables.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, k, k + least(len(w), 5) - 1), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
