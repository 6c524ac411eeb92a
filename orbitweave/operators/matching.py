"""Joins by name and by similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of the runs by which names are looked up, at most; bits of the filter of these runs, at least and at most (8 MB).
RUN_BYTES, LEAST_BITS, MOST_BITS = 8, 1 << 13, 1 << 26
#: Classes of runs whose frequency is estimated, and about how many files it is estimated from.
CLASSES, SAMPLE_FILES = 1 << 16, 10_000
#: Bytes of a text whose runs are looked at together, some twelve arrays of eight times as many; rows and bytes of a batch.
_CHUNK, OUT_BYTES = 1 << 16, 4 << 20
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _runs(text: bytes, size: int) -> Iterator[np.ndarray]:
    """All runs of ``size`` bytes as numbers, in chunks."""
    for lo in range(0, len(text) - size + 1, _CHUNK):
        b = np.frombuffer(text, dtype=np.uint8)[lo : lo + _CHUNK + size - 1].astype(np.uint64)
        out = b[: len(b) - size + 1]
        for k in range(1, size):
            out = (out << np.uint64(8)) | b[k : len(b) - size + 1 + k]
        yield out


def _places(runs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter for each run."""
    return tuple((((runs ^ (runs >> np.uint64(31))) * m) >> np.uint64(20)) & np.uint64(bits - 1) for m in _MIX)


def _texts(batch: pa.RecordBatch, column: int = 0) -> Iterator[bytes]:
    return (v.as_buffer().to_pybytes() for v in batch.column(column))


def _in_batches(rows: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` whose batches are bounded in rows and bytes, so that a task's memory doesn't follow the table; a session's own setting stands."""
    spark = rows.sparkSession
    known = spark.conf.getAll
    for name, most in BATCH.items():
        if name not in known:
            spark.conf.set(name, str(most))
    return rows.mapInArrow(run, schema)


def name_contains(files: DataFrame, names: DataFrame, file_col: str, name_col: str, found: bool = True) -> DataFrame:
    """Files whose name holds any of the names (``found``) or none of them.

    Each name is looked up by its rarest run of bytes, as long as the shortest name or ``RUN_BYTES``. A Bloom filter
    of these runs, of bounded size, is probed at every place of a file's name; only what passes is listed, joined
    with the names by the run and compared whole. How rare a run is, is estimated from a sample of the files: it
    changes the work, not the result. An empty name is in every file name that is not null."""
    wanted = names.select(F.col(name_col).alias("__name")).where("__name IS NOT NULL").distinct()
    n, shortest = wanted.agg(F.count("*"), F.min(F.octet_length("__name"))).first()
    if not n:
        return files.limit(0) if found else files
    if shortest == 0:
        return files.where(F.col(file_col).isNotNull() if found else F.col(file_col).isNull())
    size = min(RUN_BYTES, shortest)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    texts = files.select(F.col(file_col).alias("__file")).where(F.octet_length("__file") >= shortest)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            for text in _texts(batch):
                for runs in _runs(text, size):
                    seen += np.bincount(_places(runs, CLASSES)[0].astype(np.int64), minlength=CLASSES)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["class", "n"])

    share = max(1, texts.count() // SAMPLE_FILES)
    sample = texts.where(F.pmod(F.xxhash64("__file"), F.lit(share)) == 0)
    common = np.zeros(CLASSES, dtype=np.int64)
    for r in _in_batches(sample, classes, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():  # CLASSES rows at most
        common[r["class"]] = r["n"]

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = []
            for text in _texts(batch):
                runs = np.unique(np.concatenate(list(_runs(text, size))))
                picked.append(runs[np.argmin(common[_places(runs, CLASSES)[0].astype(np.int64)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(picked, dtype=np.uint64).view(np.int64))], ["__name", "__run"])

    keyed = _in_batches(wanted, rarest, "__name string, __run long")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(3)).astype(np.int64)), pa.array((1 << (places & np.uint64(7)).astype(np.int64)))], ["byte", "bits"])

    filled = np.zeros(bits >> 3, dtype=np.uint8)
    for r in _in_batches(keyed.select("__run"), marks, "byte long, bits long").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow().to_pylist():  # MOST_BITS / 8 rows at most
        filled[r["byte"]] = r["bits"]
    shared = files.sparkSession.sparkContext.broadcast(filled)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for k, text in enumerate(_texts(batch)):
                hits = []
                for runs in _runs(text, size):
                    one, two = _places(runs, bits)
                    passed = runs[(held[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                    two = _places(passed, bits)[1]
                    hits.append(np.unique(passed[(held[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]))
                # A text goes out once for each of its hits, in batches of bounded bytes.
                found_runs = np.unique(np.concatenate(hits)).view(np.int64) if hits else np.empty(0, dtype=np.int64)
                step = max(1, OUT_BYTES // max(1, len(text)))
                for lo in range(0, len(found_runs), step):
                    part = found_runs[lo : lo + step]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(part), k))), pa.array(part)], ["__file", "__run"])

    met = _in_batches(texts, probe, "__file string, __run long").join(keyed, "__run").where(F.contains("__file", "__name"))
    held = met.select(F.xxhash64("__file").alias("__hash"), "__file").distinct()
    return files.join(held, (F.xxhash64(file_col) == F.col("__hash")) & (F.col(file_col) == F.col("__file")), "left_semi" if found else "left_anti")


def prefix_candidates(files: DataFrame, bases: DataFrame, stem: str, base: str, separator: str = "_") -> DataFrame:
    """Pairs where the stem is the base, or goes on after it with the separator: an equi-join on the stem's prefixes."""
    parts = F.split(F.col(stem), separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), separator))
    listed = files.withColumn("__prefix", F.explode(F.array_distinct(prefixes)))
    return listed.join(bases, F.col("__prefix") == F.col(base)).drop("__prefix")


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[Column], take: list[str]) -> DataFrame:
    """Left join with the first row of ``right`` by ``order`` for each key; grouped by a partial aggregate, not sorted."""
    best = right.groupBy(key).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("__first"))
    return left.join(best, key, "left").select(*left.columns, *(F.col(f"__first.{c}").alias(c) for c in take))


def missing_and_extra(expected: DataFrame, present: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Expected rows that are not present (repeats kept), and present keys that nobody expects (once each)."""
    return expected.join(present, key, "left_anti"), present.select(key).distinct().join(expected, key, "left_anti")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of equal length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def best_by(rows: DataFrame, keys: list[str], score: Column, tie: Column, take: list[str]) -> DataFrame:
    """For each key the row with the highest score; of equal scores the first by ``tie``."""
    best = F.min_by(F.struct(*take, score.alias("__score")), F.struct((-score).alias("s"), tie.alias("t")))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, *(F.col(f"__best.{c}").alias(c) for c in take), F.col("__best.__score").alias("score"))


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as the rows of a matrix; a null is not a number, and a row of another length is none at all."""
    flat = column.combine_chunks()
    size = pc.list_value_length(flat)
    width = pc.max(size).as_py() or 0
    fits = pc.fill_null(pc.equal(size, width), False)
    out = np.full((len(flat), width), np.nan)
    out[fits.to_numpy(zero_copy_only=False)] = flat.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def in_blocks(queries: DataFrame, candidates: DataFrame, query: str, match: str, on: list[str], block_rows: int, block_queries: int, run, schema: str) -> DataFrame:
    """``run(queries, candidates)`` over Arrow tables of one block of each that agree in ``on``: all pairs, in bounded pieces, each of them one group."""
    n, m = (max(1, -(-df.count() // rows)) for df, rows in ((candidates, block_rows), (queries, block_queries)))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    dealt = candidates.withColumn("__b", own(match, n)).withColumn("__a", each(m))
    asked = queries.withColumn("__a", own(query, m)).withColumn("__b", each(n))
    tasks = min(n * m * 4, max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * queries.sparkSession.sparkContext.defaultParallelism))
    by = [*on, "__a", "__b"]
    return asked.repartition(tasks, *by).groupBy(*by).cogroup(dealt.repartition(tasks, *by).groupBy(*by)).applyInArrow(run, schema)


#: Candidates that are compared with a block of queries at once, and how far a matrix product may be from a plain sum of a cosine.
CHUNK, NEAR = 256, 1e-12


def _most_similar(kind: pa.DataType):
    """The most similar candidate of a block for each query, itself excepted: by matrix products, and what they can't tell apart by plain sums in order."""

    def run(asked: pa.Table, dealt: pa.Table) -> pa.Table:
        names = ["query", "match", "__s"]
        if not asked.num_rows or not dealt.num_rows:
            return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], names)
        ids, keys = asked["query"].to_numpy(), dealt["match"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, q, c = keys[order], vectors_of(asked["__q"]), vectors_of(dealt["__c"])[order]
        if q.shape[1] != c.shape[1]:
            c = np.full((len(c), q.shape[1]), np.nan)

        def plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.zeros(len(a))
            for k in range(a.shape[1]):
                total += a[:, k] * b[:, k]
            return total

        qq, cc = plain(q, q), plain(c, c)
        best, at = np.full(len(ids), -np.inf), np.full(len(ids), -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            for lo in range(0, len(keys), CHUNK):
                part = slice(lo, lo + CHUNK)
                likely = q @ c[part].T / np.sqrt(qq[:, None] * cc[None, part])
                other = ids[:, None] != keys[None, part]
                likely[~other | np.isnan(likely)] = -np.inf
                top = likely.max(axis=1)
                # Without any number the first other candidate stands, until one comes that has a score.
                first = np.where(other.any(axis=1), lo + other.argmax(axis=1), -1)
                at = np.where((at < 0) & (first >= 0), first, at)
                rows, cols = np.nonzero((likely >= np.maximum(top, best)[:, None] - NEAR) & (likely > -np.inf))
                score = plain(q[rows], c[lo + cols]) / np.sqrt(qq[rows] * cc[lo + cols])
                order = np.lexsort((cols, -score, rows))
                rows, first = np.unique(rows[order], return_index=True)
                cols, score = cols[order][first], score[order][first]
                better = score > best[rows]
                best[rows[better]], at[rows[better]] = score[better], lo + cols[better]
        met = at >= 0
        score = best[met]
        return pa.table([pa.array(ids[met], kind), pa.array(keys[at[met]], kind), pa.array(score, pa.float64(), mask=np.isinf(score))], names)

    return run


def best_match(queries: DataFrame, candidates: DataFrame, key: str, vector: str, group: str, block_rows: int = 8_192, block_queries: int = 2_048) -> DataFrame:
    """For each query the most similar candidate of its group, by cosine, itself excepted; ties go to the least key.

    Each block of candidates meets each block of the queries, a stated set, of its group, in one group of bounded size, so a
    large group is many tasks; only the best of each goes on. Vectors have one length; a null or a zero vector is like none."""
    kind = candidates.schema[key].dataType
    asked = queries.where(F.col(group).isNotNull()).select(F.col(key).cast(kind).alias("query"), F.col(group).alias("__g"), F.col(vector).alias("__q"))
    dealt = candidates.where(F.col(group).isNotNull()).select(F.col(key).alias("match"), F.col(group).alias("__g"), F.col(vector).alias("__c"))
    found = in_blocks(asked, dealt, "query", "match", ["__g"], block_rows, block_queries, _most_similar(to_arrow_type(kind)), f"query {kind.simpleString()}, match {kind.simpleString()}, __s double")
    return best_by(found, ["query"], F.coalesce("__s", F.lit(float("-inf"))), F.col("match"), ["match"]).withColumn("score", F.when(F.col("score") > float("-inf"), F.col("score")))


def mode(rows: DataFrame, value: list[str], order: Column) -> DataFrame:
    """The most frequent value; of equal counts the first seen by ``order``."""
    counted = rows.groupBy(*value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    return counted.orderBy(F.desc("n"), "__first").limit(1).drop("__first")


def previous(rows: DataFrame, keys: list[str], order: list[str], column: str, default: float = 0.0) -> Column:
    """The value of the row before in (keys, order), ``default`` for the first."""
    return F.lag(column, 1, default).over(Window.partitionBy(*keys).orderBy(*order))
