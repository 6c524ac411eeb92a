"""One JSON object of any size, whose arrays of objects are tables: cut by byte ranges, and written as ordered lines.

The text source cuts files into byte ranges and rows at every ``}``. Whether a range begins inside a string, and
how deep, is known only from the ranges before it, so there are two passes. The first tells for each range, for a
start outside and inside a string, how the depth changes, how many objects end at which depth, and which key
opened the last array or object at which depth. Running sums over the ranges (a row for each range) give every
range its true start. The second pass then takes the objects out; one that goes over the end of a range comes
in pieces, which are put together by its number in the document.

The keys of the document itself must not hold ``}``; its arrays hold objects (other items are left out), and an
object has to fit into memory, a document hasn't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitweave.operators.ordinal import quantile_cuts, range_of

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_RANGES = "doc long, file string, block long, quotes int, bytes long, size long, " + ", ".join(f"depth{s} int, ends{s} map<int, long>, opened{s} map<int, struct<key: string, array: boolean>>" for s in (0, 1))
_CUT = "doc long, file string, block long, ordinal long, section string, whole boolean, json string"
#: Rows of a batch, each a piece of text up to a closing brace.
BATCH_ROWS = 4096


def _scan(spark: SparkSession, path: str, one_document: bool) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    doc = F.lit(0).cast("long") if one_document else F.xxhash64("_metadata.file_path")
    return rows.select(doc.alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


#: Quotes and brackets: the only bytes that are looked at one by one.
_MARK = np.isin(np.arange(256), list(b'"{}[]'))


def _structure(data: bytes, quotes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the brackets, how many quotes (modulo 2) stand before each, and before what follows ``data``."""
    b = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(_MARK[b])
    quote = b[at] == 0x22
    bracket = ~quote
    if b"\\" in data:
        slash = np.flatnonzero(b == 0x5C)
        nth = np.arange(len(slash))
        length = nth - np.maximum.accumulate(np.where(np.diff(slash, prepend=-2) != 1, nth, 0)) + 1  # of the run of backslashes that ends here
        k = np.minimum(np.searchsorted(slash, at - 1), len(slash) - 1)
        quote &= (slash[k] != at - 1) | (length[k] % 2 == 0)  # an odd number of backslashes before it takes a quote's meaning
    before = quotes + np.cumsum(quote)
    return at[bracket], before[bracket] % 2, int(before[-1]) % 2 if len(at) else quotes


def _opened(data: bytes, place: int) -> tuple[str | None, bool]:
    """The key before an opening bracket, and whether it opens an array."""
    key = _KEY.search(data[:place], max(0, place - 4096))
    return (key[1].decode() if key else None), data[place : place + 1] == b"["


def _by_range(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, bytes]]:
    """Consecutive rows of one range: which, how many, and their text with the braces between them."""
    file, block = batch.column(1).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
    ends = [*(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
    values = batch.column("value").cast(pa.binary())
    lo = 0
    for hi in ends if batch.num_rows else []:
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), values.slice(lo, hi - lo)), b"}")
        yield (batch.column(1)[lo].as_py(), int(block[lo])), hi - lo, text[0].as_py()
        lo = hi


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None

    def done() -> pa.RecordBatch:
        row = {"doc": state["doc"], "file": now[0], "block": now[1], "quotes": state["quotes"], "bytes": state["bytes"], "size": state["size"]}
        for s in (0, 1):
            row |= {f"depth{s}": state["depth"][s], f"ends{s}": list(state["ends"][s].items()), f"opened{s}": [(d, {"key": k, "array": a}) for d, (k, a) in state["opened"][s].items()]}
        return pa.RecordBatch.from_pylist([row], _SUMMARY_SCHEMA)

    for batch in batches:
        first = 0
        for key, n, text in _by_range(batch):
            if key != now:
                if now:
                    yield done()
                now, state = key, {"doc": batch.column(0)[first].as_py(), "size": batch.column(3)[first].as_py(), "quotes": 0, "bytes": 0, "depth": [0, 0], "ends": [{}, {}], "opened": [{}, {}], "next": b""}
            first += n
            # The brace after the last row may not be there: it is left to what follows.
            data = state["next"] + text
            state["next"] = b"}"
            state["bytes"] += len(text) + 1
            places, inside, state["quotes"] = _structure(data, state["quotes"])
            marks = np.frombuffer(data, dtype=np.uint8)[places]
            for s in (0, 1):
                at, mark = places[inside == s], marks[inside == s]
                up = (mark == 0x7B) | (mark == 0x5B)
                depth = state["depth"][s] + np.cumsum(np.where(up, 1, -1))
                for d, n in zip(*np.unique(depth[mark == 0x7D], return_counts=True), strict=True):
                    state["ends"][s][int(d)] = state["ends"][s].get(int(d), 0) + int(n)
                opened, where = depth[up][::-1], at[up][::-1]
                for d, k in zip(*np.unique(opened, return_index=True), strict=True):
                    state["opened"][s][int(d)] = _opened(data, int(where[k]))
                state["depth"][s] = int(depth[-1]) if len(depth) else state["depth"][s]
    if now:
        yield done()


_OPENED = pa.map_(pa.int32(), pa.struct([("key", pa.string()), ("array", pa.bool_())]))
_SUMMARY_SCHEMA = pa.schema(
    [("doc", pa.int64()), ("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int32()), ("bytes", pa.int64()), ("size", pa.int64())]
    + [f for s in (0, 1) for f in ((f"depth{s}", pa.int32()), (f"ends{s}", pa.map_(pa.int32(), pa.int64())), (f"opened{s}", _OPENED))]
)


def _starts(ranges: DataFrame) -> DataFrame:
    """Each range's true start: ``quoted, depth, ordinal, section, array``, and whether a brace ends its last row."""
    whole = Window.partitionBy("file")
    ranges = ranges.withColumn("closed", (F.col("block") < F.max("block").over(whole)) | (F.sum("bytes").over(whole) == F.col("size")))
    order = Window.partitionBy("doc").orderBy("file", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("quoted", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    pick = lambda name: F.when(F.col("quoted") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    ranges = ranges.select("*", pick("depth").alias("rise"), pick("ends").alias("ends"), pick("opened").alias("opened"), (F.col("closed") & (F.col("quotes") == F.col("quoted"))).cast("int").alias("brace"))
    ranges = ranges.withColumn("depth", F.coalesce(F.sum(F.col("rise") - F.col("brace")).over(before), F.lit(0)).cast("int"))
    two = 2 - F.col("depth")
    at = lambda c: F.try_element_at(F.col(c), two)
    last = F.when((F.col("brace") == 1) & (F.col("rise") - 1 == two), 1).otherwise(0)
    ranges = ranges.select("*", (F.coalesce(at("ends"), F.lit(0)) + last).alias("ended"), at("opened").alias("last"))
    section = F.last(F.col("last"), ignorenulls=True).over(before)
    ordinal = F.coalesce(F.sum("ended").over(before), F.lit(0)).cast("long")
    return ranges.select("file", "block", "closed", "quoted", "depth", ordinal.alias("ordinal"), section["key"].alias("section"), section["array"].alias("array"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of arrays (``whole``, or pieces of them), and with a null section what is outside of arrays."""
    now, st = None, None
    out: list[tuple] = []

    def feed(data: bytes) -> None:
        places, inside, st["quotes"] = _structure(data, st["quotes"])
        outside = inside == 0
        at, mark = places[outside], np.frombuffer(data, dtype=np.uint8)[places[outside]]
        up = (mark == 0x7B) | (mark == 0x5B)
        depth = st["depth"] + np.cumsum(np.where(up, 1, -1))
        # What happens at the level of arrays and their objects, in order.
        seen = np.flatnonzero(np.where(up, (depth == 2) | ((depth == 3) & (mark == 0x7B)), (depth == 1) | ((depth == 2) & (mark == 0x7D))))
        kept = 0  # outside of arrays, kept to here
        for place, m, d in zip(at[seen].tolist(), mark[seen].tolist(), depth[seen].tolist(), strict=True):
            if m in (0x7B, 0x5B) and d == 2:
                st["section"], st["array"] = _opened(data, place)
                if st["array"]:
                    st["rest"].append(data[kept : place + 1])
            elif m in (0x7B, 0x5B):
                st["from"] = place
                st["parts"] = []
                st["whole"] = True
            elif d == 2:
                if st["array"]:
                    st["parts"].append(data[st["from"] : place + 1])
                    out.append((st["ordinal"], st["section"], st["whole"], b"".join(st["parts"])))
                st["ordinal"] += 1
                st["from"], st["parts"] = None, []
            else:
                if st["array"]:
                    kept = place
                st["array"] = st["array"] and m != 0x5D
        st["depth"] = int(depth[-1]) if len(depth) else st["depth"]
        if not st["array"]:
            st["rest"].append(data[kept:])
        elif st["from"] is not None:
            st["parts"].append(data[st["from"] :])
            st["from"] = 0

    def rows() -> pa.RecordBatch:
        n = len(out)
        columns = [[st["doc"]] * n, [now[0]] * n, [now[1]] * n, *zip(*out, strict=True)] if n else [[]] * 7
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()), strict=True)], _CUT_NAMES)
        out.clear()
        return batch.set_column(6, "json", batch.column(6).cast(pa.string()))

    def done() -> pa.RecordBatch:
        if st["closed"]:
            feed(b"}")
        if st["from"] is not None and st["array"]:
            out.append((st["ordinal"], st["section"], False, b"".join(st["parts"])))
        if rest := b"".join(st["rest"]):
            out.append((st["ordinal"], None, False, rest))
        return rows()

    for batch in batches:
        first = 0
        for key, n, text in _by_range(batch):
            if key != now:
                if now:
                    yield done()
                start = {c: batch.column(c)[first].as_py() for c in ("doc", "closed", "quoted", "depth", "ordinal", "section", "array")}
                array = bool(start["array"]) and start["depth"] >= 2
                open_ = array and start["depth"] >= 3
                now, st = key, start | {"array": array, "quotes": start["quoted"], "from": 0 if open_ else None, "parts": [], "whole": False, "rest": [], "next": b""}
            first += n
            feed(st["next"] + text)
            st["next"] = b"}"
        if out:
            yield rows()
    if now:
        yield done()


_CUT_NAMES = ["doc", "file", "block", "ordinal", "section", "whole", "json"]


def read_objects(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """``doc, section, ordinal, json``: the objects of the arrays of JSON documents, numbered in their order, with gaps.

    Each file is a document, or with ``one_document`` all files, in the order of their names, are one. What a
    document has besides arrays is one row with a null section: the document with empty arrays."""
    from orbitweave.sources.scratch import fresh_path

    scan = _scan(spark, path, one_document)
    starts = _starts(scan.mapInArrow(_limited(_summaries), _RANGES))
    # A row for each range of the scan, so some 64 bytes for each 128 MB of text.
    placed = scan.join(F.broadcast(starts), ["file", "block"])
    cut = fresh_path(spark, "objects")
    placed.select("doc", "file", "block", "closed", "quoted", "depth", "ordinal", "section", "array", "value").mapInArrow(_limited(_cut), _CUT).write.parquet(cut)
    rows = spark.read.schema(_CUT).parquet(cut)
    pieces = rows.where(~F.col("whole"))
    number = F.when(F.col("section").isNotNull(), F.col("ordinal"))
    joined = pieces.groupBy("doc", number.alias("ordinal"), F.col("section").isNull().alias("rest")).agg(F.max("section").alias("section"), F.sort_array(F.collect_list(F.struct("file", "block", "json"))).alias("all"))
    put = joined.select("doc", "section", "ordinal", F.array_join(F.transform("all", lambda p: p["json"]), "").alias("json"))
    return rows.where("whole").select("doc", "section", "ordinal", "json").unionByName(put)


def _limited(run):
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(lo, BATCH_ROWS) for b in batches for lo in range(0, b.num_rows, BATCH_ROWS))

    return wrapped


def parse_objects(objects: DataFrame, section: str, schema: str, extra: str = "extra") -> DataFrame:
    """A section's objects as columns of ``schema``, and the keys that it doesn't know as ``MAP<STRING, VARIANT>``."""
    rows = objects.where(F.col("section") == section).select("ordinal", F.from_json("json", schema).alias("r"), F.from_json("json", "MAP<STRING, VARIANT>").alias("all"))
    known = rows.schema["r"].dataType.names
    return rows.select("r.*", F.map_filter("all", lambda k, v: ~k.isin(*known)).alias(extra), "ordinal")


def _objects(table: DataFrame, extra: str, kept: list[Column]) -> DataFrame:
    """``kept`` and ``json``: each row as JSON, with the keys of the map ``extra`` beside the columns.

    Both texts are columns first, so that each is made once for a row and not once for each use."""
    plain = F.to_json(F.struct(*(F.col(c) for c in table.columns if c != extra)))
    if extra not in table.columns:
        return table.select(*kept, plain.alias("json"))
    has = F.coalesce(F.size(F.col(extra)) > 0, F.lit(False))
    texts = table.select(*kept, plain.alias("__plain"), F.when(has, F.to_json(F.col(extra))).alias("__more"))
    gap = F.when(F.col("__plain") == "{}", "").otherwise(",")
    both = F.concat(F.expr("substring(__plain, 1, length(__plain) - 1)"), gap, F.expr("substring(__more, 2)"))
    return texts.select(*(c for c in texts.columns if c not in ("__plain", "__more")), F.coalesce(both, "__plain").alias("json"))


def document_lines(tables: dict[str, DataFrame], order: str, places: int, extra: str = "extra") -> DataFrame:
    """``place, part, later, nr, value``: the lines of one JSON object with an array for each table, by the last four in the order of a number.

    Rows aren't numbered, since only the first of a table must be told from the others, which a comma precedes. Quantiles of
    the number deal them over ``places``, which rise with the order; they only balance the work."""
    sizes = [table.agg(F.count("*"), F.count(order), F.min(order)).first() for table in tables.values()]
    total, before, lines = max(1, sum(n for n, _, _ in sizes)), 0, None

    def text(spark: SparkSession, place: int, part: int, value: str) -> DataFrame:
        return spark.range(0, 1, 1, 1).select(F.lit(place).alias("place"), F.lit(part).alias("part"), F.lit(0).alias("later"), F.lit(None).cast("long").alias("nr"), F.lit(value).alias("value"))

    for k, ((name, table), (n, numbered, least)) in enumerate(zip(tables.items(), sizes, strict=True)):
        lo = min(places - 1, places * before // total)
        before += n
        hi = max(lo, -(-places * before // total) - 1)
        cuts = quantile_cuts(table.select(F.col(order).cast("double").alias("nr")).where("nr IS NOT NULL"), "nr", hi - lo + 1)
        own = _objects(table, extra, [(range_of(F.col(order), cuts) + lo).cast("int").alias("place"), F.lit(2 * k + 1).alias("part"), F.col(order).alias("nr")])
        # The least number's rows are told apart by their texts, and equal ones by count.
        least_one = F.col("nr").isNull() if numbered < n else F.col("nr").eqNullSafe(F.lit(least))
        first = own.where(least_one).withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("json")))
        first = first.select("place", "part", F.when(F.col("k") > 1, 1).otherwise(0).alias("later"), "nr", F.concat(F.when(F.col("k") > 1, ", ").otherwise(""), "json").alias("value"))
        rest = own.where(~least_one).select("place", "part", F.lit(1).alias("later"), "nr", F.concat(F.lit(", "), "json").alias("value"))
        head = text(table.sparkSession, lo, 2 * k, ("], " if k else "{") + f'"{name}": [')
        lines = (head if lines is None else lines.unionByName(head)).unionByName(first).unionByName(rest)
    return lines.unionByName(text(lines.sparkSession, places - 1, 2 * len(tables), "]}"))


def write_document(tables: dict[str, DataFrame], order: str, path: str, partitions: int, extra: str = "extra") -> None:
    """Part files in the order of their names are the document; each holds whole lines."""
    lines = document_lines(tables, order, partitions, extra)
    lines.repartitionById(partitions, F.col("place")).sortWithinPartitions("part", "later", "nr", "value").select("value").write.mode("overwrite").text(path)
