"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces of a model file reports, at each end position, all pieces that
end there (its output links); a single left-to-right pass relaxes the best score at each position
(Viterbi). A character that no piece covers falls back to its UTF-8 byte pieces. Texts are cut first at
characters that occur in no piece and before runs of the space mark (no piece has the mark after another
character), which cannot change the best path; segments are remembered, up to a bound.

Cases: a null text has null ids; an empty text has none; ids decode to the same text, leading, trailing
and repeated spaces included; an unknown id decodes to U+2047 as the unknown piece does; repeated rows are
encoded alike; an empty table gives an empty result; columns named ``ids`` or ``decoded`` are replaced. The
model is a path that every executor can read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitweave.llm.textblocks import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of segments and ids that a Python worker remembers within a task (each entry counted with its overhead).
REMEMBERED = 24 << 20
#: What a byte piece costs beyond the worst piece.
BYTE_PENALTY = 10.0


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id; types: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda k: 2 if sp.is_unknown(k) else 3 if sp.is_control(k) else 6 if sp.is_byte(k) else 1
    return [(sp.id_to_piece(k), sp.get_score(k), kind(k)) for k in range(sp.get_piece_size())]


class Encoder(dict):
    """Maps a segment to its ids as bytes of int32; unknown segments are encoded on first use."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        super().__init__()
        self.held = 0
        self.automaton = ahocorasick.Automaton()
        self.byte_id: dict[int, int] = {}
        normal = []
        for k, (piece, score, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_id[int(piece[3:5], 16)] = k
            elif kind == 1:
                normal.append(piece)
                self.automaton.add_word(piece, (len(piece), score, k))
        self.automaton.make_automaton()
        self.byte_score = min([s for _, s, kind in pieces if kind == 1], default=0.0) - BYTE_PENALTY
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == 2), 0)
        known = sorted({c for p in normal for c in p} - {MARK})
        #: Characters that are pieces themselves: bytes, which score below any piece, can't be better there.
        self.bare = re.compile("[" + "".join(re.escape(p) for p in normal if len(p) == 1) + "]*").fullmatch
        inside = "".join(map(re.escape, known))
        # Marks with the known characters after them; or any other single character.
        whole = any(MARK in p.lstrip(MARK) for p in normal)
        self.segments = re.compile(f"[{inside}{MARK}]+|[^{inside}{MARK}]" if whole else f"{MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]").findall

    def __missing__(self, segment: str) -> bytes:
        ids = array("i", self.viterbi(segment)).tobytes()
        size = 200 + 2 * len(segment) + len(ids)
        if self.held + size <= REMEMBERED:
            self.held += size
            self[segment] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def viterbi(self, segment: str) -> list[int]:
        """Ids of the best path; of equal paths into a position, the one with the longer last piece."""
        at = len(segment)
        best = [0.0] + [float("-inf")] * at
        back: list = [None] * (at + 1)
        bare = self.bare(segment) is not None
        done = 0
        for end, piece in self.automaton.iter(segment):  # at each end from the longest piece to the shortest
            if not bare:
                done = self._settle(segment, done, end, best, back)
            end += 1
            score = best[end - piece[0]] + piece[1]
            if score > best[end]:
                best[end], back[end] = score, piece
        if not bare:
            self._settle(segment, done, at, best, back)
        ids: list[int] = []
        while at:
            size, _, k = back[at]
            if k >= 0:
                ids.append(k)
            else:
                ids += [self.byte_id.get(b, self.unknown) for b in reversed(segment[at - 1].encode())]
            at -= size
        ids.reverse()
        return ids

    def _settle(self, segment: str, done: int, to: int, best: list[float], back: list) -> int:
        """Nothing more ends at the positions up to ``to``: may bytes reach them better?"""
        for at in range(done, to):
            score = best[at] + self.byte_score * len(segment[at].encode())
            if score > best[at + 1]:
                best[at + 1], back[at + 1] = score, (1, score, -1)
        return max(done, to)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as int32 bytes. A space is put before it, as the model does; a space mark
        that the text itself holds goes as bytes, so that it is told from a space."""
        if not text:
            return b""
        first, *more = text.split(MARK)
        literal = array("i", [self.byte_id.get(b, self.unknown) for b in MARK.encode()]).tobytes()
        out = b"".join(map(self.__getitem__, self.segments(MARK + first.replace(" ", MARK))))
        for part in more:
            out += literal + b"".join(map(self.__getitem__, self.segments(part.replace(" ", MARK))))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(read_model(path))


@lru_cache(maxsize=2)
def _piece_bytes(path: str) -> list[bytes]:
    table = {2: lambda p: b" \xe2\x81\x87 ", 3: lambda p: b"", 6: lambda p: bytes([int(p[3:5], 16)])}
    return [table.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in read_model(path)]


def decode_ids(path: str, ids: list[int]) -> str:
    """Text of a sequence of ids, without the space put before it."""
    table = _piece_bytes(path)
    try:
        raw = b"".join([table[k] for k in ids]) if not ids or min(ids) >= 0 else None
    except IndexError:
        raw = None
    if raw is None:  # ids that the model doesn't have
        raw = b"".join([table[k] if 0 <= k < len(table) else b" \xe2\x81\x87 " for k in ids])
    return raw.decode("utf-8", "replace")[raw[:1] == b" " :]


def _flat(encoded: list[bytes | None]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    offsets, at = [], 0
    for e in encoded:
        offsets.append(None if e is None else at)
        at += len(e or b"") // 4
    values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(e for e in encoded if e is not None))])
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


def _mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], columns: dict[str, T.DataType], model: str) -> DataFrame:
    """mapInArrow that appends columns in place of those with their names; a task ends without what it remembered."""
    kept = df.drop(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], [*batch.schema.names, *columns])
        finally:
            if encoder.cache_info().currsize:
                encoder(model).forget()

    return map_batches(kept, run, T.StructType([*kept.schema.fields, *(T.StructField(name, kind) for name, kind in columns.items())]))


IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """Adds ``ids``, the piece ids of the whole text."""
    place = docs.drop("ids").columns.index(text_col)

    def ids(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = encoder(model)
        return [_flat([None if t is None else coder.encode(t) for t in batch.column(place).to_pylist()])]

    return _mapped(docs, ids, {"ids": IDS}, model)


def decode(docs: DataFrame, model: str = MODEL, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``decoded``, the text of the ids in ``ids_col``."""
    place = docs.drop(out).columns.index(ids_col)

    def texts(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column(place)
        ends = lists.offsets.to_pylist()
        flat = lists.values.slice(ends[0], ends[-1] - ends[0]).fill_null(-1).to_numpy().tolist()
        return [pa.array([None if gone else decode_ids(model, flat[a - ends[0] : b - ends[0]]) for gone, a, b in zip(lists.is_null().to_pylist(), ends, ends[1:])], pa.string())]

    return _mapped(docs, texts, {out: T.StringType()}, model)


def round_trip(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded``, as ``decode(encode(docs))`` does, in one pass over the rows."""
    place = docs.drop("ids", "decoded").columns.index(text_col)

    def both(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = encoder(model)
        encoded = [None if t is None else coder.encode(t) for t in batch.column(place).to_pylist()]
        return [_flat(encoded), pa.array([None if e is None else decode_ids(model, array("i", e).tolist()) for e in encoded], pa.string())]

    return _mapped(docs, both, {"ids": IDS, "decoded": T.StringType()}, model)


def digest(encoded: DataFrame, decoded: bool = False) -> DataFrame:
    """``doc_id, n_chars, n_pieces, ids_crc32, exact``: what the pieces are, and whether they decode to the text.

    ``encoded`` has ``doc_id, text, ids`` and, if ``decoded`` is true, the column of that name from ``round_trip``."""
    ids = F.col("ids")
    known = encoded.select("doc_id", "text", "ids", "decoded") if decoded else decode(encoded.select("doc_id", "text", "ids"))
    return known.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size(ids).cast("long").alias("n_pieces"),
        F.crc32(F.array_join(ids, " ").cast("binary")).alias("ids_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("exact"),
    )
