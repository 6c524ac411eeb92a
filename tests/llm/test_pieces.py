"""Piece ids: exact round trips, and the best path against brute force."""

import random

import pytest

from orbitweave.llm import pieces


def brute(coder, table, text):
    """Best score of any segmentation, by dynamic programming over all substrings."""
    text = pieces.MARK + text.replace(" ", pieces.MARK)
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + coder.byte_score * len(text[end - 1].encode())
        for start in range(max(0, end - 64), end):
            if text[start:end] in table:
                best[end] = max(best[end], best[start] + table[text[start:end]])
    return best[-1]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(pieces.MODEL)


def test_viterbi_is_the_best_path(model, spark, sf_dir):
    coder = pieces.encoder(pieces.MODEL)
    table = {p: s for p, s, kind in model if kind == 1}
    texts = [r.text[:300] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab  tion\n\tÉ漢字😀the") for _ in range(40)) for _ in range(60)]
    for text in texts:
        ids = memoryview(coder.encode(text)).cast("i").tolist()
        score = sum(coder.byte_score if model[k][2] == 6 else model[k][1] for k in ids)
        assert score == pytest.approx(brute(coder, table, text))
        assert pieces.decode_ids(pieces.MODEL, ids) == text


def test_round_trip_of_odd_texts(spark):
    texts = [None, "", " ", "  two  spaces ", "\n\n", "▁mark ▁ here", "\x00\x01 é 漢字 😀​", "x" * 60_000, " lead", "tail ", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' AS ids", "1 AS decoded")
    rows = sorted(pieces.decode(pieces.encode(df)).collect())
    assert [r.decoded for r in rows] == texts
    assert [r.ids is None for r in rows] == [t is None for t in texts]
    assert pieces.encode(df.limit(0)).collect() == []
    assert {r.exact for r in pieces.digest(pieces.encode(df)).collect()} == {True}


def test_unknown_ids(spark):
    df = spark.createDataFrame([([10**6, -1, None],)], "ids array<int>")
    assert "⁇" in pieces.decode(df).first().decoded
