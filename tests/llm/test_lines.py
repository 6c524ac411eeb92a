"""Line dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.llm import linededup


def one_edit(a, b):
    """At most one inserted, deleted or exchanged character."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows, min_chars=linededup.MIN_CHARS):
    lines = [(i, p, line) for i, t in rows if t is not None for p, line in enumerate(t.split("\n"))]
    first = {}
    for i, p, line in sorted(lines, key=lambda x: x[:2]):
        if len(line) >= min_chars:
            first.setdefault(line, (i, p))
    order = sorted(first, key=first.get)
    near = set()
    by = {}
    for line in order:
        keys = {(k, s, line[:s] if k == 0 else line[len(line) - s :]) for n in (len(line), len(line) - 1) for s in (n // 2,) for k in (0, 1)}
        if any(one_edit(line, other) for key in keys for other in by.get(key, ())):
            near.add(line)
        for key in keys:
            by.setdefault(key, []).append(line)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        kept, exact, close = [], 0, 0
        for p, line in enumerate(t.split("\n")):
            e = line in first and first[line] != (i, p)
            n = line in near and not e
            exact, close = exact + e, close + n
            if not e and not n:
                kept.append(line)
        out.append((i, "\n".join(kept), len(t.split("\n")), exact, close))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_exact, r.n_near) for r in linededup.dedup_lines(df).collect()), key=str)


def test_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_every_kind_of_edit_at_every_place(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefgh éß漢"))
    rows, k = [], 0
    for n in (24, 25, 40, 63, 64, 65, 129, 300, 521, 700):
        base = "".join(rng.choice(letters, n))
        rows.append((k, base))
        for _ in range(6):
            at = int(rng.integers(0, n))
            rows += [(k + 1, base[:at] + "X" + base[at:]), (k + 2, base[:at] + base[at + 1 :]), (k + 3, base[:at] + "Y" + base[at + 1 :]), (k + 4, base[:at] + "ZZ" + base[at:])]
            k += 5
    rows = [(i, f"{t}\nshort\n\n{t}") for i, t in rows]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in {i: t for i, t in rows}.items()]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert sum(r[4] for r in brute(rows)) > 100


def test_odd_rows(spark):
    line = "a line that is long enough to count"
    rows = [(1, line, 7), (1, line, 7), (2, None, 7), (3, "", 7), (None, line + "!", 7), (4, line, 7), (5, "x" * 30_000 + "\n" + "x" * 30_001, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th int").withColumn("n_lines", F.lit(9)).withColumn("__x", F.lit(1))
    out = linededup.dedup_lines(df).collect()
    assert {"th", "__x"} <= set(out[0].asDict()) and len(out) == len(rows)
    texts = sorted(((r.doc_id or 0, r.text, r.n_exact, r.n_near) for r in out), key=str)
    assert texts == sorted([(1, "", 0, 1), (1, "", 0, 1), (2, None, 0, 0), (3, "", 0, 0), (0, line + "!", 0, 0), (4, "", 1, 0), (5, "x" * 30_000, 0, 1)], key=str)
    assert linededup.dedup_lines(df.limit(0)).collect() == []


def test_exact_repeats_of_short_lines(spark):
    import corpus_pipeline

    rows = [(1, "a short line\n\n  \nab"), (2, "a short line\n\n  \nac"), (3, "one more\na short line\nab"), (4, "x" * 24 + "\n" + "x" * 23 + "\n" + "x" * 23)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert out == {1: rows[0][1], 2: "\n  \nac", 3: "one more", 4: "x" * 24 + "\n" + "x" * 23}
    assert [r.n_exact for r in linededup.dedup_lines(df).orderBy("doc_id").collect()] == [0, 0, 0, 0]


def test_main_path_is_native(spark, sf_dir):
    plan = linededup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 511, 512, 513, 1000])
def test_blocks_cover_the_line(spark, n):
    df = spark.createDataFrame([("".join(chr(97 + k % 26) for k in range(n)),)], "line string")
    blocks = df.select(F.explode(linededup._blocks(F.col("line"), F.char_length("line") - 1, 1)).alias("b")).select("b.*").collect()
    assert "".join(b.inside for b in sorted(blocks, key=lambda b: b.j)) == df.first().line


@pytest.mark.parametrize("n", [1, 2, 3, 40, 255, 256, 257, 300, 511, 512, 513, 1000])
def test_sides_of_a_variant_hash_alike_with_and_without_the_letter(spark, n):
    """Of a line and the line with one letter more, the block that has the letter has the same sides in both."""
    line = "".join(chr(97 + k * k % 26) for k in range(n))
    places = sorted({0, 1, n // 2, n - 1, n})
    blocks = lambda text, taken: {b.j: b for b in spark.createDataFrame([(text,)], "line string").select(F.explode(linededup._blocks(F.col("line"), F.char_length("line") - taken, taken)).alias("b")).select("b.*").collect()}
    short = blocks(line, 0)
    for at in places:
        long = blocks(line[:at] + "X" + line[at:], 1)
        assert short.keys() == long.keys()
        (j,) = [j for j, b in long.items() if "X" in b.inside]
        assert (short[j].before, short[j].after) == (long[j].before, long[j].after) and long[j].inside.replace("X", "") == short[j].inside


def test_documents_of_many_lines_and_lines_of_many_characters_take_seconds(spark):
    import time

    rng = np.random.default_rng(1)
    many = [f"{x:032x}" for x in rng.integers(0, 1 << 62, 100_000).astype(object) ** 2]
    base = "".join(rng.choice(np.array(list("abcdefgh ")), 200_000))
    rows = [(1, "\n".join(many) + "\n" + many[7]), (2, base), (3, base[:140_000] + "Z" + base[140_000:]), (4, base[:-1]), (5, "Y" + base[1:])]
    began = time.time()
    out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 120
    assert out[1].text == "\n".join(many) and [out[k].text for k in (2, 3, 4, 5)] == [base, "", "", ""] and out[1].n_exact == 1
