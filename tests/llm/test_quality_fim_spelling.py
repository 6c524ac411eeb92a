"""Quality scores, fill-in-middle and spelling variants: against SQL, plain loops, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.llm import fim, quality, queries, spelling

DOCS = "doc_id long, text string, lang string"
ODD = [(1, None, "en"), (2, "", "en"), (3, "   \n ", None), (None, "thereafter we went", "en"), (5, "x" * 5000, "en"), (6, "same words again", "en"), (6, "same words again", "en"), (7, "a<P>b", "en")]


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_anagram_spelling_variants"])
def test_query_equals_sql(name, spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    relation = con.sql(queries.ORACLE_SQL[name])
    assert df.columns == relation.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(relation.fetchall(), key=repr)


# ---- fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(fim.UNIT, text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_plain_loop_and_restores(spark):
    rng = random.Random(3)
    alphabet = ["a", "é", "<", "<P", "S>", ">", "\U0001f600", " ", "\t", "\n", "\x0b", " ", "M", "<S>"]
    rows = [(k, "".join(rng.choices(alphabet, weights=[5] * 13 + [0.3], k=rng.randint(0, 40))), "en") for k in range(600)] + ODD
    got = fim.restore(fim.arrange(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    want = Counter((i, lang, *plain_fim(i, t), t or "") for i, t, lang in rows)
    assert Counter((r.doc_id, r.lang, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "one two three", "x", 9)], "doc_id long, text string, output string, n int")
    assert fim.arrange(docs).columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.digest(fim.arrange(docs.limit(0))).count() == 0


def test_fim_very_long_text_stays_in_the_jvm(spark):
    rows = [(k, "word  " * 200_000, "en") for k in range(4)]
    df = fim.digest(fim.arrange(spark.createDataFrame(rows, DOCS)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert all(r.restored_sha256 == hashlib.sha256(b"word  " * 200_000).hexdigest() and r.n == 200_001 for r in df.collect())


# ---- spelling variants


def plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    less = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return a in less(b) or b in less(a)

    out, forms = {}, {}
    for w, n in counts.items():
        close = sorted((v for v in counts if abs(len(v) - len(w)) < 2 and v != w and near(v, w)), key=lambda v: (-counts[v], v))
        forms[w] = close[0] if close and counts[close[0]] >= 2 * n else None
        out[w] = len(close)
    result = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        result.add((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return result


def test_variants_equal_plain_loop(spark):
    rng = random.Random(11)
    stems = ["thering", "thereing", "thring", "elbow", "below", "bowel", "éclair", "eclair", "ÉCLAIR", "×÷×÷×", "aaaaa", "aaaaaa", "aaaab", "baaaa", "straße", "strasse"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abeë") + w[at + 1 :], w[:at] + rng.choice("abeë") + w[at:]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((k if k % 50 else None, rng.choice([" ", "-", "1", " ŷ "]).join(words)))
    rows += [(1000, " ".join(["walle"] * 3 + ["wallen"] * 6 + ["wallens"] * 12 + ["wallenst"] * 24))]
    rows += [(i, t) for i, t, _ in ODD]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    want = plain_variants(rows)
    got = [tuple(r) for r in spelling.variant_forms(spelling.count_words(docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[1] != r[2] for r in want)


def test_words_of_one_anagram_key_with_most_rows(spark):
    """Two thirds of the words have the same letters; each near pair is met once."""
    rng = random.Random(2)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(600)} | {"".join(rng.choices("abcdefgh", k=rng.randint(7, 9))) for _ in range(300)}
    pairs = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    less = lambda w: [(k, w[:k] + w[k + 1 :]) for k in range(len(w))]
    want = {(a, b) for a in words for b in words if a != b and ((len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (len(a) == len(b) + 1 and b in [x for _, x in less(a)]) or (len(b) == len(a) + 1 and a in [x for _, x in less(b)]))}
    got = [tuple(r) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == want


def test_tables_of_counts_are_passed_on_when_full(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "alpha beta gamma delta epsilon") for k in range(40)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, spelling.count_words(docs).collect()))
    monkeypatch.setattr(spelling, "TABLE_WORDS", 2)
    assert sorted(map(tuple, spelling.count_words(docs).collect())) == want
    assert spelling.variant_forms(spelling.count_words(docs.limit(0))).count() == 0


def test_differences_of_fifth_powers_are_distinct():
    v = np.arange(1, 91, dtype=np.int64) ** 5
    gaps = (v[:, None] - v[None, :])[~np.eye(90, dtype=bool)]
    assert len(np.unique(gaps)) == len(gaps)


# ---- quality


def plain_features(text):
    words = (text or "").replace("\x0b", " ").split(" ") if text is None else re.split(r"[ \t\n\v\f\r]+", text.strip(" \t\n\v\f\r"))
    words = [w for w in words if w]
    grams = [g for w in words for n in quality.GRAMS for g in [f" {w} "[k : k + n] for k in range(len(w) + 3 - n)]]
    return len(words) + len(grams) + sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)


def test_features_are_counted_as_by_a_plain_loop():
    for text in ("one two two é\tétude", "", "   ", "a", "ab", "x" * 50, "one one one", "\U0001f600 \U0001f600"):
        total, words = plain_features(text)
        at, counts = quality.counted(text)
        assert counts.sum() == total, text
    # Runs of equal code points fall into one bucket, wherever they stand.
    assert set(quality.counted("abcde")[0]) & set(quality.counted("xabcdex")[0])
    long = "word " * 40_000
    assert quality.counted(long)[1].sum() >= 40_000 * 8 and len(list(quality.pieces(long))) > 1 and "".join(quality.pieces(long)) == long
    assert "".join(quality.pieces("y" * 200_000)) == "y" * 200_000


def test_scores_are_the_softmax_of_averaged_vectors(spark):
    rng = np.random.default_rng(0)
    good, bad = "the river runs along the old wall", "b&&y n$$w ch##p"
    texts = [" ".join(rng.permutation((good if k % 2 else bad).split())) for k in range(60)]
    rows = [quality.counted(t) for t in texts]
    model = quality.train_sgd(rows, [k % 2 for k in range(60)])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, "", " ", "new words " * 30_000])], "doc_id long, text string")
    for r in quality.score(docs, model).collect():
        x = model.embed(r.text) @ model.layer + model.bias
        assert r.score == pytest.approx(float(quality.softmax(x)[1]), abs=1e-4)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(got[k] for k in range(1, 60, 2)) > 0.5 > max(got[k] for k in range(0, 60, 2)) and got[60] == got[61] == got[62]


def test_quality_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_subword_quality_scores"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) >= 0.93
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame([(6, 1), (6, 0), (5, None), (None, 1), (2, 0)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    none = quality.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "same text")] * 500 + [(k, f"text {k}") for k in range(2, 300)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    real, quality.train_sgd = quality.train_sgd, lambda rows, y, **kw: seen.append(len(rows)) or real(rows, y, **kw)
    try:
        quality.train(docs, labels, sample=50)
    finally:
        quality.train_sgd = real
    assert seen == [50]
