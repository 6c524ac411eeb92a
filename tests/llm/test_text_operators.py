"""Licenses, perspectives, fingerprints, shards, language ID and decontamination on small cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.llm import decontam, fingerprint, interpolation, langid, licenses, perspectives, sharding


# Licenses.
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            row[k], last = (last + 1 if x == y else max(row[k], row[k - 1])), row[k]
    return row[-1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 14))] for _ in range(2))
        m = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))
        assert len(m) <= lcs(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(m) == lcs(a, b)
    assert len(licenses.patience(list("abcde"), list("abcde"))) == 5


def test_license_lines_are_found_with_their_places(spark):
    text = "Prose before.\nThis work is licensed under the GNU General Public License, version 3.\nMore.\nReleased under the MIT License.\nReleased under the MIT license!\nNo license here, all the rights are not."
    rows = [(1, text), (2, None), (3, ""), (4, "rights reserved " * 50), (5, "İ" * 20 + " All rights reserved."), (6, "x " * 50_000 + "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    out = sorted((r.doc_id, r.license, dict(rows)[r.doc_id][r.start_char : r.end_char]) for r in licenses.scan_licenses(df).collect())
    assert out == [
        (1, "GPL-3.0", "licensed under the GNU General Public License, version 3"),
        (1, "MIT", "Released under the MIT License"),
        (1, "MIT", "Released under the MIT license"),
        (5, "proprietary", "All rights reserved"),
        (6, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ]
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_every_planted_license_line(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = {"proprietary": "All rights reserved.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    want = Counter((r.doc_id, n) for r in docs.collect() for n, line in lines.items() for _ in range(r.text.count(line)))
    assert Counter((r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()) == want


def test_licenses_that_differ_by_a_word():
    names = lambda text: [m[0] for m in licenses.scan_text(text)]
    cases = {
        "Released under the BSD License": ["BSD-notice"],
        "Licensed under CC BY 4.0": ["CC-BY-4.0-notice"],
        "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
        "Licensed under CC BY-NC-SA 4.0": ["CC-BY-NC-SA-4.0"],
        "licensed under the GNU General Public License, version 2": ["GPL-2.0"],
        "licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0"],
        "licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
        "Licensed under the Apache License, Version 1.1": [],
        "Released under the XYZ License": [],
        licenses.TEMPLATES["Apache-2.0-header"]: ["Apache-2.0-header"],
    }
    assert {text: names(f"Some words before. {text}. And after.") for text in cases} == cases
    both = "licensed under the GNU Lesser General Public License, version 3. It is licensed under the GNU General Public License, version 3."
    assert sorted(names(both)) == ["GPL-3.0", "LGPL-3.0"]


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES if n.endswith("-text")])
def test_whole_license_texts(name):
    body = licenses.TEMPLATES[name].split()
    changed = " ".join(w for k, w in enumerate(body) if k % 29 != 28)
    for text in (" ".join(body), changed):
        found = licenses.scan_text(f"Prose before it. {text} Prose after it.")
        assert [m[0] for m in found] == [name]


@pytest.mark.parametrize("name", ["MIT-grant", "BSD", "GPL-3.0", "Apache-2.0-header", "MIT-text", "BSD-3-Clause-text"])
def test_inserted_words_hide_no_license(name):
    body = licenses.TEMPLATES[name].split()
    for each in (1, 2, 3):
        text = " ".join(w if k % each else f"{w} foreign{k}" for k, w in enumerate(body))
        found = licenses.scan_text(f"Prose before it. {text} Prose after it.")
        assert [m[0] for m in found] == [name] and found[0][3] > 0.99
    assert [m for m in licenses.scan_text("All of my pages and here the many rights that one and all have reserved")] == []


def test_edited_notices_against_every_window():
    rng = random.Random(12)
    names = ["MIT-grant", "BSD", "MPL-2.0", "GPL-header", "Unlicense"]
    missed = total = 0
    for _ in range(150):
        name = rng.choice(names)
        template = licenses.word_list(licenses.TEMPLATES[name])
        text = [w for w in template if rng.random() > 0.15]
        for _ in range(rng.randrange(6)):
            text.insert(rng.randrange(len(text) + 1), rng.choice([*template, "x", "y"]))
        text = [f"p{k}" for k in range(20)] + text + [f"q{k}" for k in range(20)]
        reach = range(20, len(text) - 20 + 1)
        best = max((len(licenses.patience(text[a:b], template)) for a in reach for b in reach if len(template) * 0.8 <= b - a), default=0)
        if best >= 0.8 * len(template):
            total += 1
            missed += not licenses.scan_text(" ".join(text), {"without naming words": licenses.TEMPLATES[name]})
    assert total > 60 and missed <= total // 50


# Perspectives.
def test_masks_cover_exactly_the_assistant(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello <|im_end|>"), (1, 2, "bob", "hello <|im_end|>"), (1, 3, None, None), (1, 300, "ann", "later"), (2, 0, "system", "alone"), (None, None, "cy", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    out = {(r.conv_id, r.perspective, r.part): r for r in perspectives.rotate(df).collect()}
    assert set(out) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (None, "cy", 0)}
    ann = out[1, "ann", 0]
    assert ann.rendered == (
        "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nhello < |im_end|><|im_end|>\n"
        "<|im_start|>user name=bob\nhello < |im_end|><|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n"
    )
    assert [ann.rendered[s.start : s.end] for s in ann.spans] == ["hi<|im_end|>"]
    bob = out[1, "bob", 0]
    assert [bob.rendered[s.start : s.end] for s in bob.spans] == ["hello < |im_end|><|im_end|>"] * 2 and (bob.n_turns, bob.n_trained) == (5, 2)
    assert perspectives.rotate(df.limit(0)).collect() == []


# Fingerprints.
def test_fingerprint_is_homomorphic_and_ignores_order():
    parts = [f"paragraph {k} has some words {k * k}" for k in range(12)]
    whole = fingerprint.fingerprint("\n".join(parts))
    shuffled = parts[:]
    random.Random(2).shuffle(shuffled)
    assert np.array_equal(whole, fingerprint.fingerprint("\n".join(shuffled)))
    assert np.array_equal(fingerprint.delete(fingerprint.insert(whole, ["new one"]), ["new one"]), whole)
    assert not np.array_equal(whole, fingerprint.fingerprint("\n".join(parts[1:] + parts[-1:])))
    assert fingerprint.likeness(whole, whole) == 1.0


def test_fingerprint_query_against_plain_python(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5002, "tiny"), (5003, "longer than the next " * 40), (5004, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r.doc_id: r for r in fingerprint.fingerprint_documents(df.withColumn("bucket", F.lit("clash")), rows_per_bucket=17).collect()}
    rows.sort()
    assert set(out) == {i for i, _ in rows}
    for (i, text), (_, follows) in zip(rows, [*rows[1:], rows[0]]):
        text, follows = text or "", follows or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + follows[:cut]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprint.encode(fingerprint.fingerprint(text))
        assert r.edited_fingerprint == fingerprint.encode(fingerprint.fingerprint(new))
        assert r.near_next == fingerprint.likeness(fingerprint.fingerprint(text), fingerprint.fingerprint(follows))
    long = [r for r in out.values() if 400 < r.n_chars]
    assert np.mean([r.near_edited for r in long]) > 0.6 > 0.2 > np.mean([r.near_next for r in long])


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprint.fingerprint_documents(spark.createDataFrame([], schema)).collect() == []
    one = fingerprint.fingerprint_documents(spark.createDataFrame([(1, "only one here")], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = fingerprint.fingerprint_documents(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in same) == [(0, 1), (1, 1), (1, 1)]


# Shards.
def plain_lpt(sizes, shards):
    load = [0] * shards
    for s in sorted(sizes, reverse=True):
        load[load.index(min(load))] += s
    return sorted(load)


@pytest.mark.parametrize("sizes", [[5] * 1000, [1000, 1] * 300, list(range(1, 700)), [10**6] + [1] * 5000, [7]])
def test_bulk_dealing_equals_a_pop_for_each_group(sizes):
    classes = sorted(Counter(sizes).items(), reverse=True)
    load = [0] * 24
    for k, shard, a, b in sharding.deal(np.array([s for s, _ in classes], dtype=float), np.array([n for _, n in classes]), 24):
        load[shard] += (b - a) * classes[k][0]
    assert sorted(load) == plain_lpt(sizes, 24)


def test_shards_keep_groups_and_balance(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9000, None), (9001, ""), (None, "n"), (9002, "same"), (9002, "same")], "doc_id long, text string"))
    out = sharding.assign_shards(docs.withColumn("shard", F.lit(3))).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in texts)
    shards, load = defaultdict(list), Counter()
    for r in out:
        shards[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    of = defaultdict(set)
    for r in out:
        of[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    groups = Counter()
    for _, t in texts:
        groups[t] += len(t) + 8
    ideal = plain_lpt(groups.values(), 24)
    assert max(load.values()) <= 1.02 * max(ideal)
    assert sharding.assign_shards(docs.limit(0)).collect() == []


# Language ID.
def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()), per_lang=60)
    assert (model.weights == 0).mean() > 0.2
    out = langid.predict(docs, model).where(langid.held_out()).collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert all(0.0 <= r.score <= 1.0 for r in out)


def test_language_id_of_odd_rows(spark):
    rows = [(1, "plain words are here", "en"), (2, "noch mehr wörter hier", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "words", None), (None, "words", "en"), (1, "plain words are here", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = langid.predict(df, langid.train(df)).collect()
    assert [(r.lang_pred, r.score) for r in out if r.doc_id in (3, 4)] == [("und", 0.0)] * 2
    assert len(out) == len(rows) and {r.lang_pred for r in out} <= {"en", "de", "und"}
    empty = langid.train(df.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, empty).collect()} == {("und", 0.0)}


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 4000)
    logits = rng.normal(0, 1, (4000, 3)) + 1.5 * np.eye(3)[labels]
    t = langid.fit_temperature(5 * logits, labels)
    assert 2.0 < t < 6.0


# Decontamination.
def test_leaks_equal_containment(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    flat = lambda t: " ".join(t.lower().split())
    items = [(r.item_id, flat(r.text)) for r in bench.collect()]
    inside = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in flat(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert inside <= got and len(got - inside) <= 1


def test_paraphrases_and_odd_rows(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k:03d}" for k in range(400)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    changed = [w if k % 5 else rng.choice(vocabulary) for k, w in enumerate(item)]
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(filler(70) + item + filler(50)), " ".join(filler(33) + changed + filler(10)), " ".join(filler(200)), None, "", " ".join(item[:12])]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[0])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "short one"), (10, " ".join(filler(150)))], "item_id long, text string")
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.kind) for r in decontam.find_leaks(docs, bench).collect())
    assert out == [(-1, 7, "copy"), (0, 7, "copy"), (1, 7, "copy")] or out == [(-1, 7, "copy"), (0, 7, "copy"), (1, 7, "paraphrase")]
    assert decontam.find_leaks(docs.limit(0), bench).collect() == [] and decontam.find_leaks(docs, bench.limit(0)).collect() == []


def test_every_item_of_a_large_benchmark_is_found(spark):
    rng = random.Random(8)
    weights = [1 / (k + 5) for k in range(20_000)]
    prose = lambda n: rng.choices(range(20_000), weights, k=n)
    text = lambda ws: " ".join(f"w{w}" for w in ws)
    items = [prose(rng.randint(8, 60)) for _ in range(2000)] + [[30_000 + 50 * k + j for j in range(40)] for k in range(20)]
    bench = spark.createDataFrame([(k, text(i)) for k, i in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(k, text(prose(rng.randint(75, 150)) + i + prose(rng.randint(75, 150)))) for k, i in enumerate(items)], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(docs, bench).collect()}
    assert [k for k in range(len(items)) if (k, k) not in got or got[k, k].coverage < 1.0 or got[k, k].kind != "copy"] == []
    assert sum(d != i for d, i in got) < 20


def test_items_outside_the_leading_directions_are_found(spark):
    rng = random.Random(10)
    text = lambda ws: " ".join(f"w{w}" for w in ws)
    thrice = [range(30 * k, 30 * k + 30) for k in range(200)] * 3
    single = [range(10_000 + 20 * k, 10_020 + 20 * k) for k in range(10)]
    bench = spark.createDataFrame([(k, text(i)) for k, i in enumerate([*single, *thrice])], "item_id long, text string")
    host = lambda: rng.sample(range(6000), 90)
    docs = spark.createDataFrame([(k, text([*host(), *i, *host()])) for k, i in enumerate(single)], "doc_id long, text string").repartition(2)
    out = decontam.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in out) == [(k, k, "copy") for k in range(10)]


def test_excerpts_of_long_items_wherever_they_begin(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    item = prose(200)
    rows = [(k, " ".join(prose(40 + k % 30) + item[k : k + 50] + prose(90))) for k in range(151)]
    rows += [(1000, " ".join(prose(60) + item[16:83] + prose(60))), (1001, " ".join(prose(60) + item[45:60] + prose(60)))]
    bench = spark.createDataFrame([(7, " ".join(item)), *((k, " ".join(prose(120))) for k in range(20, 30))], "item_id long, text string")
    out = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.kind) for r in out) == [(k, 7, "copy") for k in (*range(151), 1000)]


def test_short_items_and_scattered_words(spark):
    bench = spark.createDataFrame([(1, "Twelve blue cats"), (2, "who is the tallest of them"), (3, "yes"), (4, "one two three four five six seven eight")], "item_id long, text string")
    scattered = " ".join(w for k in range(8) for w in ["one two three four five six seven eight".split()[k], *[f"z{k}_{j}" for j in range(8)]])
    rows = [
        (1, "prose\n twelve  Blue cats\nmore"), (2, "and twelve blue cats sat"), (3, "twelve blue\ncats"), (4, "see who is the tallest of them now"),
        (5, "yes"), (6, "yes and no"), (7, scattered), (8, "twelve blue"), (9, None), (None, "yes"), (10, "x one two three four five six seven eight y"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.item_id, r.kind) for r in decontam.find_leaks(df, bench).collect()}
    assert out == {(1, 1, "copy"), (2, 1, "mention"), (3, 1, "copy"), (4, 2, "copy"), (5, 3, "copy"), (6, 3, "mention"), (None, 3, "copy"), (10, 4, "copy")}
    only = {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench.where("item_id < 4")).collect()}
    assert only == {(d, i) for d, i, _ in out if i < 4}


def test_recall_of_paraphrases(spark):
    rng = random.Random(21)
    weights = [1 / (k + 3) for k in range(8000)]
    prose = lambda n: rng.choices(range(8000), weights, k=n)
    text = lambda ws: " ".join(f"w{w}" for w in ws)
    items = [prose(rng.randint(12, 60)) for _ in range(260)]
    changed = [[w if k >= len(i) - max(3, len(i) // 4) or rng.random() > 0.3 else rng.randrange(8000, 9000) for k, w in enumerate(i)] for i in items]
    due = [k for k, (i, c) in enumerate(zip(items, changed, strict=True)) if lcs(i, c) >= decontam.PARAPHRASE * len(i)]
    docs = spark.createDataFrame([(k, text(prose(rng.randint(40, 120)) + c + prose(rng.randint(40, 120)))) for k, c in enumerate(changed)], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, spark.createDataFrame([(k, text(i)) for k, i in enumerate(items)], "item_id long, text string")).collect()}
    assert len(due) >= 200 and sum((k, k) in got for k in due) >= 0.97 * len(due)
    assert sum(d != i for d, i in got) <= 5


def test_randomised_svd_against_an_exact_one(spark):
    rng = np.random.default_rng(6)
    topics = [rng.choice(300, 25, replace=False) for _ in range(6)]
    items = [" ".join(f"w{w}" for w in rng.choice(topics[k % 6], 40)) for k in range(90)]
    own = decontam.item_passages(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    hashes = [np.frombuffer(bytes(r.hashes), dtype=np.uint64) for r in own.collect()]
    vocabulary = decontam.Vocabulary(np.unique(np.concatenate(hashes)))
    idf = np.linspace(0.5, 2.0, len(vocabulary.hashes))
    a = np.zeros((len(hashes), len(idf)))
    for k, h in enumerate(hashes):
        np.add.at(a[k], vocabulary.find(h)[1], 1.0)
    a *= idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    exact = np.linalg.svd(a, full_matrices=False)[2][:6].T
    assert np.linalg.svd(exact.T @ decontam.randomised_svd(own, vocabulary, idf, 6), compute_uv=False).min() > 0.99


def test_language_model_against_a_plain_loop():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        at = np.sort(rng.choice(20, 5, replace=False)) + 20 * (k % 3)
        rows.append((at, rng.random(5)))
    labels = [k % 3 for k in range(60)]
    weights, bias = langid.train_ftrl(rows, labels, 3, epochs=2)
    z, n = {}, {}

    def w(f, c):
        zz, l1 = z.get((f, c), 0.0), 0.0 if f == langid.DIM else 0.02
        return 0.0 if abs(zz) <= l1 else -(zz - np.sign(zz) * l1) / ((1.0 + n.get((f, c), 0.0) ** 0.5) / 0.5 + 0.5)

    order = np.random.default_rng(0)
    for _ in range(2):
        for k in order.permutation(60):
            x = {**dict(zip(rows[k][0].tolist(), rows[k][1].tolist())), langid.DIM: 1.0}
            now = {(f, c): w(f, c) for f in x for c in range(3)}
            e = np.exp([sum(v * now[f, c] for f, v in x.items()) for c in range(3)])
            p = e / e.sum()
            for (f, c), own in now.items():
                g = x[f] * (p[c] - (labels[k] == c))
                old = n.get((f, c), 0.0)
                z[f, c] = z.get((f, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / 0.5 * own
                n[f, c] = old + g * g
    assert np.allclose(bias, [w(langid.DIM, c) for c in range(3)], atol=1e-5)
    assert np.allclose(weights[:60], [[w(f, c) for c in range(3)] for f in range(60)], atol=1e-5) and not weights[60:].any()


def test_character_grams_against_a_plain_loop():
    text = "Über 9 naïve cafés – ok"
    padded = "".join([" ", *(c if c.isalpha() else " " for c in text.lower()), " "])
    grams = {padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1)}
    wanted = {g for g in grams if len(g) == 3 or g.strip()}
    at, counts = langid.features(text)
    total = sum(sum(1 for k in range(len(padded) - n + 1) if padded[k : k + n].strip() or n == 3) for n in (1, 2, 3))
    assert counts.sum() == total and 0.9 * len(wanted) <= len(at) <= len(wanted)


def test_latent_space_keeps_cosines():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50, 40).tolist()
    b = [x for x in a if rng.random() < 0.7] + rng.integers(0, 50, 10).tolist()
    assert decontam.lcs(decontam.word_masks(a), len(a), b) == lcs(a, b)


# Pipeline.
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(70_000, None, "en", "s", 0), (70_001, "123 456", "en", "s", 7)], docs.schema)
    docs = docs.unionByName(extra)
    kept = docs
    ids = [{r.doc_id for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), stage(spark, kept, sf_dir).schema)
        ids.append({r.doc_id for r in kept.collect()})
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert kept.columns == docs.columns
    assert ids[0] - ids[1] == {70_000, 70_001}
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[4] == ids[5]
    assert all(r.exact and len(r.ids) == r.n_pieces for r in kept.collect())
    leaks = {r.doc_id for r in decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert not leaks & ids[4]
    assert json.dumps(sorted(ids[4]))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_exact string, pred string, key string"


def test_pipeline_stages_on_empty_tables(spark, sf_dir):
    import corpus_pipeline

    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect() == []


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline

    stages = [stage for _, stage in corpus_pipeline.STAGES]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    prose = [" ".join(f"word{k}{chr(97 + j % 26)}" for j in range(40)) for k in range(4)]
    long = " ".join(f"stretch{k}" for k in range(60_000))
    rows = [(1, prose[0]), (1, prose[0]), (2, prose[0]), (None, f"{prose[1]} {bench}"), (3, f"{prose[2]} {bench}"), (4, None), (5, ""), (6, long), (7, prose[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", "own", "own") for i, t in rows], SCHEMA)
    ids = lambda df: sorted((r.doc_id or 0 for r in df.collect()))
    deduped = stages[1](spark, docs, sf_dir)
    assert {(r.n_exact, r.pred, r.key) for r in deduped.collect()} == {("own",) * 3}
    # A row without an id comes before all others; the second of two equal texts of two ids loses its only line and goes.
    assert ids(deduped) == [0, 1, 1, 3, 4, 5, 6, 7]
    assert ids(stages[2](spark, docs, sf_dir)) == [0, 1, 1, 3, 4, 5, 6, 7]
    assert ids(stages[3](spark, docs, sf_dir)) == [1, 1, 2, 4, 5, 6, 7]
    coded = {(r.doc_id, r.n_pieces is None, r.exact) for r in stages[4](spark, docs, sf_dir).collect()}
    assert coded == {(i, t is None, True) for i, t in rows}
    judged = stages[0](spark, docs, sf_dir)
    assert set(ids(judged)) <= {0, 1, 2, 3, 6, 7} and 4 not in ids(judged) and judged.columns == docs.columns


def test_very_long_texts(spark):
    long = "\n".join(" ".join(f"w{(k * j) % 9973}" for j in range(40)) for k in range(4_000))  # about 1 MB
    docs = spark.createDataFrame([(1, long, "en"), (2, "short", "en"), (3, long + " end", "en")], "doc_id long, text string, lang string")
    item = " ".join(long.split()[90_000:90_030])
    assert {(r.doc_id, r.kind) for r in decontam.find_leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()} == {(1, "copy"), (3, "copy")}
    assert {r.doc_id: r.n_tokens for r in interpolation.score_documents(docs).collect()} == {1: 160_001, 2: 2, 3: 160_002}
    assert {r.doc_id: r["size"] for r in sharding.assign_shards(docs).collect()} == {1: len(long) + 8, 2: 13, 3: len(long) + 12}
    prints = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs).collect()}
    assert prints[1].n_chars == len(long) and prints[1].fingerprint == fingerprint.encode(fingerprint.fingerprint(long))
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()} == {"en"}


def test_messages_of_one_turn_number_are_one_part(spark):
    rows = [(1, 0, "ann", f"t{k:04d}") for k in range(600)] + [(1, None, "bob", "x")]
    out = perspectives.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.perspective, r.part, r.n_turns, r.n_trained) for r in out) == [("ann", 0, 601, 600), ("bob", 0, 601, 1)]


def test_long_parts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(perspectives, "PIECE_ROWS", 50)
    rows = [(None, k % 3 if k % 5 else None, ("ann", "bob", None)[k % 3], f"t{k * 7 % 90}") for k in range(400)] + [(None, 700, "ann", "end")] * 120
    rows += [(7, 1, "ann", "x")] * 50 + [(8, 1, "ann", "y")] * 51 + [(9, 0, "cy", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = perspectives.rotate(df)
    assert not re.findall("EvalPython|InArrow|InPandas|InPython", out._jdf.queryExecution().toString())
    want = {}
    for conv in (None, 7, 8, 9):
        own = sorted((t is not None, t or 0, s is not None, s or "", x) for c, t, s, x in rows if c == conv)
        for part in {t // 256 for _, t, *_ in own}:
            said = [(s, x) for _, t, _, s, x in own if t // 256 == part]
            for who in {s for *_, s, _ in own} - {""}:
                for piece in range(0, len(said), 50):
                    some = said[piece : piece + 50]
                    text = "".join(f"<|im_start|>{'assistant' if s == who else 'user name=' + (s or 'unknown')}\n{x}<|im_end|>\n" for s, x in some)
                    want[conv, who, part, piece // 50] = (text, len(some), sum(s == who for s, _ in some))
    got = out.collect()
    assert len(got) == len(want) and {(r.conv_id, r.perspective, r.part, r.piece): (r.rendered, r.n_turns, r.n_trained) for r in got} == want


def test_words_of_a_long_text_hash_as_in_a_short_one():
    import pyarrow as pa

    from orbitweave.llm import textblocks

    text = " ".join(f"Word{k % 7000}" for k in range(90_000))
    whole, parts = textblocks.words(pa.array([text, "x"])), text.split(" ")
    some = textblocks.words(pa.array([" ".join(parts[60_000:60_100])]))
    assert len(whole.hashes) == 90_001 and np.array_equal(whole.hashes[60_000:60_100], some.hashes)


def test_edited_whole_licenses_and_three_foreign_words():
    """Whole texts with 10 to 18 per cent of words exchanged or dropped, half of them with words put in, are found wherever
    patience covers enough; so is every notice with three foreign words anywhere in it."""
    import random

    from orbitweave.llm import licenses

    rng = random.Random(1)
    filler = "river stone wooden carries slowly bright morning paper harbour winter".split()
    templates = licenses._templates(tuple(licenses.TEMPLATES.items()), licenses.COVERAGE)
    found = covered = 0
    for t in (t for t in templates if t.name.endswith("-text")):
        for k in range(4):
            p, words = rng.uniform(0.1, 0.18), []
            for w in t.words:
                r = rng.random()
                words += [rng.choice(filler)] if r < p / 2 else [] if r < p else [w]
                words += [rng.choice(filler)] if k % 2 and rng.random() < 0.05 else []
            if len(licenses.patience(words, t.words)) >= licenses.COVERAGE * len(t.words):
                covered += 1
                found += t.name in {m[0] for m in licenses.scan_text("intro words here. " + " ".join(words) + " and more text")}
    assert covered >= 40 and found == covered
    for t in templates:
        for at in {1, len(t.words) // 2, len(t.words) - 1}:
            text = " ".join(t.words[:at] + rng.sample(filler, 3) + t.words[at:])
            assert t.name in {m[0] for m in licenses.scan_text(text)}, (t.name, at)


def test_letters_beyond_the_second_plane_and_many_labels(spark, monkeypatch):
    from orbitweave.llm import langid

    flag = "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f"  # tags, no letters
    assert not len(langid.features(flag)[0]) and len(langid.features("\U00020000\U00030000")[0])
    rows = [(k, f"text of label {k % 40} words{k % 40}", f"l{k % 40:02d}") for k in range(200)] + [(1000 + k, "the common words of all", "aa") for k in range(30)]
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "l00", "l01"] and model.weights.shape[1] == 3
    assert model.predict(flag) == (langid.UNKNOWN, 0.0)


def test_items_without_an_id_are_dealt_over_blocks(spark, monkeypatch):
    from orbitweave.llm import decontam

    texts = [f"item number {k} " + " ".join(f"w{k}x{j}" for j in range(40)) for k in range(60)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, t) for t in texts], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    sizes = []
    real = decontam._index
    monkeypatch.setattr(decontam, "_index", lambda own, t: sizes.append(own.select("item_id", "hashes").distinct().count()) or real(own, t))
    got = decontam.find_leaks(docs, benchmark).collect()
    assert {r.doc_id for r in got} == set(range(60)) and len(sizes) > 2
