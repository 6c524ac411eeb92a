"""Near-duplicates and language-model scores against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from orbitweave.llm import interpolation, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_components(rows, threshold=75):
    sets = {}
    for doc_id, text in rows:
        w = tokens(text)
        n = min(5, len(w))
        sets[doc_id] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            by[g].add(d)
    pairs = {p for ds in by.values() for p in combinations(sorted(ds), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_components_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_components(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_near_components_of_a_chain_and_odd_rows(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k + 1, " ".join(base[:k * 2] + [f"x{j}" for j in range(k * 2)] + base[k * 2:])) for k in range(6)]
    rows += [(20, None), (21, "  \n"), (22, "one two"), (23, "One  TWO"), (24, "é" * 50_000), (None, "one two"), (25, " ".join(base)), (25, " ".join(base))]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, component_id string, bucket int")
    out = neardup.near_components(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None}
    assert got == brute_components([r for r in rows if r[0] is not None])
    assert {(r.doc_id, r.component_id, r.kept) for r in out if r.doc_id in (None, 20, 21, 23)} == {(None, None, True), (20, 20, True), (21, 21, True), (23, 22, False)}
    assert neardup.near_components(df.limit(0)).collect() == []


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    y = np.concatenate([x[:350], rng.integers(0, 2**63, 50).astype(np.uint64)])
    a, b = (neardup.samples(np.unique(v)) for v in (x, y))
    assert abs((a == b).mean() - 350 / 450) < 0.12
    odd = [np.unpackbits(neardup.odd_sketch(v).view(np.uint8)) for v in (a, b)]
    differing = (a != b).sum()
    expected = neardup.SKETCH_BITS / 2 * (1 - math.exp(-4 * differing / neardup.SKETCH_BITS))
    assert abs(int((odd[0] ^ odd[1]).sum()) - expected) < 30


@pytest.mark.parametrize("fan", [256, 3])  # one step of the exchange, and three
def test_scores_equal_a_plain_model(spark, sf_dir, fan):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(901, None), (902, "")]
    out = {r.doc_id: r for r in interpolation.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), block_text=60_000, part_keys=3_000, fan=fan).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in docs}
    toks = {i: [*tokens(t), None] for i, t in docs}

    def counts(use):
        one = Counter(w for i in toks if use(fold[i]) for w in toks[i])
        two = Counter(p for i in toks if use(fold[i]) for p in zip([None, *toks[i]], toks[i]))
        return one, two

    one, two = counts(lambda f: f != 2)
    left1, left2 = counts(lambda f: f not in (2, 5))
    n, v = sum(one.values()), len(one)
    # EM with the exact estimates; the operator's grid has a quarter of an octave.
    bucket = lambda c: c.bit_length() if c else 0
    data = defaultdict(Counter)
    for i in toks:
        if fold[i] == 5:
            for h, w in zip([None, *toks[i]], toks[i]):
                data[bucket(left1[h])][(left2[h, w] / max(left1[h], 1), left1[w] / sum(left1.values()), 1 / (len(left1) + 1))] += 1
    weights = {}
    for b, c in data.items():
        w = np.array([0.5, 0.4, 0.1]) if b else np.array([0.0, 0.9, 0.1])
        x, k = np.array(list(c)), np.array(list(c.values()))
        for _ in range(60):
            s = x * w
            s *= (k / s.sum(axis=1))[:, None]
            w = s.sum(axis=0) / k.sum()
        weights[b] = w
    total = [0.0, 0.0]
    for i in toks:
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(toks[i]), sum(one[w] > 0 for w in toks[i]), n, fold[i] == 2)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in toks[i]), rel=1e-9)
        score = sum(math.log10(max(1e-300, float(np.dot(weights.get(bucket(one[h]), [0.5, 0.4, 0.1]), [two[h, w] / max(one[h], 1), one[w] / n, 1 / (v + 1)])))) for h, w in zip([None, *toks[i]], toks[i]))
        assert r.score == pytest.approx(score, rel=0.02, abs=0.5)
        if fold[i] == 2:
            total[0] += r.score
            total[1] += r.base_score
    assert total[0] > total[1]


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    docs = [[*(rng.zipf(1.5, 30) % 50).tolist(), -1] for _ in range(40)]
    one = Counter(w for d in docs for w in d)
    two = Counter(p for d in docs for p in zip([-1, *d], d))
    n, v = sum(one.values()), len(one)
    weights = interpolation.learn_weights(np.array([5 * interpolation._LEVELS**2 + 900, 2 * interpolation._LEVELS**2 + 30]), np.array([7, 9]))
    for h in one:
        words = [*one, "unseen"]
        context = np.full(len(words), one[h])
        p = interpolation.estimates(np.array([two[h, w] for w in words]), context, np.array([one[w] for w in words]), n, v)
        assert (p * weights[interpolation.bucket_of(context)]).sum() == pytest.approx(1.0)


def test_scores_of_odd_tables(spark):
    schema = "doc_id long, text string, score string"
    assert interpolation.score_documents(spark.createDataFrame([], schema)).collect() == []
    rows = interpolation.score_documents(spark.createDataFrame([(None, "a b", "x"), (2, None, "y"), (2, None, "y")], schema)).collect()
    assert [(r.doc_id, r.held_out, r.n_tokens) for r in sorted(rows, key=lambda r: r.doc_id or 0)] == [(None, True, 3), (2, False, 1), (2, False, 1)]
    assert all(math.isfinite(r.score) for r in rows)


@pytest.mark.parametrize("holders", [neardup.HOLDERS, 3])  # one key a shingle, and many
def test_a_large_group_of_differing_copies(spark, monkeypatch, holders):
    import random

    monkeypatch.setattr(neardup, "HOLDERS", holders)
    rng = random.Random(8)
    rows = []
    for group in range(3):
        base = [f"b{group}_{k}" for k in range(90)]
        for _ in range(120):
            w = base[:]
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    want = brute_components(rows)
    assert 30 < len({c for _, c in want.values()}) < 330  # neither one component nor none
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_an_id_with_two_texts_ties_their_groups(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, " ".join(f"c{k}" for k in range(30)))]
    out = neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True)]
