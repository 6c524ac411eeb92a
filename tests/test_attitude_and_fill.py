"""Carried attitudes, polygon fill and windowed similarity against plain loops; hot groups over many tasks."""

import random

import numpy as np
from pyspark.sql import functions as F

from orbitweave.operators import attitude, imaging, spatial


def _times(p, q):
    (a, b, c, d), (e, f, g, h) = p, q
    return (a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def _unit(rng):
    q = rng.normal(size=4)
    return tuple((q / np.linalg.norm(q)).tolist())


def test_attitudes_equal_a_serial_fold_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "hot" if k % 3 else [None, "a", "b"][k % 9 // 3], int(rng.integers(0, 500)), None if k % 101 == 0 else _unit(rng), "x") for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, key string, t long, q struct<w: double, x: double, y: double, z: double>, before string")
    got = {r.id: r for r in attitude.carried(df, ["key"], ["t", "id"], "q", rows_per_range=150).collect()}
    assert len(got) == len(rows)
    state = {}
    for k, key, _, q, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        before = state.get(key, (1.0, 0.0, 0.0, 0.0))
        after = _times(before, q) if q else before
        state[key] = after
        assert np.allclose(tuple(got[k].before), before, atol=1e-9) and np.allclose(tuple(got[k].after), after, atol=1e-9)


def test_attitudes_of_a_long_group_are_many_tasks(spark):
    df = spark.range(60_000).select("id", F.lit(1).alias("key"), attitude.turn(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z")), F.lit(0.01)).alias("q"))
    out = attitude.carried(df, ["key"], ["id"], "q", rows_per_range=5_000)
    last = out.orderBy(F.desc("id")).first()
    assert np.allclose((last.after.w, last.after.z), (np.cos(np.radians(300.0)), np.sin(np.radians(300.0))), atol=1e-9)
    assert attitude.carried(df.limit(0), ["key"], ["id"], "q").count() == 0


def _inside(lat, lon, rings):
    n = 0
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a[0] > lat) != (b[0] > lat) and a[1] + (lat - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) > lon:
                n += 1
    return n % 2 == 1


def test_fill_equals_a_test_of_every_cell(spark):
    rng = random.Random(8)
    polygons = []
    for k in range(12):
        lat, lon = rng.uniform(-80, 80), rng.uniform(-170, 170)
        ring = lambda size, n: [(lat + size * rng.uniform(0.5, 1) * np.sin(2 * np.pi * i / n), lon + size * rng.uniform(0.5, 1) * np.cos(2 * np.pi * i / n)) for i in range(n)]  # noqa: B023, E731
        polygons.append((k, [[(float(a), float(b)) for a, b in r] for r in (ring(9, 13), ring(3, 5)[::-1])]))
    polygons += [(90, [[(0.0, 0.0), (1.0, 1.0)]]), (91, []), (92, None), (93, [[(0.0, 0.0), (None, 5.0), (5.0, 0.0)]]), (94, [[(-95.0, 0.2), (95.0, 0.2), (95.0, 3.7), (-95.0, 3.7)]])]
    df = spark.createDataFrame(polygons, "id int, rings array<array<struct<lat: double, lon: double>>>")
    got = {(r.id, r.row, c) for r in spatial.polygon_runs(df, ["id"], "rings", 1.0).collect() for c in range(r.first_col, r.last_col + 1)}
    want = {(k, r, c) for k, rings in polygons if rings and k not in (90, 93) for r in range(180) for c in range(-20, 380) if _inside(89.5 - r, c - 179.5, rings)}
    assert got == want and len(want) > 1000
    cells = {(r.row, r.col) for r in spatial.burn_polygons(df, "rings", 1.0).collect()}
    assert cells == {(r, c % 360) for _, r, c in want}


def test_fill_works_with_edges_and_runs(spark):
    """A ring of very many vertices round a large area: runs, not cells, are listed."""
    ring = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct((60.0 * F.sin(i * (2 * np.pi / 20_000))).alias("lat"), (100.0 * F.cos(i * (2 * np.pi / 20_000))).alias("lon")))
    runs = spatial.polygon_runs(spark.range(1).select("id", F.array(ring).alias("rings")), ["id"], "rings", 0.05)
    n, cells = runs.agg(F.count("*"), F.sum(F.col("last_col") - F.col("first_col") + 1)).first()
    assert n == 2400 and abs(cells - np.pi * 60 * 100 / 0.05**2) < 5000


def _ssim(x, y, side, window, span=255.0):
    n, c1, c2, out = window * window, (0.01 * span) ** 2, (0.03 * span) ** 2, []
    for i in range(side - window + 1):
        for j in range(side - window + 1):
            a, b = x[i : i + window, j : j + window].ravel(), y[i : i + window, j : j + window].ravel()
            cov = ((a - a.mean()) * (b - b.mean())).sum() / (n - 1)
            out.append((2 * a.mean() * b.mean() + c1) * (2 * cov + c2) / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (a.var(ddof=1) + b.var(ddof=1) + c2)))
    return float(np.mean(out))


def test_best_windowed_match_equals_every_score(spark):
    rng = np.random.default_rng(5)
    side, window = 6, 3
    images = [rng.integers(0, 256, (side, side)) for _ in range(20)] + [np.zeros((side, side), dtype=int), np.full((side, side), 255)]
    queries = [np.clip(np.rot90(images[k], -(k % 4)) + rng.integers(-40, 40, (side, side)), 0, 255) for k in range(6)] + [images[20]]
    table = lambda rows: spark.createDataFrame([(k, i.ravel().tolist()) for k, i in enumerate(rows)] + [(99, None), (98, [1, 2])], "id int, v array<int>")
    for block in (50_000, 4):
        got = {r.query: r for r in imaging.best_windowed_match(table(queries), table(images), "id", "v", side, window, block_rows=block).collect()}
        assert set(got) == set(range(len(queries)))
        for k, q in enumerate(queries):
            score, match, angle = max((round(_ssim(q, np.rot90(c, t), side, window), 9), -m, -90 * t) for m, c in enumerate(images) for t in range(4))
            assert (got[k].match, got[k].angle) == (-match, -angle) and abs(got[k].score - score) < 1e-8


def test_similarity_bound_is_never_below(spark):
    rng = np.random.default_rng(6)
    pairs = [(k, rng.integers(0, 256, 25).tolist(), rng.integers(0, int(rng.integers(2, 256)), 25).tolist()) for k in range(100)]
    df = spark.createDataFrame(pairs, "id int, a array<int>, b array<int>")
    m = lambda c: imaging.window_moments(F.col(c), 5, 3)
    for r in df.select(imaging.similarity_bound(m("a"), m("b"), 255.0).alias("most"), imaging.windowed_similarity(F.col("a"), F.col("b"), m("a"), m("b"), 5, 3, 255.0).alias("s")).collect():
        assert r.most >= r.s - imaging.SLACK


def test_points_of_a_dense_cell_are_dealt_over_parts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, float(rng.uniform(10, 10.9)), float(rng.uniform(20, 20.9))) for k in range(3000)] + [(5000 + k, float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for k in range(300)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    centres = spark.createDataFrame([(k, float(rng.uniform(9, 12)), float(rng.uniform(19, 22))) for k in range(15)], "c long, clat double, clon double")
    near = lambda: spatial.within_distance(points, centres, ("lat", "lon"), ("clat", "clon"), 60_000.0, 1.0)
    want = sorted((r.id, r.c) for r in near().collect())
    monkeypatch.setattr(spatial, "DENSE_POINTS", 100)
    assert sorted((r.id, r.c) for r in near().collect()) == want and len(want) > 1000
    cell = points.select("*", F.floor("lat").alias("r"), F.floor("lon").alias("q"))
    placed, listed = spatial._dealt(cell, centres.select("c", F.lit(10).cast("long").alias("r"), F.lit(20).cast("long").alias("q")), ["r", "q"])
    assert max(r["count"] for r in placed.groupBy("r", "q", "__part").count().collect()) < 160  # 30 parts of 100 on average
    assert listed.count() == 15 * 30 and placed.count() == len(rows)
