"""What keeps work in step with the input: expressions written once, small files dealt over tasks."""

import pytest
from pyspark.sql import functions as F

from orbitweave.functions import vectors as V
from orbitweave.plans import tables


def _size(column):
    return len(column._jc.toString())


def test_a_rotation_holds_its_parts_once(spark):
    a, b = (V.vec(F.col(f"{c}x"), F.col(f"{c}y"), F.col(f"{c}z")) for c in "ab")
    assert _size(V.align(a, a, b)) < 20_000 and _size(V.rotate_about(a, b, F.col("t"))) < 3_000
    row = spark.sql("SELECT 1D AS ax, 0D AS ay, 0D AS az, 0D AS bx, 2D AS by, 0D AS bz, radians(90D) AS t")
    got = row.select(V.align(a, a, b).alias("q"), V.rotate_about(a, V.vec(0, 0, 1), F.col("t")).alias("r"), V.align(a, a, a).alias("same")).first()
    assert all(abs(p - w) < 1e-12 for v in (got.q, got.r) for p, w in zip(v, (0.0, 1.0, 0.0), strict=True)) and tuple(got.same) == (1.0, 0.0, 0.0)


def test_targets_and_satellites_of_one_file_are_many_tasks(spark, sf_dir):
    assert tables.targets(spark, sf_dir).rdd.getNumPartitions() >= 4 and tables.satellites(spark, sf_dir).rdd.getNumPartitions() >= 4


def test_a_ray_is_followed_once(spark):
    from orbitweave.functions import orbit

    r, v = (F.struct(*(F.col(f"{c}{k}").alias(k) for k in "xyz")) for c in "rv")
    assert _size(orbit.boresight(r, v, F.col("days"))) < 1.5 * _size(orbit.ground_hit(r, orbit.pointing(r, v, F.lit(0.0), F.lit(0.0), F.lit(0.0)))) + 8_000


def test_many_pairs_are_many_tasks_of_plain_tests(spark, monkeypatch):
    """Footprints of four corners, across the date line and round the pole: no loop over the ring in the join, and its own number of tasks."""
    from orbitweave.functions import geo
    from orbitweave.operators import spatial

    points = spark.range(4000).select("id", (F.col("id") * 0.618 % 178 - 89).alias("lat"), (F.col("id") * 7.31 % 360 - 180).alias("lon"))
    corner = lambda d: geo.geodesic_step(F.col("clat"), F.col("clon"), F.lit(d), F.lit(1_500_000.0))
    centres = spark.createDataFrame([(0, 85.0, 10.0), (1, -86.0, -179.0), (2, 5.0, 179.5), (3, 40.0, -100.0), (4, -30.0, -179.9)], "c int, clat double, clon double")
    corners = [corner(d) for d in (0.0, 90.0, 180.0, 270.0)]
    rings = centres.withColumn("ring", F.when(F.col("c") == 3, F.array(*corners[:3])).otherwise(F.array(*corners)))
    rings = rings.unionByName(spark.sql("SELECT 9 AS c, 0D AS clat, 0D AS clon, CAST(array(named_struct('lat', 0D, 'lon', 0D)) AS ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>) AS ring"))
    join = lambda: spatial.in_footprint(points, rings, ("lat", "lon"), "ring", 1_500_001.0, ("clat", "clon"), 5.0)
    plain = points.crossJoin(rings).where(geo.point_in_polygon(F.col("lat"), F.col("lon"), F.col("ring"))).where(geo.central_angle(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) * geo.EARTH_RADIUS_M <= 1_500_001.0)
    want = sorted((r.id, r.c) for r in plain.collect())
    monkeypatch.setattr(spatial, "FEW_LISTED", 1)
    monkeypatch.setattr(spatial, "DENSE_PAIRS", 50)
    got = join()
    assert sorted((r.id, r.c) for r in got.collect()) == want and len({c for _, c in want}) == 5
    assert got.rdd.getNumPartitions() >= 4 * spatial.TASKS_PER_CORE
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan.split("Join")[0]


def test_the_join_in_sql_tests_edges_and_not_rings(spark, sf_dir):
    from orbitweave.plans import derived_queries

    plan = derived_queries.fov_join_in_sql(spark, sf_dir)
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString() and "SortMergeJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_best_matches_of_copies_and_blocks_are_the_least_keys(spark):
    """Copies tie exactly, whatever block they are in; a null label meets nobody, a null vector is matched last."""
    from orbitweave.operators import matching

    rows = [(k, [float((k % 40 + 3) ** (j + 1) % 101 + 1) for j in range(8)], k % 2) for k in range(400)] + [(900, [1.0] * 8, None), (901, None, 1)]
    df = spark.createDataFrame(rows, "id long, v array<float>, g int")
    want = {q: min(k for k, c, h in rows if h == g and k != q and c is not None and k % 40 == q % 40) for q, v, g in rows if q % 20 == 0 and g is not None}
    for block in (8192, 30):
        got = matching.best_match(df.where("id % 20 = 0"), df, "id", "v", "g", block_rows=block, block_queries=block)
        assert {r.query: r.match for r in got.collect()} == want
        assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_a_large_polygon_need_no_array(spark):
    from orbitweave.operators import spatial

    edges = spark.sql("SELECT 1 AS id, a_lat, a_lon, b_lat, b_lon FROM VALUES (0D, 0D, 3D, 0D), (3D, 0D, 3D, 4D), (3D, 4D, 0D, 4D), (0D, 4D, 0D, 0D) AS t(a_lat, a_lon, b_lat, b_lon)")
    assert sorted(tuple(r) for r in spatial.edge_runs(edges, ["id"], 1.0).collect()) == [(1, r, 180, 183) for r in (87, 88, 89)]


def test_texts_with_very_many_hits_go_out_in_bounded_batches(spark, monkeypatch):
    from orbitweave.operators import matching

    monkeypatch.setattr(matching, "OUT_BYTES", 1 << 12)
    names = spark.range(2000).select(F.concat(F.lit("name"), F.format_string("%06d", "id")).alias("n"))
    texts = spark.createDataFrame([(0, " ".join(f"name{k:06d}" for k in range(3000))), (1, "name00199"), (2, None), (3, "x" * 100_000 + "name001999")], "id int, t string")
    assert {r.id for r in matching.name_contains(texts, names, "t", "n").collect()} == {0, 3}
    assert {r.id for r in matching.name_contains(texts, names, "t", "n", found=False).collect()} == {1, 2}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_streams_calls_follow_shares_of_targets_not_targets(spark, tmp_path):
    """a state and its timers for each target and day were calls by the million; files for each task were batches by the dozen."""
    from orbitweave.operators import queue
    from orbitweave.streaming import queue as streams

    k = F.col("id")
    rows = spark.range(0, 1600, 1, 16).select(
        F.when(k % 400 > 0, (k % 400).cast("string")).alias("key"), F.when(k % 7 > 0, k).alias("event_id"), F.when(k % 800 < 400, "detection").otherwise("opportunity").alias("kind"), (1_000_000_000 + k * 1_700_000 + F.when(k >= 1200, 900_000_000).otherwise(0)).alias("t_us")
    ).withColumn("ts", F.timestamp_micros("t_us"))
    folder = tmp_path / "in"
    late = streams.write_slices(rows, "ts", "t_us", str(folder), 3)
    assert len(list(folder.glob("*.parquet"))) == 4
    stream = streams.stream_queue(streams.read_slices(spark, str(folder), rows.schema, 1), "ts", 300, 1200, f"{late} seconds", 2)
    query = streams.write_queue(stream, str(tmp_path / "seen"), str(tmp_path / "marks"))
    timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < sum(timers) < 100  # some 1,000 with a state for each target
    got = sorted((r.key or "", r.event_id or -1, r.detected_us, r.seen_us) for r in spark.read.schema(streams.VIEWS).parquet(str(tmp_path / "seen")).collect())
    kind = lambda w: rows.where(F.col("kind") == w).select(F.coalesce("key", F.lit("")).alias("key"), "event_id", F.col("t_us").alias("t"))
    batch = queue.observation_queue(kind("detection"), kind("opportunity"), ["key"], "t", "t", 300, 1200)
    assert got == sorted((r.key, r.event_id or -1, r.detected_us, r.t) for r in batch.collect())
    assert len(got) > 300


def test_a_document_is_written_without_numbering_its_rows(spark, tmp_path):
    """rows were numbered by a shuffle that the ranges' sample ran a second time, and read by a Python object for each brace."""
    import json

    from orbitweave.sources import documents

    rows = spark.createDataFrame([(n, s) for n in (3, 1, 2, None, None, 1, 40, 41, 42) for s in ("b", "a", "a")], "id int, s string")
    wide = spark.range(0, 500, 1, 5).select((F.lit(2**60) - F.col("id")).alias("id"))
    tables = {"none": rows.where("id = 9"), "rows": rows, "wide": wide, "one": rows.where("id = 3 AND s = 'b'")}
    plan = documents.document_lines(tables, "id", 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 4  # of the least number's rows alone; before: joins with counts of ranges
    for n in (1, 7):
        documents.write_document(tables, "id", path := str(tmp_path / str(n)), n)
        doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / str(n)).glob("part-*"))))
        assert doc["none"] == [] and doc["one"] == [{"id": 3, "s": "b"}] and [r["id"] for r in doc["wide"]] == sorted(2**60 - k for k in range(500))
        assert [(r.get("id", 0), r["s"]) for r in doc["rows"]] == sorted((k or 0, s) for k, s in rows.collect())
        back = documents.read_objects(spark, path, True).where("section = 'rows'").orderBy("ordinal").collect()
        assert [json.loads(r.json) for r in back] == doc["rows"]


def _shuffles(node):
    """Columns of each shuffle that a query asks for, by name."""
    own = [sorted(node.output().apply(k).name() for k in range(node.output().size()))] if node.nodeName() == "RepartitionByExpression" else []
    return own + [s for k in range(node.children().size()) for s in _shuffles(node.children().apply(k))]


@pytest.mark.parametrize("name", ["elevation_visibility", "tip_footprint_join_grid", "footprint_polygon_join", "fov_join_in_sql"])
def test_a_pair_query_shuffles_keys_and_cells_alone(name, spark, sf_dir, monkeypatch):
    """Places, unit vectors and edges were carried for each cell that a satellite can reach and each part of it."""
    from orbitweave import plans
    from orbitweave.operators import spatial

    plain = sorted(map(tuple, plans.QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(spatial, "FEW_LISTED", 1)
    df = plans.QUERIES[name](spark, sf_dir)
    dealt = [s for s in _shuffles(df._jdf.queryExecution().optimizedPlan()) if "__part" in s]
    assert len(dealt) == 2 and all(set(s) <= {"whale_id", "sat", "__cell", "__part", "cell_row", "cell_col"} for s in dealt)
    assert sorted(map(tuple, df.collect())) == plain and plain


def test_copies_of_a_dense_cell_are_bounded(spark, monkeypatch):
    """What is listed in a dense cell stood in one part for each so many pairs, so copies grew with the square of the rows."""
    from orbitweave.operators import spatial

    monkeypatch.setattr(spatial, "DENSE_PAIRS", 1)
    rows = lambda key, n: spark.range(n).select(F.col("id").alias(key), F.when(F.col("id") % 100 == 7, 2).otherwise(1).alias("cell"))
    other = spark.createDataFrame([(9000, 3), (9001, None)], "id long, cell int")
    for n, m in ((4000, 4000), (6000, 300), (300, 6000)):
        placed, listed = spatial.shuffled(rows("p", n).union(other), rows("c", m).union(other.where("cell IS NULL")), ["cell"])
        joined = placed.join(listed, ["cell", "__part"])
        assert joined.count() == joined.select("p", "c").distinct().count() == round(n * m * (0.99 * 0.99 + 0.01 * 0.01))
        tasks = 4 * spatial.TASKS_PER_CORE
        assert max(r["count"] for r in joined.groupBy("cell", "__part").count().collect()) < 3 * n * m / tasks
        assert placed.count() + listed.count() < 3 * (tasks * n * m) ** 0.5 + n + m  # before, tasks * m + n and more
        assert not {9000, 9001} & {r.p for r in placed.select("p").collect()}


def test_rounding_by_whole_numbers_is_rounding(spark):
    rows = [(k / 16 + 0.0005 * (k % 3),) for k in range(-400, 400)] + [(0.5,), (-0.5,), (0.0015,), (1.0005,), (2.675,), (1e15 / 7,), (-1e300,), (float("nan"),), (float("inf"),), (-0.00001,), (None,)]
    df = spark.createDataFrame(rows, "x double")
    for digits in (3, 6):
        assert df.where(~F.round("x", digits).eqNullSafe(V.rounded(F.col("x"), digits))).count() == 0
