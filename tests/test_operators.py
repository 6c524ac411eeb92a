"""Operators and functions beyond the registered queries: goldens, properties and odd cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.functions import geo, orbit, radiometry, shapes, textual
from orbitweave.functions import vectors as V
from orbitweave.operators import coco, imaging, matching, motion, ordinal, queue, spatial, terrain
from orbitweave.sources import files, sinks


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()
    return row if len(columns) > 1 else row[0]


# The queue.
def imperative(detections, opportunities, delay, ttl):
    """The queue as a loop over time: a pending entry for each target."""
    pending, views = {}, []
    times = sorted({t for _, t in detections} | {t for _, t, _ in opportunities})
    for now in times:
        pending = {k: d for k, d in pending.items() if now <= d + ttl}
        for k, t in detections:
            if t == now:
                pending[k] = now
        seen = set()
        for k, t, cue in opportunities:
            if t == now and k in pending and now > pending[k] + delay:
                views.append((k, cue, pending[k], now))
                seen.add(k)
        for k in seen:
            del pending[k]
    return sorted(views)


@pytest.mark.parametrize("seed", range(6))
def test_queue_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    det = [(rng.randrange(4), 50 * rng.randrange(73)) for _ in range(40)]
    opp = [(rng.randrange(4), 50 * rng.randrange(73), c) for c in ("cue0", "cue1") for _ in range(60)]
    det, opp = sorted(set(det)), sorted(set(opp))
    us = lambda rows: [(k, t * 1_000_000, *r) for k, t, *r in rows]
    views = queue.observation_queue(spark.createDataFrame(us(det), "k int, t long"), spark.createDataFrame(us(opp), "k int, t long, cue string"), ["k"], "t", "t", 300, 1200)
    got = sorted((r.k, r.cue, r.detected_us // 1_000_000, r.t // 1_000_000) for r in views.collect())
    assert got == imperative(det, opp, 300, 1200)


def test_queue_of_nothing(spark):
    det, opp = spark.createDataFrame([], "k int, t long"), spark.createDataFrame([(1, 5)], "k int, t long")
    assert queue.observation_queue(det, opp, ["k"], "t", "t", 300, 1200).collect() == []


def _landed(spark, rows, folder):
    """Rows (key, event_id, kind, seconds) as a stream's files, one for each list of them."""
    for part in rows:
        df = spark.createDataFrame([(k, n, kind, t * 1_000_000) for k, n, kind, t in part], "key string, event_id long, kind string, t_us long")
        df.withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(folder)
    return df.withColumn("ts", F.timestamp_micros("t_us")).schema


def test_streaming_queue_survives_a_restart_and_equals_batch(spark, tmp_path):
    from orbitweave.streaming import queue as streams

    rng = random.Random(9)
    rows = sorted({(rng.choice(["a", "a", "a", "b", "c"]), 50 * rng.randrange(200), rng.choice(["detection", "opportunity"])) for _ in range(500)}, key=lambda r: r[1])
    rows = [(k, n, kind, t) for n, (k, t, kind) in enumerate(rows)]
    for k in range(0, len(rows) - 8, 9):  # some come late, but not too late
        rows[k], rows[k + 8] = rows[k + 8], rows[k]
    folder, seen, marks = (str(tmp_path / x) for x in ("in", "seen", "marks"))
    views = lambda schema: streams.stream_queue(streams.read_slices(spark, folder, schema, 1), "ts", 300, 1200)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    schema = _landed(spark, [rows[:100], rows[100:200]], folder)
    streams.write_queue(views(schema), seen, marks)
    early = spark.read.schema(streams.VIEWS).parquet(seen).count()
    # A second query goes on from the marks of the first: with new files, then with nothing new.
    _landed(spark, [rows[200:350], rows[350:], [(None, None, "opportunity", 90_000)]], folder)
    streams.write_queue(views(schema), seen, marks)
    streams.write_queue(views(schema), seen, marks)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = sorted((r.key, r.event_id, r.detected_us, r.seen_us) for r in spark.read.schema(streams.VIEWS).parquet(seen).collect())
    df = spark.createDataFrame([(k, n, kind, t * 1_000_000) for k, n, kind, t in rows], "key string, event_id long, kind string, t long")
    kind = lambda k: df.where(F.col("kind") == k)
    batch = queue.observation_queue(kind("detection"), kind("opportunity"), ["key"], "t", "t", 300, 1200)
    assert got == sorted((r.key, r.event_id, r.detected_us, r.t) for r in batch.collect())
    assert 0 < early < len(got)


def test_stream_of_nothing(spark, tmp_path):
    from orbitweave.streaming import queue as streams

    none = spark.createDataFrame([], "key string, event_id long, kind string, t_us long, ts timestamp")
    late = streams.write_slices(none, "ts", "t_us", str(tmp_path / "in"), 4)
    streams.write_queue(streams.stream_queue(streams.read_slices(spark, str(tmp_path / "in"), none.schema, 2), "ts", 300, 1200, f"{late} seconds"), str(tmp_path / "seen"), str(tmp_path / "marks"))
    assert spark.read.schema(streams.VIEWS).parquet(str(tmp_path / "seen")).count() == 0


# Geometry.
def test_grid_join_finds_what_a_cross_join_finds(spark):
    rng = np.random.default_rng(0)
    pts = [(k, float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))) for k in range(400)] + [(900, 89.9, 10.0), (901, -89.9, -170.0), (902, 0.0, 179.99), (903, 0.0, -180.0)]
    centres = [(k, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for k in range(40)] + [(90, 90.0, 0.0), (91, 0.0, -179.9), (92, -88.0, 60.0)]
    p, c = spark.createDataFrame(pts, "p long, lat double, lon double"), spark.createDataFrame(centres, "c long, clat double, clon double")
    near = spatial.within_distance(p, c, ("lat", "lon"), ("clat", "clon"), 900_000.0, 4.0)
    got = sorted((r.p, r.c) for r in near.collect())

    def distance(a, b):
        x = [math.radians(v) for v in (*a[1:], *b[1:])]
        h = math.sin((x[2] - x[0]) / 2) ** 2 + math.cos(x[0]) * math.cos(x[2]) * math.sin((x[3] - x[1]) / 2) ** 2
        return 2 * math.asin(min(1, math.sqrt(h))) * 6_371_000

    assert got == sorted((a[0], b[0]) for a in pts for b in centres if distance(a, b) <= 900_000)


def test_geodetic_round_trip(spark):
    rows = [(lat, lon, alt) for lat in (-90.0, -45.0, 0.0, 33.3, 89.99, 90.0) for lon in (-180.0, 0.0, 77.7) for alt in (0.0, 786_000.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, alt double")
    for r in df.withColumn("g", geo.geodetic(geo.ecef(F.col("lat"), F.col("lon"), F.col("alt")))).collect():
        assert r.g.lat == pytest.approx(r.lat, abs=1e-8) and r.g.alt == pytest.approx(r.alt, abs=1e-3)


def test_orbit_matches_the_logged_radius_and_period(spark):
    a = 6_371_000.0 + 786_000.0
    assert orbit.period_s(a) == pytest.approx(6025.70, abs=0.01) and orbit.anomaly_lag_deg(300.0, a) == pytest.approx(17.923, abs=1e-3)
    s = [F.lit(x) for x in (a, 0.0003907, 97.8748, 297.6688, 231.9817, 218.1045)]
    got = one(spark, a=orbit.state(*s, F.lit(0.0)), b=orbit.state(*s, F.lit(0.5)), r=V.norm(orbit.state(*s, F.lit(777.0))["r"]))
    step = [(got.b["r"][k] - got.a["r"][k]) / 0.5 for k in "xyz"]
    assert step == pytest.approx([(got.a["v"][k] + got.b["v"][k]) / 2 for k in "xyz"], abs=10.0)  # the drift of the plane is not in v
    assert 7_154_000 < got.r < 7_160_000


def test_boresight_points_at_the_nadir_and_attitude_at_the_target(spark):
    a = 6_371_000.0 + 786_000.0
    s = orbit.state(*(F.lit(x) for x in (a, 0.0, 60.0, 10.0, 20.0, 30.0)), F.lit(100.0))
    df = spark.range(1).withColumn("s", s).withColumn("g", geo.geodetic(orbit.earth_fixed(F.col("s.r"), F.lit(9000.0))))
    df = df.withColumn("b", orbit.boresight(F.col("s.r"), F.col("s.v"), F.lit(9000.0))).withColumn("f", orbit.footprint(F.col("s.r"), F.col("s.v"), F.lit(9000.0), geo.fov_from_swath(290_000.0, 786_000.0)))
    hit = orbit.ground_hit(F.col("s.r"), orbit.pointing(F.col("s.r"), F.col("s.v"), F.lit(0.0), F.lit(12.0), F.lit(-7.0)))
    df = df.withColumn("l", orbit.look_attitude(F.col("s.r"), F.col("s.v"), hit)).withColumn("in", geo.point_in_polygon(F.col("b.lat"), F.col("b.lon"), F.col("f")))
    r = df.first()
    assert (r.b.lat, r.b.lon) == pytest.approx((r.g.lat, r.g.lon), abs=0.2)
    assert r["in"] and len(r.f) == 4
    assert r.l.off_nadir == pytest.approx(math.degrees(math.acos(math.cos(math.radians(12)) * math.cos(math.radians(7)))), abs=1e-6)
    assert V is not None and one(spark, m=orbit.ground_hit(V.vec(7e6, 0, 0), V.vec(1, 0, 0))) is None


def test_sun_is_up_at_noon(spark):
    noon, night = (F.lit(t).cast("timestamp_ntz") for t in ("2025-06-21 12:00:00", "2025-06-21 00:00:00"))
    at = geo.ecef(F.lit(23.44), F.lit(0.0), F.lit(0.0))
    got = one(spark, day=geo.elevation_deg(at, geo.sun_ecef(noon)), dark=geo.is_dark(at, geo.sun_ecef(night)))
    assert got.day > 88.5 and got.dark.dark


def test_vectors(spark):
    got = one(
        spark, z=V.normalize(V.vec(0, 0, 0)), t=V.rotate_about(V.vec(1, 0, 0), V.vec(0, 0, 1), F.lit(math.pi / 2)), a=V.align(V.vec(1, 0, 0), V.vec(1, 0, 0), V.vec(0, 1, 0)), s=V.align(V.vec(1, 2, 3), V.vec(1, 0, 0), V.vec(2, 0, 0)), n=V.plane_normal(V.vec(1, 0, 0), V.vec(0, 1, 0))
    )
    assert got.z is None and (got.t.x, got.t.y) == pytest.approx((0, 1)) and (got.a.x, got.a.y) == pytest.approx((0, 1), abs=1e-9) and (got.s.x, got.s.z) == (1, 3) and got.n.z == 1


def test_walk_stays_in_bounds_and_off_land(spark):
    land = spark.range(180 * 360).where("id % 7 = 0").select(F.floor(F.col("id") / 360).cast("int").alias("row"), (F.col("id") % 360).cast("int").alias("col"))
    start = motion.start_targets(spark, 200, land, 1.0, 42)
    assert start.count() == 200 and start.where("abs(lat) > 70").count() == 0
    walk = motion.walk_targets(start, land, 1.0, 73, 50.0, 42)
    rows = walk.collect()
    assert len(rows) == 200 * 73 and {r.step for r in rows} == set(range(73))
    assert all(0.2 <= r.speed <= 6.0 and 0 <= r.heading < 360 and -180 <= r.lon < 180 for r in rows)
    assert spatial.on_water(walk, land, "lat", "lon", 1.0).count() == len(rows)
    again = motion.walk_targets(start.repartition(7), land, 1.0, 73, 50.0, 42)
    assert again.subtract(walk).count() == 0
    last = {}
    for r in sorted(rows, key=lambda r: r.step):
        if r.whale_id in last:
            p = last[r.whale_id]
            d = 6_371_000 * math.radians(math.hypot(r.lat - p.lat, ((r.lon - p.lon + 180) % 360 - 180) * math.cos(math.radians(p.lat))))
            assert d <= r.speed * 50 * 1.01 + 1
        last[r.whale_id] = r


# Datasets.
@pytest.mark.parametrize(("n", "parts"), [(10, (7, 2, 1)), (20, (14, 4, 2)), (100, (70, 19, 11)), (633, (443, 126, 64))])
def test_split_cuts(spark, n, parts):
    a, b = ordinal.split_cuts(n)
    assert (a, b - a, n - b) == parts
    got = ordinal.positional_split(spark.range(n), F.col("id") * -1, []).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == dict(zip(("train", "val", "test"), parts))


def test_ordinal_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordinal, "ROWS_PER_RANGE", 10)
    df = spark.range(97).select((F.col("id") * 7 % 97 % 40).alias("k"), "id")
    got = [(r.k, r.id, r.n) for r in ordinal.with_ordinal(df, F.col("k"), [F.col("id")], "n").collect()]
    assert [n for *_, n in sorted(got)] == list(range(1, 98))


def test_rotations_undo_each_other(spark):
    ring = F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in ((1, 2, 3, 4), (5, 6, 7, 8, 9, 1))))
    c = F.lit(62.0)
    for a in (0, 90, 180, 270):
        back = shapes.rotate_rings(shapes.rotate_rings(ring, c, c, F.lit(a)), c, c, shapes.inverse_angle(F.lit(a)))
        got = one(spark, r=back)
        assert [v for r in got for v in r] == pytest.approx([1, 2, 3, 4, 5, 6, 7, 8, 9, 1])


def test_long_name_lists_go_by_equi_join(spark, monkeypatch):
    files_ = spark.createDataFrame([(k, f"img_{k:04d}_chip.png") for k in range(50)] + [(99, None), (98, "x")], "id long, name string")
    names = spark.createDataFrame([("0003",), ("0017_chip",), ("nothing",), (None,)], "name string")
    want = {3, 17}
    assert {r.id for r in matching.name_contains(files_, names, "name", "name").collect()} == want
    assert {r.id for r in matching.name_contains(files_, names, "name", "name", found=False).collect()} == {k for k in range(50)} - want | {98, 99}
    # A filter that lets nearly everything pass, and chunks that cut names, change nothing.
    monkeypatch.setattr(matching, "LEAST_BITS", 8)
    monkeypatch.setattr(matching, "MOST_BITS", 8)
    monkeypatch.setattr(matching, "_CHUNK", 5)
    assert {r.id for r in matching.name_contains(files_, names, "name", "name").collect()} == want


def test_contains_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [(k, "".join(rng.choices("abé漢_", k=rng.randint(0, 60))) if k % 17 else None) for k in range(400)] + [(900, "ab" * 300_000 + "aé漢a")]
    names = ["".join(rng.choices("abé漢_", k=rng.randint(3, 6))) for _ in range(40)] + ["aé漢a", "very long name that is nowhere"]
    df = spark.createDataFrame(texts, "id long, name string")
    want = {k for k, t in texts if t is not None and any(n in t for n in names)}
    for some in (names, [*names, ""], []):
        hit = want if some is names else {k for k, t in texts if t is not None} if some else set()
        ns = spark.createDataFrame([(n,) for n in some], "name string")
        assert {r.id for r in matching.name_contains(df, ns, "name", "name").collect()} == hit
        assert {r.id for r in matching.name_contains(df, ns, "name", "name", found=False).collect()} == {k for k, _ in texts} - hit


def test_dataset_tables_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(1, "a.png", 8, 8), (2, "b.png", 8, 16)], "id int, file_name string, height int, width int")
    anns = spark.createDataFrame([(1, 1, 0, [0.0, 0.0, 4.0, 4.0])], "id int, image_id int, category_id int, bbox array<double>")
    cats = spark.createDataFrame([(0, "whale", "animal")], "id int, name string, supercategory string")
    sinks.write_coco(images, anns, cats, str(tmp_path / "coco"))
    back = files.read_coco(spark, str(tmp_path / "coco"))
    assert {(r.id, r.file_name, r.width) for r in back["images"].collect()} == {(1, "a.png", 8), (2, "b.png", 16)}
    assert back["annotations"].first().bbox == [0.0, 0.0, 4.0, 4.0] and back["categories"].first().name == "whale"
    full = coco.with_annotations(images, anns.withColumnRenamed("id", "nr").withColumnRenamed("image_id", "id"), "id", ["nr"], [F.col("nr")])
    assert {r.id: len(r.annotations) for r in full.collect()} == {1: 1, 2: 0}


def test_files(spark, tmp_path):
    (tmp_path / "0_skip").mkdir()
    (tmp_path / "d").mkdir()
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (124).to_bytes(4, "big") + (62).to_bytes(4, "big")
    for name in ("0_skip/a.png", "d/b.PNG", "d/c.txt", "d/e.jpg"):
        (tmp_path / name).write_bytes(png)
    listed = files.list_files(spark, str(tmp_path))
    assert sorted(r.name for r in listed.collect()) == ["b.PNG", "e.jpg"]
    assert {(r.width, r.height) for r in files.image_headers(spark, str(tmp_path / "d")).collect()} == {(124, 62)}
    (tmp_path / "s.spd").write_text("# head\n 450.0 0.02\nbad line\n455.0\n460 0.45 x\n")
    rows = files.read_spectrum(spark, str(tmp_path / "s.spd")).collect()
    assert [(r.wl_nm, r.value) for r in rows] == [(450.0, 0.02), (460.0, 0.45)]
    assert files.spectrum_range(files.read_spectrum(spark, str(tmp_path / "s.spd"))).first()[:] == (250.0, 660.0)
    (tmp_path / "m.csv").write_text("BoxID/ImageChip,NumWhale,Certainty2,SpatialRes,Satellite\nc1,1,Possible,0.31m,WV3\nc1,2,Definite,0.31m,WV3\n")
    chips = files.chip_lookup(files.read_metadata(spark, str(tmp_path / "m.csv"))).collect()
    assert [(r.file_name, r["count"], r.certainty) for r in chips] == [("c1.PNG", "2", "Definite")]
    manifest = sinks.copy_manifest(spark.createDataFrame([("/a/x.png",), ("/b/x.png",), ("/b/y.png",)], "path string"), "/out")
    assert sorted(r.action for r in manifest.collect()) == ["collision", "collision", "copy"]


def test_logs(spark, tmp_path):
    header = "date,actor,target_lat,target_lon,target_alt,x,y,z,vx,vy,vz,offnadir,in_view,in_footprint,yaw,pitch,roll\n"
    (tmp_path / "cue.txt").write_text(header + "2025-08-13T00:18:20,Cue_plane0_sat1, 61,19.7465,-94.3032,0.0,1.0,2.0,3.0,4.0,5.0,6.0,32.9882,[ True],0,4.57,-28.00,-18.20\n")
    log = files.read_cue_log(spark, str(tmp_path / "cue.txt"))
    r = log.first()
    assert (r.whale_id, r.in_view, r.in_footprint, r.pitch) == (61, True, False, -28.0)
    text = sinks.log_rows(log).first()
    assert (text.date, text.target_lat, text.offnadir_angle_deg, text.roll) == ("2025-08-13T00:18:20", "19.7465", "32.9882", "-18.20")


# Images and terrain.
def test_digital_numbers(spark):
    bands = radiometry.band_table(spark, "WV3")
    cal = [F.col(c) for c in ("gain", "offset", "eff_bw", "abs_cal")]
    assert {r.band: r.dn for r in bands.select("band", radiometry.radiance_to_dn2047(F.lit(0.0), *cal).alias("dn")).collect()} == {"red": 8, "green": 24, "blue": 26}
    with pytest.raises(ValueError):
        radiometry.band_table(spark, "unknown")
    got = one(spark, a=radiometry.linear_to_dn255(F.lit(2.0)), b=radiometry.linear_to_dn2047(F.lit(1.5)), c=radiometry.dn2047_to_linear(F.lit(4000)), d=radiometry.clip_byte(F.lit(-3)), e=radiometry.display_value(F.lit(4.0)))
    assert got[:] == (255, 2047, 1.0, 0, 1.0)
    assert math.sqrt(radiometry.slope_variance(10.0)) == pytest.approx(0.2328, abs=1e-4)


def test_ssim_of_equal_and_different_images(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, 144).tolist()
    df = spark.createDataFrame([(1, x, x), (2, x, x[::-1])], "id int, a array<int>, b array<int>")
    got = {r.id: r.ssim for r in imaging.ssim(df, "a", "b", 12).collect()}
    assert got[1] == pytest.approx(1.0) and abs(got[2]) < 0.5
    assert imaging.ssim(df.limit(0), "a", "b", 12).collect() == []


def test_dark_images_stay_whole(spark):
    pix = spark.range(16).select(F.lit("i").alias("image"), F.floor(F.col("id") / 4).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"), F.lit(0.0).alias("v"))
    assert imaging.crop_border(pix, "image", F.col("v"), 1.0).count() == 16


def test_bands_are_stacked(spark):
    pix = spark.createDataFrame([(1, 0, 0, "red", 5), (1, 0, 0, "green", 6), (1, 0, 0, "blue", 7)], "i int, y int, x int, band string, v int")
    assert imaging.stack_bands(pix, "i", "v").first().rgb[:] == (5, 6, 7)


def test_mesh_lines(spark):
    g = terrain.grid(spark, 2, 2, 1.0)
    v = g.select((F.col("i") * 2 + F.col("j")).cast("long").alias("id"), "x", "y", F.lit(0.0).alias("z"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    f = terrain.faces(spark, 2, 2)
    lines = [r.value for r in sinks.obj_lines(v, terrain.vertex_normals(v, f), f).orderBy("part", "nr").collect()]
    assert lines[0] == "v -1.000000 -1.000000 0.000000" and lines[-1].startswith("f ") and len(lines) == 14
    b = terrain.bounds(v).first()
    assert (b.min_x, b.max_y, b.mean_z) == (-1.0, 1.0, 0.0)


def test_names_and_times(spark):
    ts = F.lit("2025-08-12 06:45:30").cast("timestamp_ntz")
    got = one(spark, a=textual.stem(F.lit("/x/y.tar.gz")), b=textual.extension(F.lit("Y.PNG")), c=textual.metres(F.lit("0.31m ")), d=textual.metres(F.lit("n/a")), e=textual.iso(ts), f=textual.decimal_hour(ts), g=textual.relative_to(F.lit("/r/a/b"), "/r"), h=textual.stem(F.lit(".hidden")))
    assert got[:] == ("y.tar", ".png", 0.31, None, "2025-08-12T06:45:30", 6.75, "a/b", ".hidden")


def test_metadata_and_polygons(spark):
    meta = spark.createDataFrame([(" c1 ", "1", "x", "0.31m", " WV3 "), ("c1", "1", "x", "0.5m", "other")], files.METADATA)
    images = spark.createDataFrame([("/d/c1.png",)], "path string")
    assert files.metadata_of(images, meta).first()[:] == ("/d/c1.png", 0.31, "WV3")
    with pytest.raises(Exception, match="no metadata"):
        files.metadata_of(spark.createDataFrame([("/d/zz.png",)], "path string"), meta).collect()
    rows = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))",), ("POINT (1 1)",), (None,)], "wkt string")
    rings = [r.ring for r in files.parse_polygons(rows, "wkt").collect()]
    assert [(p.lat, p.lon) for p in rings[0]][:3] == [(0, 0), (0, 4), (3, 4)] and rings[1:] == [None, None]
    cells = spatial.burn_polygons(files.parse_polygons(rows, "wkt").where("ring IS NOT NULL"), "ring", 1.0)
    assert cells.count() == 12


def test_start_targets_are_all_found_on_little_water(spark):
    land = spark.range(180 * 360).where("id % 40 <> 0").selectExpr("CAST(id DIV 360 AS INT) AS row", "CAST(id % 360 AS INT) AS col")
    few, many = (sorted(r[:3] for r in motion.start_targets(spark, 60, land, 1.0, 5, surplus=s).collect()) for s in (1, 50))
    assert few == many and [r[0] for r in few] == list(range(60))


def test_empty_names_and_blocks_of_candidates(spark):
    rows = spark.createDataFrame([(k, None if k == 3 else f"n{k}") for k in range(6)], "id int, name string")
    names = spark.createDataFrame([("",), ("n4",)], "name string")
    assert {r.id for r in matching.name_contains(rows, names, "name", "name").collect()} == {0, 1, 2, 4, 5}
    assert {r.id for r in matching.name_contains(rows, names, "name", "name", found=False).collect()} == {3}
    vectors = spark.createDataFrame([(k, k % 2, [float(k % 7 + 1), float(k % 5), 1.0]) for k in range(60)], "id int, g int, v array<double>")
    best = lambda n: sorted(matching.best_match(vectors.where("id % 10 = 0"), vectors, "id", "v", "g", n).collect())
    assert best(7) == best(1000)


def test_numbers_with_given_cuts(spark):
    df = spark.range(100).selectExpr("id", "id % 10 AS k")
    by = lambda **more: sorted((r.n, r.k, r.id) for r in ordinal.with_ordinal(df, F.col("k"), [F.col("id")], "n", **more).collect())
    assert by() == by(cuts=[2.5, 6.5]) == by(total=100) and [r[0] for r in by()] == list(range(1, 101))


def test_polygons_across_the_date_line_and_round_a_pole(spark):
    rings = {
        "cap": [(80.0, 0.0), (80.0, 90.0), (80.0, 180.0), (80.0, -90.0)],
        "south": [(-80.0, 0.0), (-80.0, -90.0), (-80.0, 180.0), (-80.0, 90.0)],
        "line": [(-3.0, 175.0), (3.0, 175.0), (3.0, -175.0), (-3.0, -175.0)],
        "broken": [(-3.0, 0.0), (3.0, 0.0), (None, 1.0)],
        "two": [(-3.0, 0.0), (3.0, 0.0)],
    }
    points = [(85.0, 10.0), (89.9, -135.0), (75.0, 10.0), (-85.0, 10.0), (-75.0, 100.0), (0.0, 179.0), (0.0, -179.0), (0.0, 0.5), (2.0, 174.0)]
    rows = [(name, ring, *p) for name, ring in rings.items() for p in points]
    df = spark.createDataFrame(rows, "name string, ring array<struct<lat: double, lon: double>>, lat double, lon double")
    got = {(r.name, r.lat, r.lon) for r in df.where(geo.point_in_polygon(F.col("lat"), F.col("lon"), F.col("ring"))).select("name", "lat", "lon").collect()}
    assert got == {("cap", 85.0, 10.0), ("cap", 89.9, -135.0), ("south", -85.0, 10.0), ("line", 0.0, 179.0), ("line", 0.0, -179.0)}

    ring = [(-1.0, 178.0), (1.0, 178.0), (1.0, 183.0), (-1.0, 183.0)]
    cells = spatial.burn_polygons(spark.createDataFrame([(ring,)], "ring array<struct<lat: double, lon: double>>"), "ring", 1.0)
    assert sorted((r.row, r.col) for r in cells.collect()) == [(r, c) for r in (89, 90) for c in (0, 1, 2, 358, 359)]
