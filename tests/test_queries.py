"""Every registered query of the library against its SQL, and plans without cross products of data."""

import math

import duckdb
import pytest

from orbitweave import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = plans.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    relation = duck.sql(plans.ORACLES[name])
    assert sorted(relation.columns) == names
    want = sorted((tuple(plain(dict(zip(relation.columns, r, strict=True))[c]) for c in names) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(name, spark, sf_dir):
    assert plans.QUERIES[name](spark, sf_dir).schema


@pytest.mark.parametrize("name", ["observation_queue_day", "tip_footprint_join_grid", "elevation_visibility", "footprint_polygon_join", "prefix_candidates", "image_annotations_outer", "water_targets_topn", "chip_semi_join", "chip_anti_join"])
def test_no_cross_product(name, spark, sf_dir):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plans.QUERIES["observation_queue"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan and "props" not in plan.split("ReadSchema")[1].split(">")[0]
