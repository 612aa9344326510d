import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.functions import geo


def test_utm_control_points_and_round_trip(spark):
    rows = [(1, 0.0, 3.0), (2, 52.9607193, -91.3226589), (3, -33.9, 151.2), (4, 83.0, 20.9), (5, 51.1784, -115.5708)]
    d = spark.createDataFrame(rows, "id int, lat double, lon double").withColumn("epsg", geo.utm_epsg("lat", "lon"))
    x, y = geo.to_utm("lat", "lon", "epsg")
    d = d.withColumn("x", x).withColumn("y", y)
    got = {r.id: r for r in d.withColumn("b", geo.from_utm("x", "y", "epsg")).collect()}
    assert (got[1].x, got[1].y, got[1].epsg) == (pytest.approx(500000), pytest.approx(0, abs=1e-6), 32631)
    assert got[3].epsg == 32756 and got[2].epsg == 32615
    for r in got.values():
        assert (r.b.lat, r.b.lon) == (pytest.approx(r.lat, abs=1e-9), pytest.approx(r.lon, abs=1e-9))
    # a published point: 48 N 17 E is 500000 + ... in zone 33: easting 649,219.x, northing 5,318,3xx from standard tables
    p = spark.range(1).select(*geo.to_utm(F.lit(48.0), F.lit(17.0), F.lit(32633))).first()
    assert p[0] == pytest.approx(649_159, abs=300) and p[1] == pytest.approx(5_318_351, abs=300)


def test_master_grid(spark):
    g = spark.range(1).select(geo.master_grid(F.lit(52.9607193), F.lit(-91.3226589)).alias("g")).first().g
    assert (g.epsg, g.rows, g.cols) == (32615, 2048, 2048) and g.max_x - g.min_x == pytest.approx(20480)
    assert g.transform[0] == 10.0 and g.transform[4] == -10.0 and g.bbox[0] < g.lon < g.bbox[2] and g.bbox[1] < g.lat < g.bbox[3]
    b = spark.range(1).select(geo.master_grid(F.lit(52.9), F.lit(-91.3), buffer_m=5000.0).alias("g")).first().g
    assert b.rows == 3048


def test_zone_edges(spark):
    rows = [(0.0, 180.0), (0.0, -180.0), (-0.1, 0.0), (10.0, 179.999)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, o double").select(geo.utm_epsg("a", "o")).collect()]
    assert got == [32661, 32601, 32731, 32660]


def test_nan_guards(spark):
    d = spark.createDataFrame([(float("nan"),), (None,), (-1.0,), (5.0,), (float("inf"),)], "x double")
    r = d.select(geo.clip("x", 0.0, 2.0).alias("c"), geo.fill("x", 7.0).alias("f"), geo.capped_time("x").alias("t")).collect()
    assert math.isnan(r[0].c) and r[0].f == 7.0 and r[1].f == 7.0 and [r[k].c for k in (2, 3)] == [0.0, 2.0] and r[4].t == 12.0


def test_polygon_forms_agree(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0)]
    r = np.random.default_rng(0)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.uniform(-1, 5, (300, 2)))]
    d = spark.createDataFrame(pts, "id int, lat double, lon double")
    rings = F.array(F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ring)))
    got = d.select(geo.in_ring("lat", "lon", ring).alias("a"), geo.in_rings("lat", "lon", rings).alias("b"), geo.in_rings("lat", "lon", F.lit(None).cast("array<array<struct<lon:double,lat:double>>>")).alias("c")).collect()
    assert all(x.a == x.b and x.c for x in got) and 50 < sum(x.a for x in got) < 150


def test_facing(spark):
    d = spark.createDataFrame([(0.1, 0.0), (0.0, 0.1), (0.0, -0.1), (0.0, 0.0)], "e double, s double")
    n, e = geo.facing("e", "s")
    got = [(round(r[0], 6), round(r[1], 6)) for r in d.select(n, e).collect()]
    assert got == [(0.0, -1.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0)]  # east rising falls to the west; south rising falls to the north


def test_master_grids_are_of_all_fires(spark):
    from cinderlake.plans import registry
    from cinderlake.sources import fixtures

    got = registry.master_grids(spark, "/root/testdata/sf0.01").select("event_id").collect()
    want = fixtures.fires(spark, "/root/testdata/sf0.01").select("event_id").collect()
    assert len(want) > 50 and sorted(r.event_id for r in got) == sorted(r.event_id for r in want)


def test_both_utm_series_agree_and_the_query_rounds_as_its_sql(spark):
    d = spark.range(4000).selectExpr("44 + 24 * (id * 7919 % 3989) / 3989D as lat", "-139 + 82 * (id * 104729 % 3967) / 3967D as lon").withColumn("epsg", geo.utm_epsg("lat", "lon"))
    (x, y), (u, v) = geo.to_utm("lat", "lon", "epsg"), geo.to_utm_powers("lat", "lon", "epsg")
    far = d.agg(F.max(F.abs(x - u)), F.max(F.abs(y - v))).first()
    assert 0 < max(far) < 1e-3
    from cinderlake.plans import registry

    plan = registry.utm_zone(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ATANH" not in plan.upper()  # the SQL's series has none
