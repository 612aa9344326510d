"""Views that project the driver's tables onto the geospatial model by id arithmetic. No geographic meaning is claimed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = [(-130.0, 46.0), (-72.0, 46.0), (-72.0, 62.0), (-98.0, 62.0), (-98.0, 53.0), (-106.0, 53.0), (-106.0, 62.0), (-130.0, 62.0)]
LAT_RANGE, LON_RANGE = (46.0, 62.0), (-130.0, -72.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    e = e.selectExpr("*", "cast(ts as date) as d", "datediff(cast(ts as date), date '2024-01-01') as dn")
    return e.selectExpr(
        "event_id", "d as acq_date", "value as frp", "hour(ts)*100 + minute(ts) as acq_time", "295D + value as bright_ti4",
        "case when event_id % 2 = 0 then 45D + ((user_id*7 + (dn div 4)*11) % 12)*1.6D + ((event_id*7919) % 997)/997D*0.6D else 44D + ((event_id*7919) % 9973)/9973D*24D end as latitude",
        "case when event_id % 2 = 0 then -135D + ((user_id*5 + (dn div 4)*17) % 12)*5.5D + ((event_id*104729) % 991)/991D*0.6D else -139D + ((event_id*event_id*31 + event_id*7) % 99991)/99991D*82D end as longitude",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires(spark, sf_dir).withColumn("is_fire", F.when(F.col("frp") > 40.0, 1).otherwise(0))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("0 as scene_id", "cast(p_partkey div 40 as int) as row", "cast(p_partkey % 40 as int) as col", "p_retailprice*0.02D + ((p_partkey*7919)%101)*0.02D as z")


def scene_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain with masks: water, class, bridges, no-data holes and two roads."""
    return dem(spark, sf_dir).selectExpr(
        "scene_id", "row", "col", "case when (row*col) % 97 = 5 then double('NaN') else z end as z", "case when (row*7 + col*3) % 11 = 0 then 1 else 0 end as water",
        "case when (row + col) % 13 = 0 then 6 else 4 end as scl", "case when row % 10 = 5 and col % 6 = 0 then 1 else 0 end as bridge", "case when row = 10 or col = 20 then 1 else 0 end as road",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as item_id", "o_custkey % 50 as tile", "cast(o_orderdate as timestamp_ntz) as ts", "cast(o_orderkey*37 % 100 as double) as cloud_cover")


def scene_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id as target_id", "event_id % 50 as tile", "cast(date_add(date '1995-02-01', cast(event_id*37 % 2300 as int)) as timestamp_ntz) as ts")


def soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("date_trunc('hour', ts) as ts", "user_id % 16 as cell", "value/1000D as value")


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("0 as scene_id", "cast(c_custkey div 40 as int) as row", "cast(c_custkey % 40 as int) as col", "cast(c_acctbal as double) as value")


FIRES_SQL = """fires AS (
  SELECT event_id, d AS acq_date, value AS frp, hour(ts)*100 + minute(ts) AS acq_time, 295::DOUBLE + value AS bright_ti4,
    CASE WHEN event_id % 2 = 0 THEN 45::DOUBLE + ((user_id*7 + (dn // 4)*11) % 12)*1.6::DOUBLE + ((event_id*7919) % 997)/997::DOUBLE*0.6::DOUBLE
         ELSE 44::DOUBLE + ((event_id*7919) % 9973)/9973::DOUBLE*24::DOUBLE END AS latitude,
    CASE WHEN event_id % 2 = 0 THEN -135::DOUBLE + ((user_id*5 + (dn // 4)*17) % 12)*5.5::DOUBLE + ((event_id*104729) % 991)/991::DOUBLE*0.6::DOUBLE
         ELSE -139::DOUBLE + ((event_id*event_id*31 + event_id*7) % 99991)/99991::DOUBLE*82::DOUBLE END AS longitude
  FROM (SELECT *, CAST(ts AS DATE) AS d, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS dn FROM events WHERE event_type = 'error'))"""
POINTS_SQL = FIRES_SQL + ", points AS (SELECT *, CASE WHEN frp > 40 THEN 1 ELSE 0 END AS is_fire FROM fires)"
RING_SQL = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(RING, RING[1:] + RING[:1], strict=True)) + ") t(x1, y1, x2, y2))"
DEM_SQL = "dem AS (SELECT 0 AS scene_id, CAST(p_partkey // 40 AS INT) AS \"row\", CAST(p_partkey % 40 AS INT) AS col, p_retailprice*0.02::DOUBLE + ((p_partkey*7919) % 101)*0.02::DOUBLE AS z FROM part)"
CELLS_SQL = DEM_SQL + """, cells AS (SELECT scene_id, "row", col, CASE WHEN ("row"*col) % 97 = 5 THEN 'NaN'::DOUBLE ELSE z END AS z, CASE WHEN ("row"*7 + col*3) % 11 = 0 THEN 1 ELSE 0 END AS water,
  CASE WHEN ("row" + col) % 13 = 0 THEN 6 ELSE 4 END AS scl, CASE WHEN "row" % 10 = 5 AND col % 6 = 0 THEN 1 ELSE 0 END AS bridge, CASE WHEN "row" = 10 OR col = 20 THEN 1 ELSE 0 END AS road FROM dem)"""
CATALOG_SQL = """catalog AS (SELECT o_orderkey AS item_id, o_custkey % 50 AS tile, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_orderkey*37 % 100 AS DOUBLE) AS cloud_cover FROM orders),
targets AS (SELECT event_id AS target_id, event_id % 50 AS tile, CAST(DATE '1995-02-01' + CAST(event_id*37 % 2300 AS INT) AS TIMESTAMP) AS ts FROM events)"""
POPULATION_SQL = "population AS (SELECT 0 AS scene_id, CAST(c_custkey // 40 AS INT) AS \"row\", CAST(c_custkey % 40 AS INT) AS col, CAST(c_acctbal AS DOUBLE) AS value FROM customer)"


def km_sql(a: str, b: str) -> str:
    """Haversine between two aliases."""
    return (
        f"2*6371.0*asin(least(1.0, sqrt(pow(sin((radians({b}.latitude) - radians({a}.latitude))/2), 2) + cos(radians({a}.latitude))*cos(radians({b}.latitude))"
        f"*pow(sin((radians({b}.longitude) - radians({a}.longitude))/2), 2))))"
    )


def inside_sql(p: str) -> str:
    """Even-odd test by counting the joined edges that a ray to the east crosses."""
    return f"(SELECT count(*) FROM edges e WHERE (e.y1 > {p}.latitude) <> (e.y2 > {p}.latitude) AND {p}.longitude < (e.x2 - e.x1)*({p}.latitude - e.y1)/(e.y2 - e.y1) + e.x1) % 2 = 1"
