"""Readers and writers of the point tables, and the country outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical points; dates are dates here and text only in files.
POINTS = "latitude double, longitude double, acq_date date, acq_time int, bright_ti4 double, frp double, is_fire int"
DETECTIONS = "latitude double, longitude double, acq_date date, acq_time int, bright_ti4 double, frp double"
RINGS = "array<array<struct<lon:double,lat:double>>>"


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Fire detections from CSV with a header, by a declared schema; a file without a latitude column is an error."""
    d = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if "latitude" not in d.columns:
        raise ValueError(f"{path} has no latitude column")
    want = dict(x.split(" ") for x in DETECTIONS.split(", "))
    return d.select(*(F.col(n).cast(t).alias(n) if n in d.columns else F.lit(None).cast(t).alias(n) for n, t in want.items()))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINTS).option("header", True).csv(path)


def write_points(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """Overwrites; CSV has a header and ISO dates, Parquet is the better choice for large tables."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if file_format == "csv" else w.format(file_format).save(path)


def read_country(spark: SparkSession, path: str) -> DataFrame:
    """``name, rings, west, south, east, north`` from a GeoJSON feature collection or feature with (multi)polygons.

    Bounds are raw; :func:`bbox_text` rounds them to 0.1 degrees.
    """
    raw = spark.read.text(path, wholetext=True)
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    j = raw.select(F.from_json("value", f"struct<type:string,features:array<{feature}>,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>").alias("j"))
    one = F.array(F.struct(F.col("j.properties").alias("properties"), F.col("j.geometry").alias("geometry")))
    f = j.select(F.explode(F.coalesce("j.features", one)).alias("f")).where("f.geometry is not null")
    poly = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(multi)).otherwise(poly)
    rings = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    d = f.select(F.coalesce(F.col("f.properties")["name"], F.col("f.properties")["ADMIN"]).alias("name"), rings.alias("rings"))
    every = F.flatten("rings")
    d = d.groupBy("name").agg(F.flatten(F.collect_list("rings")).alias("rings"))
    lon, lat = F.transform(every, lambda p: p["lon"]), F.transform(every, lambda p: p["lat"])
    return d.select("name", "rings", F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def bbox_text(country: DataFrame) -> DataFrame:
    return country.select(F.upper("name").alias("name"), F.format_string("%.1f,%.1f,%.1f,%.1f", "west", "south", "east", "north").alias("bbox"))


def fires_of_window(fires: DataFrame, target_date: str, buffer_days: int = 15) -> DataFrame:
    """``[d - buffer, d + buffer]``: the range reaches the scan as a pushed filter."""
    d = F.to_date(F.lit(target_date))
    return fires.where(F.col("acq_date").between(F.date_sub(d, buffer_days), F.date_add(d, buffer_days)))


def read_tiles(spark: SparkSession, path: str, scene_id: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Windowed read of a lattice table: partition and row/column ranges are pruned at the scan."""
    d = spark.read.parquet(path)
    return d.where((F.col("scene_id") == scene_id) & F.col("row").between(*rows) & F.col("col").between(*cols))


def write_layers(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("scene_id").parquet(path)
