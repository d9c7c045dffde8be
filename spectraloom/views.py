"""Raster views over relational tables, so that every operator has a query that SQL can check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, COLUMNS, BANDS = 128, 25, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(x: Column) -> Column:
    return x.cast("int")


def frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames of two bands on one 128 x 128 canvas, from lineitem."""
    t = table(spark, sf_dir, "lineitem")
    keys = [_int(F.col("l_suppkey") % 8 + 1).alias("frame_id"), _int(F.col("l_orderkey") % SIDE).alias("y"), _int(F.col("l_partkey") % SIDE).alias("x")]
    cells = t.groupBy(*keys).agg(F.max("l_quantity").alias("q"), F.max(F.col("l_discount") * 100).alias("d"))
    bands = F.array(F.struct(F.lit(1).alias("band"), F.col("q").alias("v")), F.struct(F.lit(2).alias("band"), F.col("d").alias("v")))
    return cells.select("frame_id", "y", "x", F.inline(bands)).select("frame_id", "band", "y", "x", "v")


def patchy_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items on a canvas of 64 x 64, one band; v is NULL in patches of places, so that there are gaps at any size of the tables."""
    side = SIDE // 2
    y, x = _int(F.col("l_orderkey") % side), _int(F.col("l_partkey") % side)
    t = table(spark, sf_dir, "lineitem").select(_int(F.col("l_suppkey") % 8 + 1).alias("frame_id"), F.lit(1).alias("band"), y.alias("y"), x.alias("x"), F.col("l_quantity").alias("q"))
    gone = (F.col("y") * 37 + F.col("x") * 61 + (F.col("y") * F.col("x")) % 17) % 10 < 3
    return t.select("frame_id", "band", "y", "x", F.when(~gone, F.col("q")).alias("v"))


def raw_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, sample, band, v) of 5 lines, 5 samples and 3 bands from the nations, of which there are 25 at any size of the tables."""
    t = table(spark, sf_dir, "nation")
    bands = F.array(F.col("n_nationkey"), F.col("n_regionkey"), F.length("n_name"))
    return t.select(_int(F.floor(F.col("n_nationkey") / 5)).alias("line"), _int(F.col("n_nationkey") % 5).alias("sample"), F.posexplode(bands).alias("k", "v")).select("line", "sample", (F.col("k") + 1).alias("band"), F.col("v").cast("double").alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of those eight frames."""
    ids = spark.range(1, 9).select(_int(F.col("id")).alias("frame_id"))
    size = F.lit(SIDE)
    return ids.select("frame_id", size.alias("width"), size.alias("height"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"), F.lit(-1.0).alias("e"), F.lit(0.0).alias("f"), F.lit("EPSG:32636").alias("crs"), F.lit(2).alias("band_count"), F.lit("uint8").alias("dtype"), F.lit(50.0).alias("dtype_max"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large frame catalog, from orders."""
    t = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    a = F.lit(1.0) + (key % 10).cast("double") / 10
    return t.select(key.alias("frame_id"), _int(64 + cust % 64).alias("width"), _int(16 + key % 97).alias("height"), a.alias("a"), ((cust % 100).cast("double") / 1000).alias("b"), (cust % 1000).cast("double").alias("c"), F.lit(0.0).alias("d"), (-a).alias("e"), (key % 1000).cast("double").alias("f"), F.lit("EPSG:32636").alias("crs"), F.lit(2).alias("band_count"), F.lit("float32").alias("dtype"))


def cube(spark: SparkSession, sf_dir: str, per_band: bool = True) -> DataFrame:
    """A cube of 64 bands and 25 columns from embeddings, one row per value of the full grid; v is NULL where there is nodata.

    per_band: nodata differs from band to band; else whole pixels are missing.
    """
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "value"))
    key = F.col("vec_id")
    gone = (key * 7 + F.col("k") * 3) % 5 >= 3 if per_band else key % 11 == 0
    return t.select(_int(F.col("k") + 1).alias("band"), _int(F.floor(key / COLUMNS)).alias("y"), _int(key % COLUMNS).alias("x"), F.when(~gone, F.col("value").cast("double")).alias("v"))


def _seconds() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").cast("double") / 1e6


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attitude records of ten flight lines, from events other than views and purchases."""
    t = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error", "signup"))
    v = F.col("value")
    return t.select(_int(F.col("user_id") % 10).alias("line_id"), _seconds().alias("t"), (v / 1000).alias("roll"), (v / 2000).alias("pitch"), (v % 7 - 3).alias("yaw"), (F.lit(30.0) + v / 1e5).alias("lon"), (F.lit(59.0) + v / 1e5).alias("lat"), (F.lit(90.0) + v / 100).alias("alt"))


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the image lines of those flight lines, from views."""
    t = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    return t.select(_int(F.col("user_id") % 10).alias("line_id"), F.col("event_id").alias("line"), _seconds().alias("t"))
