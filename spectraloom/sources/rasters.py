"""Raster tables: band and window scans, and sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_reason, reason_text


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; Spark's AnalysisException names a path that doesn't exist."""
    return spark.read.parquet(path)


def scan_bands(pixels: DataFrame, *bands: int) -> DataFrame:
    """Some bands; tables written by write_mosaic() are partitioned by band, so others aren't read."""
    return pixels.where(F.col("band").isin(*bands))


def scan_window(pixels: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """A rectangle, pushed down to the scan."""
    return pixels.where(F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1))


def normalise(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """v with NULL for NaN and for the nodata value."""
    gone = F.isnan("v") if nodata is None or nodata != nodata else F.isnan("v") | (F.col("v") == nodata)
    return pixels.withColumn("v", F.when(~gone, F.col("v")))


def write_mosaic(pixels: DataFrame, path: str, descriptions: dict[int, str] | None = None) -> None:
    """float values, a partition for each band, sorted by y and x so that row groups can be skipped."""
    out = pixels.withColumn("v", F.col("v").cast("float"))
    if descriptions:
        names = F.create_map(*(x for k, v in descriptions.items() for x in (F.lit(k), F.lit(v))))
        out = out.withColumn("description", F.try_element_at(names, F.col("band")))
    out.repartition("band", F.floor(F.col("y") / 256)).sortWithinPartitions("band", "y", "x").write.mode("overwrite").partitionBy("band").parquet(path)


def write_raster(cells: DataFrame, path: str) -> None:
    """Count, source and mask rasters; an older table is replaced."""
    cells.write.mode("overwrite").parquet(path)


def read_raster_if(spark: SparkSession, path: str) -> DataFrame | None:
    """A raster, or None where the path doesn't exist."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if found else None


def write_rejected(rejected: DataFrame, path: str) -> None:
    """One CSV file with a header, also when nothing is rejected; what comes before the write keeps its own tasks."""
    rejected.select("path", "reason", "measured_value", "threshold").repartition(1).write.mode("overwrite").option("header", True).csv(path)


def rejected_rows(judged: DataFrame) -> DataFrame:
    """(path, reason, measured_value, threshold) of rejected frames, as text: the sentence and what it says."""
    path = F.col("path") if "path" in judged.columns else F.col("frame_id").cast("string")
    band = F.col("band") if "band" in judged.columns else None
    told = judged.where(F.col("reason").isNotNull()).select(path.alias("path"), reason_text(*(F.col(c) for c in ("reason", "measured", "threshold", "low", "high")), band).alias("reason"))
    measured, threshold = parse_reason(F.col("reason"))
    return told.select("path", "reason", measured.alias("measured_value"), threshold.alias("threshold"))


def filter_report(judged: DataFrame) -> DataFrame:
    """(part, value): a line with the counts, then rejected frames with their reasons, then kept ones."""
    name = F.col("path") if "path" in judged.columns else F.col("frame_id").cast("string")
    head = judged.agg(F.count_if(F.col("reason").isNull()).alias("k"), F.count_if(F.col("reason").isNotNull()).alias("r"), F.count(F.lit(1)).alias("n"))
    lines = head.select(F.lit(0).alias("part"), F.format_string("kept %d / rejected %d / total %d", "k", "r", "n").alias("value"))
    return lines.unionByName(judged.select(F.when(F.col("reason").isNotNull(), 1).otherwise(2).alias("part"), F.concat_ws("\t", name, "reason").alias("value")))


def copy_survivors(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """The catalog rows of kept frames; pixels stay where they are."""
    return frames.join(kept.select("frame_id"), "frame_id", "left_semi")


def footprint_features(rings: DataFrame, ground: DataFrame) -> DataFrame:
    """(line_id, feature): GeoJSON features with flight_line, n_frames, n_xtrack and, where all heights are equal, mean_alt_m."""
    facts = ground.groupBy("line_id").agg(F.count_distinct("line").alias("n_frames"), F.count_distinct("sample").alias("n_xtrack"), F.min("alt").alias("low"), F.max("alt").alias("high"))
    coordinates = F.array(F.transform("ring", lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    properties = F.struct(F.col("line_id").alias("flight_line"), "n_frames", "n_xtrack", F.when(F.col("low") == F.col("high"), F.col("low")).alias("mean_alt_m"))
    return rings.join(facts, "line_id").select("line_id", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def safe_number(x: Column) -> Column:
    """NULL for NaN and infinities, as JSON has neither."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def side_path(path: str, what: str) -> str:
    """Where a raster that goes with another is written and read: out.tif gives out.sources.tif."""
    stem, end = os.path.splitext(path)
    return f"{stem}.{what}{end}"
