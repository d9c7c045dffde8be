"""Frames judged as they arrive: an extension, as a batch of frames is the usual input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Thresholds
from ..operators import filters


def read_frames(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of catalog rows from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def judge(frames: DataFrame, median_area: float, limits: Thresholds = Thresholds()) -> DataFrame:
    """frames with the reason by the rules on metadata. The median is that of an earlier batch, so no state is kept."""
    area, skew, aspect = filters.area(), filters.skew(), filters.aspect()
    reason = F.when(skew > limits.skew_max, "skew").when((area < limits.area_low * median_area) | (area > limits.area_high * median_area), "area").when(aspect > limits.aspect_max, "aspect")
    return frames.withColumn("reason", reason)


def write(judged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet exactly once, over all that is there now."""
    return judged.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
