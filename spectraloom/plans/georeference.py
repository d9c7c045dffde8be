"""A raw flight line to a georeferenced raster and its footprint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import georef
from ..sources import cubes, text


@dataclass(frozen=True)
class Georeferenced:
    ground: DataFrame
    raster: DataFrame
    extent: DataFrame
    footprint: DataFrame


def run(spark: SparkSession, cube: str, header: str, times: str, log: str, fov_deg: float = 20.0, ground_alt: float = 0.0, time_offset: float = 0.0, bands: list[int] | None = None, simplify: float = 1e-5, **sensor) -> Georeferenced:
    """Checks the files against each other, then lazily: poses, ground points, one index map for all bands, values.

    ValueError for a missing header key, another number of times than lines, falling times, unequal durations, a cube of
    another size, or ground above a pose.
    """
    h = text.read_header(spark, header).first()
    poses = georef.checked_poses(text.read_navigation(spark, log), text.read_times(spark, times, h.lines), time_offset)
    georef.require_below(poses, ground_alt)
    ground = georef.flat_ground(poses, h.samples, fov_deg, ground_alt, **sensor)
    values = cubes.read_cube(spark, cube, h, bands).withColumn("line_id", F.lit(0))
    return Georeferenced(ground, georef.resample(values, ground), georef.extent(ground), georef.simplify(georef.footprint(ground), simplify))
