"""Frames to a gap-filled mosaic: filter, mosaic, mask, fill."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, gaps, mosaic
from ..tables import materialise
from . import registry


@dataclass(frozen=True)
class Result:
    """Lazy tables: judged frames, the mosaic, its fill mask, the filled mosaic and the gaps' figures."""

    judged: DataFrame
    mosaic: DataFrame | None = None
    mask: DataFrame | None = None
    filled: DataFrame | None = None
    gap_metrics: DataFrame | None = None
    overlap: DataFrame | None = None


def run(frames: DataFrame, pixels: DataFrame, filter_method: str = "v1", mosaic_method: str = "v1", fill_method: str = "v3", reach: float = 100.0, passes: int = 0, max_interior_gap_px: int = 0, dry_run: bool = False, reproject: bool = False, **options) -> Result:
    """RuntimeError if every frame is rejected or a band of the mosaic is empty; with dry_run only the filter is applied.

    Actions: one to see that a frame is left, the checks of the catalog, the mosaic's and the mask's tables and the empty-band guard.
    """
    judged = registry.method(registry.FILTERS, filter_method).run(frames, pixels, **options)
    if dry_run:
        return Result(judged)
    kept = materialise(judged, "judged-frames")
    good, _ = filters.split(kept)
    if good.isEmpty():
        raise RuntimeError("all frames were rejected")
    mosaic.require(good, reproject)
    chosen = pixels.join(good.select("frame_id"), "frame_id", "left_semi")
    if reproject:
        chosen, good = mosaic.warp(chosen, good)
    placed = mosaic.place(chosen, good)
    size = mosaic.bounds(good).select("height", "width").first()
    made = materialise(registry.method(registry.MOSAICS, mosaic_method).run(placed, height=size.height, width=size.width), "mosaic")
    bands = good.agg(F.max("band_count")).first()[0]
    present = {r.band for r in made.select("band").distinct().collect()}
    empty = sorted(set(range(1, bands + 1)) - present)
    if empty:
        raise RuntimeError(f"band {empty[0]} of the mosaic has no valid pixel")
    area = gaps.validity(made, size.height, size.width)
    mask = materialise(gaps.fill_mask(area, max_interior_gap_px), "fill-mask")
    grid = mosaic.grid(made, size.height, size.width).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands))))
    full = grid.join(made.select("band", "y", "x", "v"), ["band", "y", "x"], "left")
    filled = registry.method(registry.FILLS, fill_method).run(full, mask, reach, passes)
    first = good.orderBy("frame_id").select("a", "e").first()
    return Result(kept, made, mask, filled, gaps.region_metrics(mask, first.a, first.e), mosaic.overlap_count(placed))
