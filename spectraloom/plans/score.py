"""All figures of a mosaic against a reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import gaps, quality
from ..tables import materialise


@dataclass(frozen=True)
class Score:
    """Lazy tables, and the number of bands; valid has the common valid cells of each; filled, gaps and seams are None without a fill mask or sources."""

    metrics: DataFrame
    aggregates: DataFrame
    skipped: DataFrame
    angle: DataFrame
    coverage: DataFrame
    nodata: DataFrame
    valid: DataFrame
    bands: int
    filled: DataFrame | None = None
    gaps: DataFrame | None = None
    seams: DataFrame | None = None
    seam_length: DataFrame | None = None


def run(reference: DataFrame, mosaic: DataFrame, bands: int, fillmask: DataFrame | None = None, sources: DataFrame | None = None, a: float = 1.0, e: float = -1.0) -> Score:
    """Both tables hold every cell of one grid (see quality.align). ValueError if no band has a common valid cell."""
    metrics = materialise(quality.band_metrics(reference, mosaic, fillmask), "band-metrics")
    if metrics.isEmpty():
        raise ValueError("no band has a pixel that is valid in both rasters")
    return Score(
        metrics,
        quality.aggregates(metrics),
        quality.skipped_bands(reference, quality.pair(reference, mosaic)),
        quality.spectral_angle(reference, mosaic, bands),
        quality.coverage_ratio(mosaic),
        quality.nodata_fraction(mosaic),
        quality.scalars(quality.pair(reference, mosaic)).select("band", "n"),
        bands,
        quality.filled_ratio(mosaic, fillmask) if fillmask is not None else None,
        gaps.region_metrics(fillmask, a, e) if fillmask is not None else None,
        quality.seam_statistics(mosaic, sources) if sources is not None else None,
        quality.seam_length(sources) if sources is not None else None,
    )
