"""Thresholds and the columns of the logical tables.

frames   frame_id, width, height, a, b, c, d, e, f (affine), crs, band_count, dtype, dtype_max, nodata
pixels   frame_id, band, y, x, v          one row per valid value; NULL or a missing row is nodata
cells    frame_id, y, x, spectrum         one row per pixel
fillmask y, x, state                      0 original, 1 interior hole, 2 outside
sources  y, x, source_id                  1-based ordinal of the frame that a pixel comes from

y counts rows from the top and x columns from the left, both from 0. Frame order is meaning: lower frame_id comes first.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Thresholds:
    """Limits of the hard frame filter."""

    skew_max: float = 0.05
    area_low: float = 0.5
    area_high: float = 2.0
    aspect_max: float = 4.0
    centre_window: int = 64
    valid_min: float = 0.5
    std_min: float = 0.005
    saturation_max: float = 0.95


# fixed values: the named presets
PRESETS = {
    "permissive": Thresholds(0.10, 0.25, 4.0, 8.0, 64, 0.20, 0.001, 0.99),
    "default": Thresholds(),
    "strict": Thresholds(0.02, 0.75, 1.5, 2.5, 64, 0.75, 0.01, 0.85),
}
MAX_DROPOUT, MAX_STRIPE, MAD_FACTOR, MAD_SCALE = 0.30, 0.5, 3.0, 1.4826


def preset(name: str, **changes: float) -> Thresholds:
    """A preset by name, whatever its case and surrounding blanks; KeyError for others."""
    return replace(PRESETS[name.strip().lower()], **changes)
