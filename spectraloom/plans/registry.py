"""Named methods; the first of each kind is the default."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import fill, filters, mosaic


@dataclass(frozen=True)
class Method:
    id: str
    label: str
    note: str
    run: Callable[..., DataFrame]


FILTERS = (
    Method("v1", "Fixed thresholds", "skew, area, aspect, valid share, saturation and contrast against fixed limits", lambda frames, pixels, limits=None, **_: filters.hard(frames, pixels, limits) if limits else filters.hard(frames, pixels)),
    Method("v2", "Median absolute deviation", "area against the spread of all frames", lambda frames, pixels, factor=filters.MAD_FACTOR, **_: filters.adaptive(frames, factor)),
    Method("v3", "Dropout and stripes", "zeros and column stripes in every band", lambda frames, pixels, max_dropout=filters.MAX_DROPOUT, max_stripe=filters.MAX_STRIPE, **_: filters.per_band(frames, pixels, max_dropout, max_stripe)),
)
MOSAICS = (
    Method("v1", "First frame wins", "frame order decides", lambda pixels, **_: mosaic.first_wins(pixels)),
    Method("v2", "Most interior pixel", "the frame whose border is farthest wins", lambda pixels, height=None, width=None, **_: mosaic.best_pixel(pixels, height, width)),
    Method("v3", "Last frame on top", "as in stacked virtual rasters", lambda pixels, **_: mosaic.last_wins(pixels)),
)
FILLS = (
    Method("v3", "Inverse distance", "four quadrants", lambda pixels, mask, reach, passes: fill.fill(pixels, mask, reach, passes)),
    Method("v2", "Inverse distance, tile by tile", "bounded memory; rare cells differ", lambda pixels, mask, reach, passes: fill.fill_tiled(pixels, mask, reach, passes)),
)


def labels(methods: tuple[Method, ...]) -> list[str]:
    return [m.label for m in methods]


def tooltip(methods: tuple[Method, ...]) -> str:
    return "\n".join(f"{m.label}: {m.note}" for m in methods)


def method(methods: tuple[Method, ...], name: str | int = 0) -> Method:
    """By place or id; KeyError for unknown ones."""
    if isinstance(name, int):
        return methods[name]
    return {m.id: m for m in methods}[name]
