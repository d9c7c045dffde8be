"""Byte-level helpers, folds and samples that the text operators have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder_of_id(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def sampled(labelled: DataFrame, class_col: str, key: Column, rows_per_class: int) -> DataFrame:
    """At most about rows_per_class rows of each class, picked by a hash of key; the class counts come from all rows."""
    counts = labelled.groupBy(class_col).count().collect()  # one row per class
    keep = F.lit(False)
    for name, n in counts:
        share = min(1.0, rows_per_class / n)
        lucky = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
        keep = keep | ((F.col(class_col) == F.lit(name)) & lucky)
    return labelled.where(keep)


def slices(texts: list, most_chars: int = 1 << 20, most_rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with about most_chars characters each; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and (size + n > most_chars or i - start >= most_rows):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


#: ASCII white space: space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space in UTF-8 bytes."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACES[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


_ODD = np.uint64(0x9E3779B97F4A7C15)


class SpanHasher:
    """64-bit hashes of byte spans in constant time each: H(s, e) = sum of mix(byte) * r^(i - s) modulo 2^64, r odd."""

    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(int(_ODD), -1, 1 << 64)
            for name, r in (("_powers", _ODD), ("_inverse", np.uint64(inverse))):
                steps = np.full(size, r, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))

    def __init__(self, mixed: np.ndarray):
        self._grow(len(mixed) + 1)
        self._sums = np.zeros(len(mixed) + 1, dtype=np.uint64)
        np.cumsum(mixed * self._powers[: len(mixed)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return finish(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def finish(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: A random-looking 64-bit value for each byte, from a rule.
MIXED = finish((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
