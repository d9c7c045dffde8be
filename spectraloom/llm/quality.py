"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are hashed as they are (lower-cased) and by their shape (case, digits, closing punctuation, repetition of the word
before), as n-grams of one to three; a text's features are the shares of its n-grams in each family, and its score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..tables import materialise
from .langid import sums
from .shared import MIXED, SpanHasher, finish, sampled, slices, word_bounds

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_MIXED_LOWER = MIXED[_LOWER]
_UPPER, _DIGIT, _LETTER = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(48, 58), [*range(97, 123), *range(128, 256)]))
#: Weight of each family of features: words, pairs of words, then shapes, pairs and triples of shapes.
SCALES = (4.0, 4.0, 8.0, 8.0, 8.0)


def features(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets for each family and word, and the number of words of each text; an n-gram never reaches into another text."""
    encoded = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\n".join(encoded), dtype=np.uint8)
    starts, ends = word_bounds(data)
    limits = np.cumsum([len(x) + 1 for x in encoded])
    owner = np.searchsorted(limits, starts, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    word = SpanHasher(_MIXED_LOWER[data])(starts, ends)

    def has(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[ends] - total[starts]

    upper, digits, lower = has(_UPPER), has(_DIGIT), has(_LETTER)
    ordinary = _UPPER | _DIGIT | _LETTER
    last = data[ends - 1] if len(ends) else np.zeros(0, dtype=np.uint8)
    before = data[np.maximum(ends - 2, starts)] if len(ends) else last
    first = data[starts] if len(ends) else last
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    shape = np.where(ordinary[last], 0, last).astype(np.uint64)
    for flag in (last == before, ~ordinary[first], same, (upper >= 2) & (lower == 0), upper > 0, lower > 0, digits > 0):
        shape = shape * np.uint64(2) + flag
    shape = finish(shape + np.uint64(1))

    def follow(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        out = x.copy()
        if len(x) > k:
            joined = finish(x[:-k] * np.uint64(3) + y[k:])
            inside = owner[k:] == owner[:-k]
            out[:-k] = np.where(inside, joined, x[:-k])
        return out

    two = follow(shape, shape, 1)
    families = [word, follow(word, word, 1), shape, two, follow(two, shape, 2)]
    return [(finish(x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64) for k, x in enumerate(families)], counts


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; a text without words gets that of the bias alone."""
        families, counts = features(texts, self.bits)
        total = np.full(len(texts), self.bias)
        for scale, buckets in zip(SCALES, families, strict=True):
            total += scale * sums(self.weights[buckets], counts) / np.maximum(counts, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _train(rows: list[tuple[int, float, np.ndarray, np.ndarray]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> QualityModel:
    """FTRL-proximal updates per coordinate; the last coordinate is the bias, which isn't regularised by l1."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    strength = np.full(size, l1)
    strength[-1] = 0

    def weights(at) -> np.ndarray:
        held = z[at]
        shrunk = np.sign(held) * np.maximum(np.abs(held) - strength[at], 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for label, weight, at, value in rows:
            w = weights(at)
            gradient = weight * (1 / (1 + np.exp(-np.clip(w @ value, -40, 40))) - label) * value
            squares = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / alpha * w
            n[at] += squares
    final = weights(slice(None))
    return QualityModel(final[:-1].astype(np.float32), float(final[-1]), bits)


def fit(labelled_texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 16, rows_per_label: int = 2500, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, most_pairs: int = 1 << 24) -> QualityModel:
    """Fits on at most about rows_per_label rows of each label; rows of a thinned label weigh accordingly more.

    labels may hold nulls (left out) and repeated ids (the lowest label counts); of texts that share an id one is learnt. The sampled labels, a bounded number of rows, are
    broadcast to the texts; the sparse rows of the sample come to the driver, where the
    updates run in an order fixed by hashes of the ids. Of rows that together have more than most_pairs features (8 bytes each, so 128 MB), which takes
    labelled texts of over 3,000 different features on average, only the first in this order are learnt. Without any label the model scores 0.5.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    totals = dict(known.groupBy("__label").count().collect())
    if not totals:
        return QualityModel(np.zeros(1 << bits, dtype=np.float32), 0.0, bits)
    picked = F.broadcast(sampled(known, "__label", F.col("__id"), rows_per_label))
    texts = labelled_texts.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(picked, "__id")

    def sparse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(1).to_pylist()
            for start, end in slices(texts):
                families, counts = features(texts[start:end], bits)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                places, values = [], []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    dense = np.zeros((1 << bits) + 1)
                    dense[-1] = 1
                    for scale, buckets in zip(SCALES, families, strict=True):
                        np.add.at(dense, buckets[a:b], scale / max(1, counts[i]))
                    at = np.flatnonzero(dense)
                    places.append(at.astype(np.int32))
                    values.append(dense[at].astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(2).slice(start, end - start), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["id", "label", "at", "value"])

    kind = labels.schema[id_col].dataType.simpleString()
    made = texts.select("__id", "__text", "__label").mapInArrow(sparse, f"id {kind}, label int, at array<int>, value array<float>")
    made = materialise(made.groupBy("id", "label").agg(F.min(F.struct("at", "value")).alias("x")).select(F.xxhash64("id").alias("place"), "id", "label", "x.*"), "sparse-rows")
    sizes = made.select("place", F.size("at").alias("n")).orderBy("place").toArrow()
    over = np.flatnonzero(np.cumsum(sizes.column("n").to_numpy()) > most_pairs)
    if len(over):
        made = made.where(F.col("place") < F.lit(int(sizes.column("place").to_numpy()[over[0]])))
    rows = made.orderBy("place", "id").toArrow()
    mine = rows.column("label").to_numpy()
    share = {k: totals[k] / max(1, int((mine == k).sum())) for k in totals}
    mean = sum(share[k] * int((mine == k).sum()) for k in totals) / max(1, len(mine))
    places, values = (rows.column(c).combine_chunks() for c in ("at", "value"))
    bounds = places.offsets.to_numpy()
    places, values = places.values.to_numpy(), values.values.to_numpy()
    examples = [(int(k), share[int(k)] / mean, places[a:b], values[a:b]) for k, a, b in zip(mine, bounds[:-1], bounds[1:], strict=True)]
    return _train(examples, bits, epochs, alpha, beta, l1, l2)


def score(df: DataFrame, model: QualityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then quality_score (0 to 1, higher is better), from whole texts alone: one row for each row of df.

    Null texts count as empty; those get the score of the bias. Columns that aren't in keep are left out, so none can clash.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    columns = [F.col(f"`{c}`") for c in keep]
    if text_col not in keep or df.schema[text_col].dataType != StringType():
        columns.append(F.col(f"`{text_col}`").cast("string").alias("__text"))
    place = len(keep) if len(columns) > len(keep) else keep.index(text_col)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = [x or "" for x in batch.column(place).to_pylist()]
            for start, end in slices(texts):
                scores = held.value.score(texts[start:end])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start) for i in range(len(keep))), pa.array(scores, pa.float64())], names=[*keep, "quality_score"])

    picked = df.select(*columns)
    return picked.mapInArrow(batches, StructType([*picked.schema.fields[: len(keep)], StructField("quality_score", DoubleType())]))
