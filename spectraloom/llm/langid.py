"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams per language are summed by Spark; the matrix of log probabilities (buckets x languages, its size fixed
by parameters) is broadcast, and whole texts are scored in numpy as sparse rows times that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sampled, slices

UNKNOWN = "und"
#: n-gram lengths; at most 3, as two blanks part the texts of a slice.
LENGTHS = (2, 3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts in turn, how many each text has, and which texts have a letter.

    Texts are lower-cased and everything but letters counts as a blank; an n-gram holds a letter at least.
    """
    lowered = [x.lower() for x in texts]
    points = np.frombuffer(("".join(f"  {x} " for x in lowered) + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, 32)
    bounds = np.concatenate([[0], np.cumsum([len(x) + 3 for x in lowered])])
    total = bounds[-1]
    seen = np.concatenate([[0], np.cumsum(letter)])
    parts, owners = [], []
    for n in LENGTHS:
        hashed = np.full(total, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            hashed = (hashed ^ points[k : k + total]) * np.uint32(0x85EBCA6B)
            hashed ^= hashed >> np.uint32(15)
        good = seen[n : n + total] > seen[:total]
        parts.append(((hashed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits))[good])
        owners.append(np.repeat(np.arange(len(texts)), np.diff(bounds))[good])
    counts = sum(np.bincount(x, minlength=len(texts)) for x in owners)
    order = np.argsort(np.concatenate(owners), kind="stable") if len(LENGTHS) > 1 and len(texts) > 1 else slice(None)
    return np.concatenate(parts)[order], counts, seen[bounds[1:]] > seen[bounds[:-1]]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of values, counts[i] rows each; zero where that is 0."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=np.float64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their log priors, and log P(bucket | language) as a matrix of buckets x languages."""

    languages: tuple[str, ...]
    priors: np.ndarray
    matrix: np.ndarray
    bits: int

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        buckets, counts, lettered = ngrams(texts, self.bits)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logs = sums(self.matrix[buckets], counts) + self.priors
        best = logs.argmax(axis=1)
        score = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, score, 0.0)


def fit(labelled: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", bits: int = 15, rows_per_language: int = 4000, most_languages: int = 256) -> LanguageModel:
    """Fits on the rows with a text and a language, at most about rows_per_language of each language (picked by a hash of key).

    The model has 2^bits x languages numbers. More than most_languages languages are an error; none at all give a model that
    answers `und` with score 0.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"), key.alias("__key"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in parts:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                total = totals.setdefault(name, np.zeros(1 << bits, dtype=np.int64))
                for start, end in slices(own):
                    total += np.bincount(ngrams(own[start:end], bits)[0], minlength=1 << bits)
        for name, total in totals.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(total[full])], names=["lang", "bucket", "n"])

    counts = {name: n for name, n in rows.groupBy("__lang").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = tuple(sorted(counts))
    matrix = np.zeros((1 << bits, len(languages)))
    if languages:
        table = sampled(rows, "__lang", F.col("__key"), rows_per_language).select("__lang", "__text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        place = {name: k for k, name in enumerate(languages)}
        at = np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64)
        matrix[table.column("bucket").to_numpy(), at] = table.column("n").to_numpy()
        matrix = np.log((matrix + 0.1) / (matrix.sum(axis=0) + 0.1 * (1 << bits)))
    priors = np.log(np.array([counts[x] for x in languages], dtype=np.float64) / max(1, sum(counts.values())))
    return LanguageModel(languages, priors, matrix.astype(np.float32), bits)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then lang_pred and score (0 to 1), from whole texts alone: one row for each row of df.

    A text that is null, empty or without a letter gets `und` and score 0; equally likely languages give the first by name.
    Columns that aren't in keep are left out, so none can clash.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = [x or "" for x in batch.column(len(keep)).to_pylist()]
            for start, end in slices(texts):
                names, scores = held.value.predict(texts[start:end])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    picked = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(batches, f"{kept}, lang_pred string, score double")
