"""Token counts through a digest cache.

The cache is a Parquet table of (version, digest, n_tokens): the digest is SHA-256 of the normalised content, the version SHA-256 of
the tokenizer's file. Only distinct contents without a stored count are encoded; their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialise
from .shared import slices

CACHE = "version string, digest binary, n_tokens bigint"


@lru_cache(maxsize=4)
def _counter(path: str):
    """A function from texts to token counts, without begin, end or added special tokens, truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_version(path: str) -> tuple[str, bool]:
    """Digest of a tokenizer's file, and whether the tokenizer itself takes any run of white space for one blank."""
    with open(path, "rb") as file:
        blob = file.read()
    squeezes = False
    if path.endswith(".json"):
        normalizer = json.loads(blob).get("normalizer") or {}
        steps = normalizer.get("normalizers", [normalizer])
        squeezes = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in steps)
    return hashlib.sha256(blob).hexdigest(), squeezes


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The stored counts of a version; none where the cache doesn't exist yet. Of rows that two writers appended one is taken."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then n_bytes (UTF-8) and n_tokens of each whole text: one row for each row of df, repeated rows too.

    A null or empty text has no bytes and no tokens. Columns that aren't in keep are left out, so none can clash. Texts are
    shuffled once, by digest and after removing copies within each task; the rows that get the counts carry no text, and as
    both sides of that join are shuffled tables, Spark splits a content that very many rows share.
    """
    spark = df.sparkSession
    version, squeezes = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    content: Column = F.regexp_replace(text, "[ \\t\\r\\n]+", " ") if squeezes else text
    keyed = df.select(*(F.col(f"`{c}`") for c in keep), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for batch in parts:
            texts = batch.column(1).to_pylist()
            for start, end in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array([version] * (end - start)), batch.column(0).slice(start, end - start), pa.array(count(texts[start:end]), pa.int64())], names=["version", "digest", "n_tokens"])

    distinct = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    distinct.join(read_cache(spark, cache_path, version), "digest", "left_anti").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    rows = materialise(keyed.select(*keep, "n_bytes", "digest"), "digests")
    needed = rows.select("digest").distinct()
    counts = materialise(read_cache(spark, cache_path, version).join(needed, "digest", "left_semi"), "token-counts")
    return rows.join(counts, "digest").select(*keep, "n_bytes", "n_tokens")
