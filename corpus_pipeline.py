"""The corpus pipeline: quality, line copies, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All but the last return the columns of docs, extra ones of any name included: an operator sees doc_id, text and one column that packs the rest, so
no name of its own can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import decontaminate, linededup, quality, queries, sentencepieces, simhash
from spectraloom.tables import chain, materialise


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): row has all columns but the text."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _unpacked(packed: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, some of them changed."""
    return packed.select(*(F.col("text") if c == "text" else changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores below its bound; it learns from the labelled documents of sf_dir.

    Null and empty texts are scored as empty ones; repeated rows and rows without an id are scored each by itself.
    """
    scored = quality.score(_packed(docs), queries.quality_model(spark, sf_dir), keep=("text", "row"))
    return _unpacked(scored.where(F.col("quality_score") >= queries.QUALITY_BOUND), docs)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines with an earlier near copy, and short ones with an earlier copy; n_chars follows.

    A document that loses all its lines stays with an empty text, a null text stays null; repeated rows keep the same lines.
    """
    kept = linededup.drop_near_copies(_packed(docs))
    return _unpacked(kept, docs, n_chars=F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar texts (five-word shingles, 0.8) the one with the smallest id stays, once if its row is repeated.

    Pairs come from SimHash by anchors, those beyond its three bits from an exact prefix filter; all are verified on the whole texts.

    Rows that share an id but not the text are documents of their own; rows without an id come last. Null and empty texts are alike. Of repeated rows that
    differ in other columns the first by these, as JSON, stays.
    """
    groups = materialise(simhash.similar_texts(docs.select("doc_id", "text")), "similar-texts")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    first = groups.groupBy("component").agg(F.min(place).alias("x")).select(F.col("x.no_id").alias("no_id"), F.coalesce("x.id", F.lit(0)).alias("id"), F.col("x.h").alias("own"))
    first = materialise(first, "first-documents")
    # repeats shrink to one row before anything is shuffled, and the join finds the rows where the aggregation has put them
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own")]
    rows = _packed(docs).select(*key, F.struct("text", "row").alias("whole"), F.coalesce(F.to_json("row"), F.lit("")).alias("order"))
    one = rows.groupBy("no_id", "id", "own").agg(F.min_by("whole", "order").alias("whole"))
    return _unpacked(one.join(first, ["no_id", "id", "own"], "left_semi").select("whole.*"), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak a benchmark item. Null and empty texts leak nothing; repeated rows go or stay alike."""
    marked = decontaminate.mark(_packed(docs), queries.table(spark, sf_dir, "benchmark"))
    return _unpacked(marked.where(~F.col("contaminated")), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all pieces of each text and the bytes they cover: doc_id, n_tokens, ids, begins, ends and decoded_sha256.

    One row for each row of docs, in which repeats and rows without an id count; a null text has no pieces, as an empty one. Other columns are left out.
    """
    encoded = sentencepieces.encode(docs.select("doc_id", "text"), queries.tokenizer_file("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_copied_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenise),
]

#: SQL can't express the classifier, the fingerprints and the encoding; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage leaves behind is deleted when its successor is written."""
    return chain(queries.table(spark, sf_dir, "documents"), [(name, lambda docs, stage=stage: stage(spark, docs, sf_dir)) for name, stage in STAGES])
