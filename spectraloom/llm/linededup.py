"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are near copies if their sequences of words are equal, or if both have LEAST_WORDS words or more and are one word apart (inserted, deleted
or replaced): the edit bound is one word in eight. Each line emits its
sequence and every variant with one word deleted as hashed keys; lines with an equal variant are joined, the edit is verified on
the words, and of near copies the earliest line stays. Only lines that share a half with another line can have a near copy,
so a join on hashed halves goes before, and only those emit variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import chain, materialise

#: One word in so many may differ: of two lines one word apart both must have as many words. Shorter lines are copies of equal ones only.
LEAST_WORDS = 8
_BLANKS = " \t\r\x0b\x0c"


def _words(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(_BLANKS)), "[ \\t\\r\\x0B\\f]+")


def _integer(x: Column) -> Column:
    return x.cast("int")


def _without(words: Column, at: Column) -> Column:
    """words without the one at a place; all of them where that is negative."""
    return F.when(at < 0, words).otherwise(F.concat(F.slice(words, F.lit(1), F.greatest(at, F.lit(0))), F.slice(words, F.greatest(at, F.lit(0)) + 2, F.size(words))))


def _line_table(rows: DataFrame, least_words: int) -> DataFrame:
    """A row for each line: its place, a hash of its words and three hashed halves; blank lines have no hashes, short ones no halves.

    A half is a prefix or suffix of n / 2 words, rounded both ways in such a manner that near copies, whose lengths differ by one
    at most, have the half without the edit in common.
    """
    parts = rows.select("__id", "__h", F.posexplode(F.split("__text", "\n")).alias("__line_no", "__line"))
    parts = parts.select("__id", "__h", "__line_no", _words(F.col("__line")).alias("__words")).withColumn("__n", F.size("__words"))
    n, words = F.col("__n"), F.col("__words")

    def prefix(size: Column) -> Column:
        return F.xxhash64(F.lit("prefix"), F.slice(words, F.lit(1), _integer(size)))

    def suffix(size: Column) -> Column:
        return F.xxhash64(F.lit("suffix"), F.slice(words, _integer(n - size + 1), _integer(size)))

    half, less = F.floor(n / 2), F.floor((n - 1) / 2)
    third = F.when(n % 2 == 0, suffix(half)).otherwise(prefix(half + 1))
    long = n >= least_words
    return parts.select("__id", "__h", "__line_no", F.when(words != F.array(F.lit("")), F.xxhash64(words)).alias("__hash"), F.when(long, prefix(half)).alias("__k1"), F.when(long, suffix(less)).alias("__k2"), F.when(long, third).alias("__k3"), (n % 2 == 0).alias("__even"))


def _variants(lines: DataFrame) -> DataFrame:
    """(key, at, hash): the key of each line's whole sequence (at -1), and without the word at each place that may hold the edit.

    Keys are sums of word-and-place hashes, so the running sums of a line give all of its variants in linear time.
    """
    one = lines.select("hash", "by_prefix", "by_suffix", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    lanes = []
    for name, place in (("here", F.col("at")), ("left", F.col("at") - 1)):
        x = F.xxhash64("word", place)
        lanes += [x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).alias(f"{name}_low"), F.shiftrightunsigned(x, 32).alias(f"{name}_high")]
    one = one.select("hash", "by_prefix", "by_suffix", "n", "at", *lanes)
    line = Window.partitionBy("hash")
    running = line.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(f"{name}_{k}").over(running).alias(f"upto_{name}_{k}") for name in ("here", "left") for k in ("low", "high")]
    totals = [F.sum(f"left_{k}").over(line).alias(f"total_left_{k}") for k in ("low", "high")]
    summed = one.select("*", *sums, *totals)
    cut = [F.col(f"upto_here_{k}") - F.col(f"here_{k}") + F.col(f"total_left_{k}") - F.col(f"upto_left_{k}") for k in ("low", "high")]
    n, at = F.col("n"), F.col("at")
    deleted = F.when((F.col("by_prefix") & (at >= F.floor(n / 2))) | (F.col("by_suffix") & (at <= F.floor((n + 1) / 2))), F.struct(F.xxhash64(n - 1, *cut).alias("key"), at.alias("at")))
    whole = F.when(at == n - 1, F.struct(F.xxhash64(n, F.col("upto_here_low"), F.col("upto_here_high")).alias("key"), F.lit(-1).alias("at")))
    return summed.select("hash", F.inline(F.array_compact(F.array(deleted, whole)))).select("key", "at", "hash")


def _near_copies(rows: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Hashes of the distinct lines that have an earlier near copy."""
    sides = F.array(
        F.struct(F.col("__k1").alias("key"), F.lit(True).alias("prefix")),
        F.struct(F.col("__k2").alias("key"), F.lit(False).alias("prefix")),
        F.struct(F.col("__k3").alias("key"), (~F.col("__even")).alias("prefix")),
    )
    halves = lines.where(F.col("__k1").isNotNull()).select(F.col("__hash").alias("hash"), F.inline(sides))
    shared = materialise(halves.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where(F.col("low") != F.col("high")).select("key"), "shared-halves")
    near = halves.join(shared, "key", "left_semi").groupBy("hash").agg(F.max("prefix").alias("by_prefix"), F.min("prefix").alias("all_prefix"))
    near = near.select("hash", "by_prefix", (~F.col("all_prefix")).alias("by_suffix")).join(firsts, "hash")
    wanted = near.groupBy("first.id", "first.h").agg(F.collect_list(F.struct("hash", "by_prefix", "by_suffix", "first")).alias("wanted"))
    texts = rows.join(wanted, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__h") == F.col("h"))).select("wanted", F.split("__text", "\n").alias("parts"))
    found = texts.select(F.inline(F.transform("wanted", lambda x: F.struct(x["hash"].alias("hash"), x["by_prefix"].alias("by_prefix"), x["by_suffix"].alias("by_suffix"), x["first"].alias("first"), F.get("parts", x["first"]["line_no"]).alias("line")))))
    candidates = materialise(found.dropDuplicates(["hash"]).select("hash", "by_prefix", "by_suffix", "first", _words(F.col("line")).alias("words")), "candidate-lines")

    variants = materialise(_variants(candidates), "variants")
    equal = materialise(variants.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where(F.col("low") != F.col("high")).select("key"), "equal-variants")
    meeting = materialise(variants.join(equal, "key", "left_semi").join(candidates.select("hash", "first"), "hash"), "meeting-lines")
    # of the lines that meet at a key only the earliest of each kind is needed: all with the same place, or the whole sequence and a variant, are one word apart
    best = materialise(meeting.groupBy("key", "at").agg(F.min(F.struct("first", "hash", "at")).alias("best")), "earliest-by-place")
    cross = materialise(best.groupBy("key").agg(F.min(F.when(F.col("at") < 0, F.col("best"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("best"))).alias("cut")), "earliest-by-kind")
    mine = meeting.select("key", "at", "hash", "first")
    same = mine.join(best, ["key", "at"]).select("hash", "first", "at", F.col("best").alias("other"))
    other = mine.join(cross, "key").select("hash", "first", "at", F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole")).alias("other"))
    pairs = same.unionByName(other).where(F.col("other.first") < F.col("first")).select("hash", "at", F.col("other.hash").alias("hash_b"), F.col("other.at").alias("at_b")).distinct()
    words = candidates.select("hash", "words")
    checked = pairs.join(words, "hash").join(words.select(F.col("hash").alias("hash_b"), F.col("words").alias("words_b")), "hash_b")
    return checked.where(_without(F.col("words"), F.col("at")) == _without(F.col("words_b"), F.col("at_b"))).select("hash").distinct()


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """df with the lines removed that have an earlier near copy in any text, and n_lines and n_dropped of each text.

    Lines are parted at line feeds, words at ASCII white space. Lines of fewer than least_words words, as those in scripts without blanks,
    go if an earlier line has equal words; others also if an earlier one of least_words words or more is one word apart; blank lines stay. Lines are ordered by id (nulls last),
    then a hash of the text, then their place. A line goes by any earlier line, itself kept or not. Rows that
    repeat both id and text are the same text and keep the same lines. A null text stays null with no lines; an empty one has one short line. A text that loses
    all lines becomes empty; its row stays. Other columns pass through; n_lines and n_dropped replace columns of these names.
    """
    rows = df.withColumns({"__id": F.col(id_col), "__text": F.col(text_col), "__h": F.xxhash64(F.col(text_col))})
    texts = rows.select("__id", "__h", "__text")
    lines = materialise(_line_table(texts, least_words), "lines")
    place = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__h").alias("h"), F.col("__line_no").alias("line_no"))
    long = lines.where(F.col("__hash").isNotNull())
    firsts = materialise(long.groupBy(F.col("__hash").alias("hash")).agg(F.min(place).alias("first")), "first-lines")
    gone = chain(lines, [("near-copies", lambda made: _near_copies(texts, made, firsts))])
    kept = firsts.join(gone, "hash", "left_anti").select("first.id", "first.h", "first.line_no")
    short = lines.where(F.col("__hash").isNull()).select(F.col("__id").alias("id"), F.col("__h").alias("h"), F.col("__line_no").alias("line_no"))
    kept = kept.unionByName(short).groupBy("id", "h").agg(F.array_sort(F.array_distinct(F.collect_list("line_no"))).alias("__kept"))
    joined = rows.join(kept.select(F.col("id").alias("__key"), F.col("h").alias("__key_h"), "__kept"), F.col("__id").eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__key_h")), "left")
    joined = joined.withColumn("__parts", F.split("__text", "\n"))
    none = F.array().cast("array<int>")
    held = F.coalesce("__kept", none)
    text = F.when(F.col("__text").isNotNull(), F.array_join(F.transform(held, lambda i: F.get("__parts", i)), "\n"))
    n_lines = F.when(F.col("__text").isNull(), F.lit(0)).otherwise(F.size("__parts")).cast("long")
    n_dropped = F.when(F.col("__text").isNull(), F.lit(0)).otherwise(F.size("__parts") - F.size(held)).cast("long")
    out = joined.withColumns({text_col: text, "n_lines": n_lines, "n_dropped": n_dropped})
    return out.drop("__id", "__text", "__h", "__key", "__key_h", "__kept", "__parts")
