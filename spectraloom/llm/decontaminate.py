"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, windows of the resulting templates are hashed, also with names as literals and by what stands there, and the windows of documents are
hash-joined to those of the benchmark. Windows that match may differ in what fills the placeholders, as in re-parameterised
questions; each benchmark value must then be replaced by the same document value all along. Items that differ only in what fills their
placeholders, with equal values at the same places, are one family and are matched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise
from .shared import MIXED, SpanHasher, finish, slices, word_bounds

#: Words of a window; items with fewer have one window of their own length.
WINDOW = 8
#: Items with fewer words are found only where they are all of a line.
LEAST_WORDS = 4
#: So many words in a row are a leak, or all of a shorter item.
LEAST_RUN = 13
#: So large a share of an item's windows is a leak even if they don't follow one another.
LEAST_SHARE = 0.5
#: Kinds of windows: of the template, of the template with its names, and of copies.
KINDS = 3
#: Bits that the prefilter takes of each window's hash: its bitmap has 2^22 bits, 512 KB, whatever the benchmark's size.
FILTER_BITS = 22

# fixed values: units that become placeholders after a number
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l cl s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years km/h mph m/s hz khz mhz ghz w kw j kj v a pa bar °c °f % percent dollar dollars euro euros cent cents pound pounds"

_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT = np.isin(np.arange(256), range(48, 58))
_CORE = _LETTER | _DIGIT
_STOP = np.isin(np.arange(256), list(b".!?:;"))
#: Bytes of the character that a byte begins.
_WIDTH = np.select([np.arange(256) < 0x80, np.arange(256) < 0xE0, np.arange(256) < 0xF0], [1, 2, 3], 4)


def _lowered(text: str) -> str:
    """text in lower case, where that keeps the number of bytes."""
    low = text.lower()
    if len(low.encode("utf-8", "surrogatepass")) == len(text.encode("utf-8", "surrogatepass")):
        return low
    return "".join(y if len((y := x.lower()).encode("utf-8", "surrogatepass")) == len(x.encode("utf-8", "surrogatepass")) else x for x in text)


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(UNITS.encode(), dtype=np.uint8)
    starts, ends = word_bounds(data)
    return np.sort(SpanHasher(MIXED[data])(starts, ends))


@dataclass
class Template:
    """Words of several texts in turn: template codes, hashes of what stands there, placeholder types (0: literal), and whose they are."""

    codes: np.ndarray
    values: np.ndarray
    slots: np.ndarray
    owner: np.ndarray
    counts: np.ndarray
    lines: np.ndarray

    def fills(self) -> np.ndarray:
        """For placeholders the place, in their text, where their value stands first; 0 for literals."""
        out = np.zeros(len(self.values), dtype=np.int64)
        at = np.flatnonzero(self.slots > 0)
        if len(at):
            _, first, back = np.unique(np.stack([self.owner[at].astype(np.uint64), self.values[at]]), axis=1, return_index=True, return_inverse=True)
            out[at] = at[first[back.ravel()]] - (np.cumsum(self.counts) - self.counts)[self.owner[at]]
        return out

    def families(self) -> np.ndarray:
        """A hash for each text of its template and of which placeholders are filled alike."""
        ends = np.cumsum(self.counts)
        return SpanHasher(np.where(self.slots > 0, finish(self.codes ^ finish(self.fills().astype(np.uint64) + np.uint64(1))), self.codes))(ends - self.counts, ends)

    def whole_lines(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that are all of a line, hashed by what stands there."""
        edge = np.concatenate([[True], self.lines[1:] != self.lines[:-1], [True]]) if len(self.lines) else np.ones(1, dtype=bool)
        first = np.flatnonzero(edge)
        starts = first[:-1][np.diff(first) == size]
        return starts, SpanHasher(self.values)(starts, starts + size)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows inside one text with more literals than placeholders."""
        return self._hashed(self.codes, self.slots > 0, size, size // 2)

    def named_windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows with more words and names than other placeholders, names being literals.

        Which words are typed as names depends on capitals and line breaks; these windows don't.
        """
        names = self.slots == 2
        return self._hashed(np.where(names, self.values, self.codes), (self.slots > 0) & ~names, size, size // 2)

    def copied_windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows, hashed by what stands there: only copies have them."""
        return self._hashed(self.values, self.slots > 0, size, -1)

    def _hashed(self, codes: np.ndarray, slots: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        if len(codes) < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        literal = np.concatenate([[0], np.cumsum(~slots)])
        inside = self.owner[size - 1 :] == self.owner[: len(self.owner) - size + 1]
        starts = np.flatnonzero(inside & (literal[size:] - literal[:-size] > least))
        return starts, SpanHasher(codes)(starts, starts + size)


def template(texts: list[str]) -> Template:
    """Words are lower-cased without the punctuation around them; words of punctuation alone are left out."""
    encoded = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\n".join(encoded), dtype=np.uint8)
    low = np.frombuffer("\n".join(map(_lowered, texts)).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_bounds(data)
    core = np.concatenate([np.flatnonzero(_CORE[data]), [len(data)]])
    first = core[np.searchsorted(core, starts)] if len(starts) else starts
    keep = first < ends
    last_before = core[np.maximum(np.searchsorted(core, ends) - 1, 0)] + 1 if len(ends) else ends
    limits = np.cumsum([len(x) + 1 for x in encoded])
    owner = np.searchsorted(limits, starts, side="right")
    # a name starts with a capital and goes on in small letters, not at the start of a sentence or line
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(starts), dtype=bool)
    if len(starts) > 1:
        opens[1:] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    starts, ends, owner, opens = first[keep], last_before[keep], owner[keep], opens[keep]

    def count(marks: np.ndarray, upto: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[upto] - total[starts]

    values = SpanHasher(MIXED[low])(starts, ends)
    letters, digits = count(_LETTER[data], ends), count(_DIGIT[data], ends)
    slots = np.where(digits > 0, 1, 0)
    if len(starts):
        capital = count(data != low, np.minimum(starts + _WIDTH[data[starts]], ends))
        slots[(slots == 0) & ~opens & (capital > 0) & (count(data != low, ends) == capital) & (letters >= 2)] = 2
        unit = np.zeros(len(starts), dtype=bool)
        unit[1:] = (slots[:-1] == 1) & (owner[1:] == owner[:-1])
        slots[unit & (slots == 0) & np.isin(values, _unit_hashes())] = 3
    codes = np.where(slots == 0, values, finish(slots.astype(np.uint64) + np.uint64(0xABCDEF)))
    return Template(codes, values, slots, owner, np.bincount(owner, minlength=len(texts)), lines[starts])


def _window_rows(picked: DataFrame, sizes: tuple[int, ...], whole_short: bool, bitmap) -> DataFrame:
    """(id, h, size, at, hash, words, slots, kind, n_words, family) of the windows of picked (id, h, text): of documents those the bitmap holds.

    words are hashes, but for the placeholders of items the places that fills() gives.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, dtype=np.uint8), bitorder="little").view(bool)
        for batch in parts:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            for start, end in slices(texts):
                made = template(texts[start:end])
                offset = np.cumsum(made.counts) - made.counts
                words = np.where(made.slots > 0, made.fills(), made.values.view(np.int64)) if whole_short else made.values.view(np.int64)
                families = made.families().view(np.int64) if whole_short else np.zeros(len(made.counts), dtype=np.int64)
                for size in sizes:
                    if size >= LEAST_WORDS:
                        found = [made.windows(size), made.named_windows(size), made.copied_windows(size)]
                    else:
                        nothing = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
                        found = [nothing, nothing, made.copied_windows(size) if whole_short else made.whole_lines(size)]
                    at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                    kinds = np.repeat(np.arange(KINDS, dtype=np.int32), [len(x[0]) for x in found])
                    if whole_short:
                        good = (made.counts[made.owner[at]] == size) | (size == WINDOW)
                    else:
                        good = held[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    at, hashes, kinds = at[good], hashes[good], kinds[good]
                    if not len(at):
                        continue
                    # without placeholders the kinds have one hash
                    _, first = np.unique(np.stack([at.view(np.uint64), hashes]), axis=1, return_index=True)
                    at, hashes, kinds = at[first], hashes[first], kinds[first]
                    own = made.owner[at]
                    places = at[:, None] + np.arange(size)
                    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * size)
                    values = pa.ListArray.from_arrays(ends, pa.array(words[places].ravel()))
                    slots = pa.ListArray.from_arrays(ends, pa.array(made.slots[places].astype(np.int32).ravel()))
                    rows = pa.array(own + start)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(at), size, dtype=np.int32)), pa.array((at - offset[own]).astype(np.int64)), pa.array(hashes.view(np.int64)), values, slots, pa.array(kinds), pa.array(made.counts[own].astype(np.int64)), pa.array(families[own])], names=names)

    names = ["id", "h", "size", "at", "hash", "words", "slots", "kind", "n_words", "family"]
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(batches, f"id {kind}, h bigint, size int, at bigint, hash bigint, words array<bigint>, slots array<int>, kind int, n_words bigint, family bigint")


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, h, item, covered): documents that leak the benchmark, h being xxhash64 of their text; each pair of id and text once.

    Items of one template whose placeholders are filled alike at the same places are a family, named by its smallest item. A document leaks a family if
    LEAST_RUN template words in a row (all of a shorter item) or LEAST_SHARE of an item's windows match, and every
    placeholder value of the benchmark has the same counterpart all along that occurrence of the item; windows with the values of an item always
    count. Items under LEAST_WORDS words match lines that hold nothing else. A window that several families share is held against each of them, so matches
    grow with the families, not the items, that share it. Null or empty texts and rows with null item ids match
    nothing. covered is the largest number of words in a row, or of windows.
    """
    spark = documents.sparkSession
    named = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    items = named.groupBy("text").agg(F.min("id").alias("id")).select("id", F.xxhash64("text").alias("h"), "text")
    made = materialise(_window_rows(items, tuple(range(1, WINDOW + 1)), True, None), "item-windows")
    families = materialise(made.groupBy("family").agg(F.min("id").alias("item")), "families")
    same = made.groupBy("size", "hash", "family", F.col("at").alias("item_at"))
    known = same.agg(F.min("kind").alias("kind"), F.first("words").alias("item_values"), F.first("slots").alias("item_slots"), F.first("n_words").alias("item_words"))
    known = materialise(known, "known-windows")
    prefixes = known.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("p")).distinct().toArrow().column("p").to_numpy()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[prefixes] = True
    bitmap = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    used = tuple(sorted(x[0] for x in known.select("size").distinct().collect()))

    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    hits = materialise(_window_rows(texts, used, False, bitmap), "window-hits")
    met = hits.select("id", "h", "size", "at", "hash", "words").join(known, ["size", "hash"]).withColumn("shift", F.col("at") - F.col("item_at"))
    filled = F.filter(F.arrays_zip(F.col("item_values").alias("b"), F.col("words").alias("d"), F.col("item_slots").alias("slot")), lambda x: x["slot"] > 0)
    met = met.withColumn("pairs", F.transform(filled, lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d"))))
    # windows with the same shift belong to one occurrence of an item; what one has as a copy, or without placeholders, needs no agreement
    occurrence = ["id", "h", "size", "family", "shift", "item_words"]
    copied = (F.col("kind") == KINDS - 1) | (F.size("pairs") == 0)
    met = materialise(met.groupBy(*occurrence, "at", "item_at").agg(F.max(copied).alias("equal"), F.first("pairs").alias("pairs")), "window-matches")

    # its slots must agree from end to end, but windows filled like an item's are copies whatever stands around them
    pairs = F.array_distinct(F.flatten(F.collect_set("pairs")))
    fits = F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda x: x["b"])))
    whole = met.groupBy(*occurrence).agg(fits.alias("fits"), F.collect_list(F.struct("at", "item_at", "equal")).alias("places"))
    kept = whole.select(*occurrence, F.inline(F.filter("places", lambda x: F.col("fits") | x["equal"])))
    met = materialise(kept.select(*occurrence, "at", "item_at"), "consistent-matches")
    order = Window.partitionBy(*occurrence).orderBy("at")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(order)).groupBy(*occurrence, "run").agg((F.count(F.lit(1)) + F.col("size") - 1).alias("covered"))
    in_a_row = runs.where(F.col("covered") >= F.least(F.lit(LEAST_RUN), F.col("item_words"))).select("id", "h", "family", "covered")
    # places whose only windows are those of copies say nothing against a new fill: the share is taken without and with them
    strict = known.groupBy("family", "item_at").agg(F.min("kind").alias("kind"))
    levels = F.explode(F.sequence(F.col("kind"), F.lit(KINDS - 1))).alias("level")
    totals = strict.select("family", levels).groupBy("family", "level").agg(F.count(F.lit(1)).alias("windows"))
    places = met.select("id", "h", "family", "item_at").distinct().join(strict, ["family", "item_at"]).select("id", "h", "family", levels)
    shares = places.groupBy("id", "h", "family", "level").agg(F.count(F.lit(1)).alias("covered")).join(totals, ["family", "level"])
    in_parts = shares.where(F.col("covered") >= F.greatest(LEAST_SHARE * F.col("windows"), F.lit(2))).select("id", "h", "family", "covered")
    return in_a_row.unionByName(in_parts).join(families, "family").groupBy("id", "h").agg(F.min("item").alias("item"), F.max("covered").alias("covered"))


def mark(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with contaminated (boolean), item_id (the smallest item found, else null) and covered (0 for none).

    One row for each row of documents; repeated rows are marked alike; null and empty texts are never contaminated. These three columns replace
    columns of the same names, all others pass through.
    """
    leaks = materialise(find_leaks(documents, benchmark, id_col, text_col), "leaks").select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("item").alias("__item"), F.col("covered").alias("__covered"))
    rows = documents.withColumn("__own", F.xxhash64(F.col(text_col)))
    joined = rows.join(leaks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__h")), "left")
    marked = joined.withColumns({"contaminated": F.col("__item").isNotNull(), "item_id": F.col("__item"), "covered": F.coalesce("__covered", F.lit(0).cast("bigint"))})
    return marked.drop("__id", "__h", "__own", "__item", "__covered")
