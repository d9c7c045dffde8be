"""SentencePiece encoding and decoding with byte offsets into the original text.

The text is normalised as the model asks: the compiled character map (a double-array trie and a pool of replacements) is
searched for the longest prefix at each place, white space is escaped, and every byte of the normalised text remembers
the byte of the original it came from. The pieces cover the normalised bytes one after another, so each one projects to a span
of original bytes. The ids themselves are the sentencepiece library's.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

SPACE = "▁".encode()
_SPACE = np.frombuffer(SPACE, dtype=np.uint8)


def _fields(buffer: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buffer[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(buffer):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, buffer[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, buffer[at : at + n]
            at += n


class CharacterMap:
    """The compiled character map of a model: longest-prefix rules over UTF-8 bytes."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement for the longest rule that matches at a place, and how many bytes it consumes."""
        units, best = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (units[node] & 0x7FFFFFFF, i + 1 - at)
        return best and (self.pool[best[0] : self.pool.index(b"\0", best[0])], best[1])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Model:
    """What a model file says about normalisation and about the bytes each piece covers; the library does the encoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            blob = file.read()
        lengths, self.unknown, user = [], None, []
        self.prefix = self.squeeze = self.escape = True
        self.suffix = False
        rules = b""
        for field, value in _fields(blob):
            if field == 1:
                piece = dict(_fields(value))
                text, kind = piece.get(1, b""), piece.get(3, 1)
                if kind == 2:
                    self.unknown = len(lengths)
                elif kind == 4:
                    user.append(text)
                lengths.append(1 if kind == 6 else 0 if kind == 3 else len(text))
            elif field == 2:
                self.suffix = bool(dict(_fields(value)).get(24, 0))
            elif field == 3:
                spec = dict(_fields(value))
                rules = spec.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.lengths = np.array(lengths, dtype=np.int64)
        self.user = sorted(user, key=len, reverse=True)
        self.map = CharacterMap(rules)
        self.plain = not rules and not user and not self.squeeze and self.escape and not self.suffix

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and for their end, the place in data."""
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.plain:
            return self._by_rules(data)
        raw = np.frombuffer(data, dtype=np.uint8)
        width = np.where(raw == 32, 3, 1)
        origin = np.repeat(np.arange(len(raw)), width)
        lead = 3 * self.prefix
        at = np.concatenate([np.zeros(lead, dtype=np.int64), origin, [len(raw)]])
        out = SPACE * self.prefix + data.replace(b" ", SPACE)
        return out, at

    def _one(self, data: bytes, at: int) -> tuple[bytes, int, bool]:
        """What stands at a place after normalisation, how many bytes it took, and whether they are unchanged."""
        for text in self.user:
            if data.startswith(text, at):
                return text, len(text), True
        if found := self.map.longest(data, at):
            return *found, False
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n, True

    def _by_rules(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, where = bytearray(), []
        mark = SPACE if self.escape else b" "
        at, after_space = 0, self.squeeze

        if self.squeeze:
            while at < len(data):
                text, n, _ = self._one(data, at)
                if text != b" ":
                    break
                at += n
        if at >= len(data):
            return b"", np.zeros(1, dtype=np.int64)
        if self.prefix and not self.suffix:
            out += mark
            where += [at] * len(mark)
        while at < len(data):
            text, n, same = self._one(data, at)
            skip = len(text) - len(text.lstrip(b" ")) if after_space else 0
            for i, byte in enumerate(text[skip:], skip):
                unit = mark if byte == 32 else bytes([byte])
                out += unit
                where += [at + i if same else at] * len(unit)
            if text[skip:]:
                after_space = text.endswith(b" ")
            after_space = after_space and self.squeeze
            at += n
        if self.squeeze:
            while out.endswith(mark):
                at = where[-len(mark)]
                del out[-len(mark) :], where[-len(mark) :]
        if self.prefix and self.suffix:
            out += mark
            where += [at] * len(mark)
        return bytes(out), np.array([*where, at], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """Ids, first bytes and end bytes of the pieces of each text; no places where the pieces don't cover the normalised bytes."""
        made = []
        for text, ids in zip(texts, self.library.encode(texts, num_threads=1), strict=True):
            ids = np.array(ids, dtype=np.int32)
            data = text.encode()
            normal, at = self.normalise(data)
            width = self.lengths[ids]
            if self.unknown is not None and (ids == self.unknown).any():
                width = np.array([len(x.encode()) for x in self.library.encode(text, out_type=str)], dtype=np.int64)
            ends = np.cumsum(width)
            if (ends[-1] if len(ids) else 0) == len(normal):
                made.append((ids, at[ends - width].astype(np.int32), at[ends].astype(np.int32)))
            else:
                made.append((ids, None, None))
        return made

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(x) for x in ids]


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def _lists(parts: list[np.ndarray | None]) -> pa.ListArray:
    there = [np.zeros(0, dtype=np.int32) if x is None else x for x in parts]
    offsets = np.cumsum([0, *map(len, there)]).astype(np.int32)
    gone = pa.array([x is None for x in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(there) if there else [], type=pa.int32()), mask=gone)


def encode(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """Encodes every whole text: the columns keep, then ids, begins and ends (bytes of the original text) and decoded.

    One row for each row of df, repeated rows and rows with a null in keep included. A null text counts as empty and has no
    pieces. A text without special bytes of any kind and of any length is encoded as a whole. Columns that aren't in keep are
    left out, so none can clash. begins and ends are null if the pieces don't cover the normalised text. decoded is null with decode=False. Each row is worked on by itself: no shuffle.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in parts:
            texts = [x or "" for x in batch.column(len(keep)).to_pylist()]
            for start, end in slices(texts):
                made = model.encode(texts[start:end])
                decoded = model.decode([x[0].tolist() for x in made]) if decode else [None] * (end - start)
                columns = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, *(_lists([x[k] for x in made]) for k in range(3)), pa.array(decoded, pa.string())], names=names)

    picked = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    names = [*keep, "ids", "begins", "ends", "decoded"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(batches, f"{kept}, ids array<int>, begins array<int>, ends array<int>, decoded string")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decodes lists of ids with the library: the columns keep, then text. A null or empty list gives an empty text."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in parts:
            texts = model.decode([[i for i in x or () if i is not None] for x in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    picked = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(batches, f"{kept}, text string")


def digests(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token counts and SHA-256 digests of what encode() returns."""
    return encoded.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("covered_bytes"),
    )
