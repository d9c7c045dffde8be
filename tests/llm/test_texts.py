"""Encoding, language, quality and token counts."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import langid, quality, queries, sentencepieces, shared, tokencounts
from spectraloom.tables import fresh_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MODEL = queries.tokenizer_file("piece_bpe_32k.model")
WORDS = queries.tokenizer_file("word_bpe_49k.json")
AWKWARD = [
    (1, "Hello  world\t\n é漢字 😀", "en", "a", 1), (2, None, "en", None, None), (3, "", None, "a", 0), (None, "no id", "en", "a", 1),
    (5, "same", "en", "a", 1), (5, "same", "en", "a", 1), (6, "word " * 60_000, "en", "a", 1), (7, "123 !!", "de", "a", 1), (8, "<s></s><unk> <|endoftext|>", "en", "a", 1), (9, "﻿​ é  x", "en", "a", 1),
]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS).withColumns({"ids": F.lit(1), "score": F.lit("x"), "n_tokens": F.lit(0), "digest": F.lit(0), "h": F.lit(0), "at": F.lit(0)})


def test_pieces_equal_the_library(spark, awkward):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = sentencepieces.encode(awkward, MODEL, keep=("doc_id", "text")).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        text = r.text or ""
        assert list(r.ids) == library.encode(text) and r.decoded == library.decode(library.encode(text))
        data = text.encode()
        assert all(a <= b for a, b in zip(r.begins, r.ends)) and list(r.begins[1:]) == list(r.ends[:-1])
        assert b"".join(data[a:b] for a, b in zip(r.begins, r.ends)) == data


def test_digests_and_decode(spark, awkward):
    encoded = sentencepieces.encode(awkward, MODEL)
    got = {r.doc_id: r for r in sentencepieces.digests(encoded).collect()}
    assert got[3].n_tokens == 0 and got[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    back = {r.doc_id: r.text for r in sentencepieces.decode(encoded, MODEL).collect()}
    assert back[8] == AWKWARD[8][1] and back[2] == ""
    assert sentencepieces.encode(awkward.limit(0), MODEL).count() == 0


def test_longest_prefix_rules_and_squeezing():
    class Plain(sentencepieces.Model):
        def __init__(self, **kw):
            self.prefix = self.squeeze = self.escape = True
            self.suffix, self.user, self.plain = False, [], False
            self.map = sentencepieces.CharacterMap(b"")
            self.__dict__.update(kw)

    class Rules:
        def longest(self, data, at):
            for key, value in ((b"ab", b"X"), (b"a", b"yy"), (b"\t", b" ")):
                if data.startswith(key, at):
                    return value, len(key)
            return None

    out, at = Plain(map=Rules()).normalise(b"  ab\t a ")
    assert out.decode() == "▁X▁yy"
    assert len(at) == len(out) + 1 and at[3] == 2 and at[-1] == 7
    assert Plain(squeeze=False, map=Rules()).normalise(b"a b")[0].decode() == "▁yy▁b"
    assert Plain().normalise(b"   ")[0] == b""


def message(fields):
    """A protocol buffer message of length-delimited fields."""

    def varint(n):
        out = b""
        while n > 0x7F:
            out += bytes([n & 0x7F | 0x80])
            n >>= 7
        return out + bytes([n])

    return b"".join(varint(number << 3 | 2) + varint(len(value)) + value for number, value in fields)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_maps_against_the_library(spark, tmp_path, rule):
    import sentencepiece

    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    rules = dict(sentencepieces._fields(normaliser.serialized_model_proto()))[3]
    with open(MODEL, "rb") as file:
        parts = [(k, v) for k, v in sentencepieces._fields(file.read()) if isinstance(v, bytes) and k != 3]
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as file:
        file.write(message([*parts, (3, rules)]))
    model, library = sentencepieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert bool(model.map.units) == (rule != "identity") and not model.plain
    rnd = random.Random(rule)
    alphabet = ["ａ", "Ｂ", "ﬁ", "㍿", "①", "½", "é", "e\u0301", "\u0301", " ", "  ", "\u3000", "\t", "\n", "\u200b", "\ufeff", "한", "ㄱ", "ｶﾞ", "ß", "İ", "Σ", "x", "Yz", "😀", "\u00a0", "ﷺ", "№", "～", "\x00", "\x7f"]
    texts = ["", " ", "plain text", *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(300))]
    for text in texts:
        normal, at = model.normalise(text.encode())
        want, offsets = library.normalize(text, with_offsets=True)
        assert normal.decode() == want
        ids, begins, ends = model.encode([text])[0]
        assert ids.tolist() == library.encode(text)
        assert begins is not None and all(begins <= ends) and begins[1:].tolist() == ends[:-1].tolist()
        # the library's offsets are those of characters; they agree wherever a normalised character begins
        chars = np.cumsum([0, *(len(c.encode()) for c in want)])
        places = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert [int(at[i]) for i in chars] == [int(places[k]) for k in offsets]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    rows = sentencepieces.encode(docs, path, keep=("text",)).collect()
    assert len(rows) == len(texts) and all(list(r.ids) == library.encode(r.text) for r in rows)


def test_texts_whose_pieces_do_not_cover_them_have_no_places(spark, awkward, monkeypatch):
    monkeypatch.setattr(sentencepieces.Model, "normalise", lambda self, data: (data + b"x", np.zeros(len(data) + 2, dtype=np.int64)))
    model = sentencepieces.Model(MODEL)
    ids, begins, ends = model.encode(["one text"])[0]
    assert len(ids) and begins is None and ends is None
    lists = sentencepieces._lists([begins, np.array([1, 2], dtype=np.int32), None, np.zeros(0, dtype=np.int32)])
    assert lists.to_pylist() == [None, [1, 2], None, []]


def test_double_array_trie():
    import struct

    # one rule, "a" to "b": root's offset 1, so that "a" leads to unit 1 ^ 97 = 96, whose leaf is at offset 2 from there
    units = [0] * 256
    units[0] = 1 << 10
    units[96] = (2 << 10) | 0x100 | 97
    units[96 ^ 2] = 0x80000000 | 0
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"b\0"
    found = sentencepieces.CharacterMap(blob)
    assert found.longest(b"xa", 1) == (b"b", 1) and found.longest(b"xa", 0) is None


def test_language_learns_and_ignores_the_fold(spark, sf_dir):
    got = queries.op2_language_id(spark, sf_dir).join(queries.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, awkward):
    model = langid.fit(awkward.where("doc_id <> 7"), F.col("doc_id"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(awkward, model).collect()}
    assert got[2] == got[3] == got[7] == ("und", 0.0) and got[1][0] == "en"
    nothing = langid.fit(awkward.limit(0), F.col("doc_id"))
    assert {r.lang_pred for r in langid.predict(awkward, nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.fit(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang")), F.col("doc_id"), most_languages=3)


def plain_buckets(text, bits):
    """The bucket of each n-gram, one after another."""
    points = [ord(c) if c.isalpha() else 32 for c in f"  {text.lower()} "] + [32, 32]
    out = []
    for n in langid.LENGTHS:
        for k in range(len(text.lower()) + 3):
            gram = points[k : k + n]
            if any(p != 32 for p in gram):
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for p in gram:
                    h = (h ^ p) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 15
                out.append((h * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - bits)
    return out


def test_language_against_plain_counts(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in queries.table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: r for r in queries.op2_language_id(spark, sf_dir).collect()}
    counts, rows = {}, {}
    for i, text, lang in docs:
        if zlib.crc32(str(i).encode()) % 3 != 1 and text is not None and lang is not None:
            rows[lang] = rows.get(lang, 0) + 1
            counts.setdefault(lang, np.zeros(1 << 15))
            np.add.at(counts[lang], plain_buckets(text, 15), 1)
    for i, text, _ in docs:
        buckets = plain_buckets(text or "", 15)
        logs = {k: math.log(rows[k] / sum(rows.values())) + sum(math.log((c[b] + 0.1) / (c.sum() + 0.1 * (1 << 15))) for b in buckets) for k, c in counts.items()}
        best = max(logs.values())
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        assert logs[got[i].lang_pred] >= best - 1e-3
        # the matrix holds single precision, so a sum over n grams is good to about n * 1e-6
        assert got[i].score == pytest.approx(1 / sum(math.exp(x - best) for x in logs.values()), abs=1e-6 * max(10, len(buckets)))


def test_ngrams_stay_inside_texts():
    one, n, letters = langid.ngrams(["abc", "", "12", "xyz"], 15)
    parts = [langid.ngrams([t], 15)[0] for t in ("abc", "", "12", "xyz")]
    assert n.tolist() == [len(p) for p in parts] and one.tolist() == np.concatenate(parts).tolist()
    assert letters.tolist() == [True, False, False, True]


def test_quality_separates_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op3_quality(spark, sf_dir).join(queries.table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_quality_edge_cases(spark, awkward):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (3, None, 1), (None, 1, 0), (6, 1, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(awkward, labels)
    got = quality.score(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.quality_score <= 1 for r in got)
    blank = quality.fit(awkward, labels.limit(0))
    assert {r.quality_score for r in quality.score(awkward, blank).collect()} == {0.5}


def plain_model(examples, bits, epochs=4, alpha=0.3, beta=1.0, l1=1e-4, l2=1e-3):
    """FTRL-proximal, coordinate by coordinate: examples are (label, weight, {place: value}); gives a function from features to a score."""
    z, n = {}, {}

    def weight(i):
        lam = 0 if i == 1 << bits else l1
        held = z.get(i, 0.0)
        return 0.0 if abs(held) <= lam else -(held - math.copysign(lam, held)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for label, importance, row in examples:
            w = {i: weight(i) for i in row}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in row.items())))
            for i, x in row.items():
                g = importance * (p - label) * x
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return lambda row: 1 / (1 + math.exp(-sum(weight(i) * x for i, x in row.items())))


def plain_scores(docs, labels):
    """{doc_id: score} of documents, learnt from labels in the order given; no label is thinned in tables as small as this, so all rows weigh the same."""

    def row(text):
        families, counts = quality.features([text or ""], 16)
        out = {1 << 16: 1.0}
        for scale, buckets in zip(quality.SCALES, families):
            for b in buckets.tolist():
                out[b] = out.get(b, 0.0) + scale / max(1, counts[0])
        return out

    rows = {r.doc_id: row(r.text) for r in docs}
    learnt = [(r.quality, 1.0, rows[r.doc_id]) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 != 0 and r.quality is not None and r.doc_id in rows]
    score = plain_model(learnt, 16)
    return {i: score(x) for i, x in rows.items()}


def test_quality_against_plain_updates(spark, sf_dir):
    want = plain_scores(queries.table(spark, sf_dir, "documents").collect(), queries.table(spark, sf_dir, "labels").orderBy(F.xxhash64("doc_id")).collect())
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf_dir).collect()}
    assert len(got) == len(want)
    for i, score in want.items():
        assert got[i].score == pytest.approx(score, abs=2e-6) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_bounds_what_it_learns_from(spark, awkward):
    labels = spark.createDataFrame([(1, 1, None), (6, 0, 0), (7, 0, 0), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    whole, some, none = (quality.fit(awkward, labels, most_pairs=n) for n in (1 << 24, 20, 1))
    assert np.count_nonzero(some.weights) < np.count_nonzero(whole.weights) and not np.count_nonzero(none.weights)


def test_predictions_on_an_empty_table(spark, awkward):
    labels = spark.createDataFrame([(1, 1, None), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.score(awkward.limit(0), quality.fit(awkward, labels)).count() == 0
    assert langid.predict(awkward.limit(0), langid.fit(awkward, F.col("doc_id"))).count() == 0
    assert sentencepieces.decode(sentencepieces.encode(awkward.limit(0), MODEL), MODEL).count() == 0


def test_quality_features_stay_inside_texts():
    texts = ["One TWO!! two", "", "three three"]
    together, counts = quality.features(texts, 16)
    assert counts.tolist() == [3, 0, 2]
    for k, family in enumerate(together):
        assert family.tolist() == np.concatenate([quality.features([t], 16)[0][k] for t in texts]).tolist()


def test_token_counts_and_cache(spark, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    path = fresh_path(spark, "cache")
    rows = tokencounts.count_tokens(awkward, WORDS, path).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == sorted((i or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t, *_ in AWKWARD)
    before = spark.read.parquet(path).count()
    assert before == 8  # repeated, null and empty texts share their entries
    more = awkward.unionByName(spark.createDataFrame([(10, "new text", "en", "a", 1)], DOCS), allowMissingColumns=True)
    assert tokencounts.count_tokens(more, WORDS, path).count() == len(AWKWARD) + 1
    assert spark.read.parquet(path).count() == before + 1
    assert tokencounts.count_tokens(awkward.limit(0), WORDS, fresh_path(spark, "cache")).count() == 0


def test_token_counts_with_pieces(spark, awkward):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = tokencounts.count_tokens(awkward, MODEL, fresh_path(spark, "cache")).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(library.encode(x[1] or "")) for x in AWKWARD)


def test_span_hashes_depend_on_the_span_alone():
    data = np.frombuffer(b"abc xabc abcd", dtype=np.uint8)
    h = shared.SpanHasher(shared.MIXED[data])(np.array([0, 5, 9, 9]), np.array([3, 8, 12, 13]))
    assert h[0] == h[1] == h[2] != h[3]
    assert list(shared.slices(["a" * 10, None, "b" * 30, ""], 20)) == [(0, 2), (2, 3), (3, 4)]
