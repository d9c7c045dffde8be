"""Personal data, archives and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import test_copies
import test_texts
from spectraloom import tables
from spectraloom.llm import personal, queries, simhash, warc
from spectraloom.tables import fresh_path, materialise

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GRAMMARS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, (name, grammar) in enumerate(GRAMMARS.items()):
        for m in grammar.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end(), name))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def found(df, **kw):
    return personal.find_personal_data(df, **kw).select("doc_id", personal.written(F.col("seeds")).alias("seeds"), personal.written(F.col("spans")).alias("spans")).collect()


def test_strict_grammars_against_plain_scans(spark, sf_dir):
    rnd, rows = random.Random(5), []
    for i in range(1500):
        alphabet = rnd.choice(["a1.@+-_ %b", "0123456789 -+().", "12.+@ab-.", "0-9 5 4+()", "25.6 "])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        rows.append((i, text if i % 5 else f"call 4111 1111 1111 1111 or +1 (988) 555-2485 é😀 {text} x@y.z 1.2.3.4", "en", "s", 0))
    rows += [(9000, "a@b." + "c." * 20_000, "en", "s", 0), (9001, "1 " * 50_000, "en", "s", 0), (9002, "a" * 100_000 + "@" + "1." * 30_000, "en", "s", 0), (9003, "+1" + " 1" * 50_000, None, None, None)]
    rows += [(None, None, "en", "s", 0), (9004, "", "en", "s", 0), (5, rows[5][1], "en", "s", 0)]
    rows += [(20_000 + r.doc_id, r.text, "en", "s", 0) for r in queries.table(spark, sf_dir, "documents").collect()]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"seeds": F.lit(1), "h": F.lit(1), "start": F.lit(1)})
    got = found(docs)
    assert len(got) == len(rows)
    want = {r[0]: plain_spans(r[1] or "") for r in rows}
    assert all(r.seeds == want[r.doc_id] for r in got)
    assert all(set(r.seeds.split(",")) <= set(r.spans.split(",")) or not r.seeds for r in got)
    assert sum(bool(r.seeds) for r in got) > 100
    assert found(docs.limit(0)) == []


def test_trusted_patterns_discover_other_forms(spark):
    rows = [(i, f"so please dial +1 (234) 555-{1000 + i} now", "en", "s", 0) for i in range(12)]
    rows += [(100, "so please dial (234) 555 7777 today", "en", "s", 0), (101, "version 1234567 of the file", "en", "s", 0), (102, "please dial no number", "en", "s", 0)]
    rows += [(200 + i, f"write to user{i}@mail.example.com soon", "en", "s", 0) for i in range(12)] + [(300, "write to someone [at] host [dot] org soon", "en", "s", 0)]
    got = {r.doc_id: r for r in found(spark.createDataFrame(rows, DOCS))}
    assert got[100].spans == "phone:15:29" and got[100].seeds == ""
    assert got[300].spans.startswith("email:9:") and got[101].spans == got[102].spans == ""


def test_mixed_patterns_are_not_trusted(spark):
    kinds = ["+1 (234) 555-{:04d}", "10.0.0.{}", "a{}@b.example.com", "4111 1111 1111 {:04d}"]
    rows = [(i, f"the {kinds[i % 3].format(i)} end", "en", "s", 0) for i in range(60)] + [(99, "the 555 123 4567 end", "en", "s", 0)]
    assert {r.doc_id: r.spans for r in found(spark.createDataFrame(rows, DOCS))}[99] == ""


def spans_with_context(pattern, text):
    """(start, end, value, context) of all matches; the context is the last two words between the match before and this one."""
    out, at = [], 0
    for m in re.finditer(pattern, text):
        left = re.search(r"(?:\S+\s+)?\S+\s*$", text[at : m.start()][-80:], re.ASCII)
        out.append((m.start(), m.end(), m[0], left[0].lower() if left else ""))
        at = m.end()
    return out


def patterns_of(left):
    words = left.split()
    return {("1", words[-1]), ("2", " ".join(words))} if words else set()


def plain_discovery(rows, least_seeds=3, least_share=0.6, rounds=3):
    """{(id, text): spans} by scoring the graph of patterns and instances with dictionaries."""
    texts, edges = {}, {}
    for key in {(i, t or "") for i, t in rows}:
        strict = {tuple(x.split(":")) for x in plain_spans(key[1]).split(",") if x}
        seeds = []
        for kind, (name, grammar) in enumerate(GRAMMARS.items()):
            seeds += [(a, kind, b, v, left) for a, b, v, left in spans_with_context(grammar, key[1]) if (name, str(a), str(b)) in strict]
        loose = [(a, b, numeric, v, left) for numeric, p in ((False, personal.LOOSE_EMAIL), (True, personal.LOOSE_NUMBER)) for a, b, v, left in spans_with_context(p, key[1])]
        loose = [x for x in loose if not any(s[0] < x[1] and x[0] < s[2] for s in seeds)]
        texts[key] = seeds, loose
        for numeric, v, left, kind in [(k > 0, v, left, k) for _, k, _, v, left in seeds] + [(n, v, left, 9) for _, _, n, v, left in loose]:
            for p in patterns_of(left):
                edges[p, numeric, v] = min(kind, edges.get((p, numeric, v), 9))
    known = {}
    for (_, numeric, v), kind in edges.items():
        if kind < 9:
            known[v, numeric] = min(kind, known.get((v, numeric), 9))
    trusted = {}
    for _ in range(rounds):
        counts = {}
        for p, numeric, v in edges:
            total = counts.setdefault((p, numeric), [0.0, [0] * 4])
            total[0] += 1.0 if (v, numeric) in known else 0.5
            if (v, numeric) in known:
                total[1][known[v, numeric]] += 1
        trusted = {k: (n.index(max(n)), max(n) / total) for k, (total, n) in counts.items() if max(n) >= least_seeds and max(n) >= least_share * total}
        doubt = {}
        for p, numeric, v in edges:
            if (v, numeric) not in known and (p, numeric) in trusted:
                kind, share = trusted[p, numeric]
                doubt.setdefault((v, numeric), {}).setdefault(kind, []).append(share)
        new = {}
        for key, by_kind in doubt.items():
            belief = {k: 1 - math.prod(max(1 - x, 1e-9) for x in shares) for k, shares in by_kind.items()}
            good = [(b, -k) for k, b in belief.items() if b >= least_share]
            if good:
                new[key] = -max(good)[1]
        if not trusted or not new:
            break
        known |= new
    out = {}
    for key, (seeds, loose) in texts.items():
        spans = [(a, k, b) for a, k, b, *_ in seeds]
        for a, b, numeric, _, left in loose:
            votes = [(trusted[p, numeric][1], -trusted[p, numeric][0]) for p in patterns_of(left) if (p, numeric) in trusted]
            if votes:
                spans.append((a, -max(votes)[1], b))
        out[key] = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_discovery_against_a_plain_graph(spark, seed):
    rnd = random.Random(seed)
    forms = ["+1 (234) 555-{:04d}", "10.0.{}.7", "a{}@b.example.com", "555 {:04d} 123", "a{} [at] host [dot] org", "4111-1111-1111-11{:02d}", "a{}@intranet", "ref 12345{:04d}"]
    leads = ["call", "please dial", "mail to", "write to", "host", "server at", "the", "pay with card", "fax:", "Tel", "id"]
    rows = []
    for i in range(150):
        parts = [f"{rnd.choice(leads)} {rnd.choice(forms[k::4] if k < 4 else forms).format(rnd.randint(0, 40))}" for k in (rnd.randint(0, 6) for _ in range(rnd.randint(0, 6)))]
        rows.append((i, rnd.choice([" ", " and ", "\n", ", "]).join(parts)))
    rows += [(None, rows[3][1]), (5, rows[5][1]), (900, None), (901, "")]
    want = plain_discovery(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = found(docs)
    assert len(got) == len(rows) and sum(r.spans != r.seeds for r in got) > 10
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    assert all(r.spans == want[r.doc_id, texts[r.doc_id]] for r in got)


def test_time_follows_the_matches_of_a_text(spark):
    def seconds(n):
        text = " ".join(f"mail user{i}@host{i % 97}.example.com or 555 {1000 + i} {i:04d}" for i in range(n))
        began = time.time()
        row = personal.find_personal_data(spark.createDataFrame([(1, text, "en", "s", 0)], DOCS)).select(F.size("seeds").alias("n"), F.get("seeds", F.lit(n - 1)).alias("x")).first()
        start = text.index(f"user{n - 1}@")
        assert row.n >= n and (row.x.start == start or row.n > n)
        return time.time() - began

    seconds(1000)
    # eight times the matches: 64 times the time if it grew with the square
    assert seconds(160_000) <= 24 * max(1.0, seconds(20_000))


def test_running_sums(spark):
    for n in (0, 1, personal.STEP - 1, personal.STEP, personal.STEP + 1, 3 * personal.STEP**2 + 5):
        values = F.slice(F.sequence(F.lit(3), F.lit(n + 3)), F.lit(1), F.lit(n))
        got = spark.range(1).select(personal._running(values, F.lit(0).cast("bigint")).alias("x")).first().x
        assert got == [0, *itertools.accumulate(range(3, n + 2))][:n]


PAGES = "page_id bigint, url string, html string"


def test_archives_round_trip(spark):
    rnd = random.Random(2)
    rows = [(i, f"http://x/{i}", "".join(rnd.choice("abc <>é") for _ in range(rnd.choice([0, 3, 500, 20_000])))) for i in range(80)]
    rows += [(100, "http://a\r\nb", "same"), (90, None, "same"), (91, "u", None), (92, "u", ""), (93, "u", "\x1f\x8b\x08 magic " * 500), (94, "u", "x" * 3_000_000), (95, "u", "same")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"id": F.lit(1), "digest": F.lit(1), "length": F.lit(1)}).repartition(3)
    archives = warc.write_archives(df, fresh_path(spark, "warc"))
    first = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", i)
    for split in (700, 8 << 20):
        got = {r.page_id: r for r in warc.page_ids(warc.read_archives(archives, split)).collect()}
        assert len(got) == len(rows)
        for i, _, html in rows:
            data = (html or "").encode()
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            kind = "response" if first[html or ""] == i else "revisit"
            assert tuple(got[i]) == (i, len(data), digest, kind, None if kind == "response" else first[html or ""])
    full = {r.record_id: r for r in warc.read_archives(archives, 5000).collect()}
    assert bytes(full["<urn:page:94>"].payload) == b"x" * 3_000_000 and full["<urn:page:100>"].payload is None
    assert full["<urn:page:100>"].target_uri == "http://a%0D%0Ab" and full["<urn:page:90>"].target_uri is None
    path = archives.first().path
    with gzip.open(urlparse(path).path) as file:
        assert file.read(8) == b"WARC/1.1"
    listed = warc.list_archives(spark, [path])
    assert listed.first().bytes == archives.where(F.col("path") == path).first().bytes


def test_archives_edge_cases(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (None, "u", "b"), (None, "u", "a"), (5, "u", "tiny"), (6, "u", "tiny")]
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES), fresh_path(spark, "warc"), least_bytes=2)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows) and sum(r.record_type == "revisit" for r in got) == 1
    none = warc.write_archives(spark.createDataFrame([], PAGES), fresh_path(spark, "warc"))
    assert warc.read_archives(none).count() == 0


def test_each_range_has_a_task_of_its_own(spark):
    ranges = spark.range(130).select(F.concat(F.lit("file:///a/part-"), (F.col("id") % 7).cast("string")).alias("path"), (F.col("id") * 1000).alias("start"))
    sizes = [r.n for r in warc.deal(ranges).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sizes == [1] * 130


def test_a_task_that_runs_again_replaces_its_archive(spark, tmp_path):
    store, root = warc._opened(f"file://{tmp_path}")
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], PAGES).coalesce(1)
    first = warc.write_archives(df, f"file://{tmp_path}/w").collect()
    again = warc.write_archives(df, f"file://{tmp_path}/w")
    assert [r.path for r in first] == [r.path for r in again.collect()] and warc.read_archives(again).count() == 20

    class NoOverwrite:
        """A store that doesn't rename onto a file."""

        def move(self, a, b):
            if store.get_file_info(b).is_file:
                raise OSError("file exists")
            store.move(a, b)

        delete_file = store.delete_file

    for name, text in (("new", b"new"), ("old", b"old")):
        (tmp_path / name).write_bytes(text)
    warc._put(NoOverwrite(), f"{root}/new", f"{root}/old")
    assert (tmp_path / "old").read_bytes() == b"new" and not (tmp_path / "new").exists()


def test_broken_members_are_passed_over(tmp_path):
    record = warc._record("response", 1, "u", b"payload", 7, "D", None, "2000-01-01T00:00:00Z", 6)
    other = warc._record("response", 2, "u", b"more", 4, "D", None, "2000-01-01T00:00:00Z", 6)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"junk\x1f\x8b\x08junk" + record[: len(record) // 2] + b"\x1f\x8b" + record + gzip.compress(b"not a record") + other + record[:40])
    found = list(warc.read_range(f"file://{path}", 0, path.stat().st_size))
    assert [r[3] for r in found] == ["<urn:page:1>", "<urn:page:2>"] and found[1][8] == b"more"
    halves = [list(warc.read_range(f"file://{path}", a, b)) for a, b in ((0, 60), (60, 10**6))]
    assert sum(halves, []) == found


def plain_groups(texts, size=5, least=0.8):
    """For each text the first one that it reaches over pairs of similar sets of shingles: all with all that share a shingle."""
    sets, owners, near = [set(simhash.shingles(t or "", size)) for t in texts], {}, []
    for i, own in enumerate(sets):
        for x in own:
            owners.setdefault(x, []).append(i)
    empty = [i for i, own in enumerate(sets) if not own]
    near += list(itertools.pairwise(empty))
    for i, own in enumerate(sets):
        common = Counter(j for x in own for j in owners[x] if j > i)
        near += [(i, j) for j, n in common.items() if n >= least * (len(own) + len(sets[j]) - n)]
    return test_copies.components(len(texts), near)


def test_pipeline_stages_against_plain_versions(spark, sf_dir):
    import sentencepiece

    docs = queries.table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        kept[name] = (before.collect(), docs.collect())
        if name != "sentencepiece":
            assert docs.columns == columns and len({r.doc_id for r in kept[name][1]}) == len(kept[name][1])
    before, after = kept["quality"]
    scores = test_texts.plain_scores(before, queries.table(spark, sf_dir, "labels").orderBy(F.xxhash64("doc_id")).collect())
    assert all(abs(x - queries.QUALITY_BOUND) > 1e-5 for x in scores.values())
    assert {r for r in after} == {r for r in before if scores[r.doc_id] >= queries.QUALITY_BOUND}
    before, after = kept["line_dedup"]
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id bigint, text string").select("doc_id", F.xxhash64("text").alias("h")).collect()}
    want = test_copies.plain_line_dedup([(r.doc_id, hashes[r.doc_id], r.text) for r in before])
    assert {(r.doc_id, r.text) for r in after} == {(r.doc_id, None if r.text is None else want[r.doc_id, hashes[r.doc_id]]) for r in before}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    before, after = kept["simhash"]
    before.sort(key=lambda r: r.doc_id)
    groups = plain_groups([r.text for r in before])
    assert {r for r in after} == {before[g] for g in set(groups)} and len(after) < len(before)
    before, after = kept["decontamination"]
    known = test_copies.plain_families([(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()])
    assert {r for r in after} == {r for r in before if test_copies.plain_leaks(known, r.text)[0] is None} and len(after) < len(before)
    before, after = kept["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in before}
    assert len(after) == len(before)
    for r in after:
        ids = library.encode(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        data = texts[r.doc_id].encode()
        assert b"".join(data[a:b] for a, b in zip(r.begins, r.ends)) == data
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(after)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words here", "en", "a", 1), (3, "some words here", "en", "a", 1), (None, "no id at all", "en", "a", 1), (4, "w " * 100_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = stage(spark, docs, sf_dir).collect()
    assert len(got) <= len(rows)
    if name not in ("quality", "simhash"):
        assert len(got) == len(rows)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


CLASHES = "quality_score row item_id contaminated covered n_lines n_dropped h id own no_id whole order component __id __text __h __own __row n kept ids family".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_leave_other_columns_alone(spark, sf_dir, name):
    stage, plain = dict(corpus_pipeline.STAGES)[name], queries.table(spark, sf_dir, "documents")
    extra = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES}).withColumns({"a.b c": F.create_map(F.lit("k"), F.col("doc_id")), "n_tokens": F.lit("mine")})
    got, want = stage(spark, extra, sf_dir), stage(spark, plain, sf_dir)
    if name == "sentencepiece":
        assert sorted(got.collect()) == sorted(want.collect())
        return
    rows = got.collect()
    assert got.columns == extra.columns and rows
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES) and all(r["a.b c"] == {"k": r.doc_id} and r.n_tokens == "mine" for r in rows)
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in rows) == sorted((r.doc_id, r.text or "", r.n_chars) for r in want.collect())


def test_the_pipeline_leaves_its_result_only(spark, sf_dir):
    before = len(tables._written)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and len(tables._written) == before + 1
