"""Lines, fingerprints, embeddings and benchmark leaks against plain versions."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spectraloom.llm import decontaminate, lattice, linededup, queries, simhash
from spectraloom.operators.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def word_distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_line_dedup(rows):
    """[(id, hash, text)] to the texts that stay, by comparing all lines."""
    order = sorted({r for r in rows if r[2] is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    seen, out = [], {}
    for i, h, text in order:
        kept = []
        for line in text.split("\n"):
            words = re.split("[ \t\r\x0b\x0c]+", line.strip(" \t\r\x0b\x0c"))
            if words == [""]:
                kept.append(line)
                continue
            if not any(words == x or min(len(words), len(x)) >= linededup.LEAST_WORDS and word_distance_at_most_one(words, x) for x in seen):
                kept.append(line)
            seen.append(words)
        out[i, h] = "\n".join(kept)
    return out


def test_lines_against_all_pairs(spark):
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n)] for n in (*range(1, 13), *range(7, 12))]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rnd.randint(0, 4)):
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 2)):
                k = rnd.randrange(len(w))
                rnd.choice([lambda: w.insert(k, "new"), lambda: len(w) > 1 and w.pop(k), lambda: w.__setitem__(k, "other")])()
            lines.append(rnd.choice(["", "", " ", "\u3000 "]) + rnd.choice([" ", "\t", "  "]).join(w))
        rows.append((i, "\n".join(lines), "en", "s", 1))
    rows += [(None, " ".join(base[0]), None, None, None), (500, None, "en", "s", 1), (501, "", "en", "s", 1), (7, "\n".join([" ".join(base[1])] * 2), "en", "s", 1), rows[5], (502, " ".join(f"w{i}" for i in range(20_000)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n_lines": F.lit("x"), "key": F.lit(1), "hash": F.lit(1), "kept": F.lit(2)})
    got = linededup.drop_near_copies(docs).withColumn("h", F.lit(0)).collect()
    assert len(got) == len(rows)
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    want = plain_line_dedup([(i, hashes[i, t], t) for i, t, *_ in rows])
    expected = [(i, t if t is None else want[i, hashes[i, t]]) for i, t, *_ in rows]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.text)) for r in got)
    assert sum(r.n_dropped for r in got) > 20
    assert linededup.drop_near_copies(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").collect()
    got = {r.doc_id: r for r in queries.op9_simhash(spark, sf_dir).collect()}
    prints = np.array([plain_fingerprint(d.text) for d in docs], dtype=np.uint64)
    assert all(got[d.doc_id].fingerprint == f"{int(p):016x}" for d, p in zip(docs, prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    ids = [d.doc_id for d in docs]
    groups = components(len(ids), np.argwhere(np.triu(near, 1)))
    least = {g: min(ids[i] for i in range(len(ids)) if groups[i] == g) for g in set(groups)}
    assert all(got[i].component_id == least[g] for i, g in zip(ids, groups))


@pytest.mark.parametrize("block", [16, 1024])
def test_anchors_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(1)
    centres = [rnd.getrandbits(64) for _ in range(3)] + [0, 2**64 - 1]
    prints = set(centres)
    while len(prints) < 260:
        p = rnd.choice(sorted(prints))
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            p ^= 1 << b
        prints.add(p)
    prints = np.array(sorted(prints), dtype=np.uint64)
    nodes = spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints.view(np.int64))], "id bigint, fp bigint").withColumn("view", F.lit(0))
    found = {r.node: r.component for r in connected_components(simhash.link_fingerprints(nodes)).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    want = components(len(prints), np.argwhere(np.triu(near, 1)))
    assert [found.get(i, i) for i in range(len(prints))] == want


def test_fingerprint_edge_cases(spark):
    rows = [(3, None, "a", "b", 1), (2, "", "a", "b", 1), (4, " \t", "a", "b", 1), (None, "x y z w", "a", "b", 1), (9, "x y z w", "a", "b", 1), (9, "x y z w", "a", "b", 1), (10, "q " * 200_000, "a", "b", 1), (None, "alone here now", "a", "b", 1), (11, "one", "a", "b", 1), (11, "two", "a", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit("x"), "id": F.lit(5), "component_id": F.lit(1), "block": F.lit(1)})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2} and {r.fp for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["9", "None"]
    assert {r.component_id for r in got if r.doc_id == 11} == {11}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_similar_groups_against_all_pairs(spark):
    rnd = random.Random(4)
    texts = []
    for _ in range(12):
        base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) + str(rnd.randint(0, 30)) for _ in range(rnd.choice([3, 60, 200]))]
        for changes in (0, 0, 1, 1, 2, 30):
            w = list(base)
            for _ in range(changes):
                w[rnd.randrange(len(w))] = "new" + str(rnd.randint(0, 10**6))
            texts.append(" ".join(w))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s", 1), (None, texts[0], "en", "s", 1), (3, texts[3], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"fps": F.lit(1), "node": F.lit(1)})
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = components(len(texts), near)
    together = [(got[i] == got[j]) for i, j in near]
    assert len(near) > 40 and all(together)
    assert all(want[i] == want[j] for i, j in itertools.combinations(range(len(texts)), 2) if got[i] == got[j])
    assert got[500] == got[501] == 500 and None not in got and len(got) == len(texts) + 2
    assert simhash.similar_groups(docs.limit(0)).count() == 0


def test_components_of_stars_paths_and_cycles(spark):
    edges = [(100, i) for i in range(40)] + [(i, i + 1) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (7, 7), (None, 3), (301, 302)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in [100, *range(40)]) and all(got[i] == 200 for i in range(200, 261)) and got[302] == 300
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_lattice_decodes_to_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    near = lattice.decode(x)
    assert lattice.neighbours().shape == (240, 8) and np.allclose((lattice.neighbours() ** 2).sum(axis=1), 2)
    for p, q in zip(x, near):
        assert all(((p - q) ** 2).sum() <= ((p - q - v) ** 2).sum() + 1e-9 for v in lattice.neighbours())


def test_signs_keep_pairs_at_the_bound():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(20_000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.95 * u + math.sqrt(1 - 0.95**2) * w
    differ = np.bitwise_count((lattice.signs(u) ^ lattice.signs(v)).view(np.uint64))
    assert lattice.most_signs(0.95) == 22 and differ.max() <= 22
    apart = np.bitwise_count((lattice.signs(u) ^ lattice.signs(w)).view(np.uint64))
    assert (apart <= 22).mean() < 0.02


@pytest.mark.parametrize("large", [1, 1 << 10, 1 << 18])
def test_embeddings_against_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(lattice, "LARGE", large)
    monkeypatch.setattr(lattice, "BLOCK", (16, 64))
    monkeypatch.setattr(lattice, "COUNTED", 1)
    monkeypatch.setattr(lattice, "_PAIRS", 100)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64))
    vectors = [list(map(float, c + rng.normal(size=64) * s)) for c in centres for s in (0, 0.05, 0.1, 0.2, 0.3) for _ in range(4)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    broken = [(900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [float("nan")] + [1.0] * 63, 1), (904, [None] + [1.0] * 63, 1), (905, [float("inf")] * 64, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [x * 1e150 for x in vectors[0]], 1), (None, vectors[0], 1)]
    df = spark.createDataFrame(rows + broken, "vec_id bigint, embedding array<double>, label int").withColumns({"id": F.lit(1), "digest": F.lit(1)})
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    x = np.array(vectors + [broken[8][1]], dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    ids = [*range(len(vectors)), 908]
    links = [got[i].n_links for i in ids]
    assert sum(links) >= 0.99 * (near.sum() - len(ids)) and all(a <= b for a, b in zip(links, near.sum(axis=1) - 1))
    groups = components(len(ids), np.argwhere(np.triu(near, 1)))
    assert np.mean([got[i].component_id == ids[g] for i, g in zip(ids, groups)]) > 0.99
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(900, 906))
    assert got[907].component_id == 906 and got[None].component_id is None and not got[None].kept
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_large_cells_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(lattice, "COUNTED", 1)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=32)
    vectors = [list(map(float, centre + rng.normal(size=32) * s)) for s in rng.uniform(0.0, 0.5, 300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[i]) for i in range(0, 300, 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    results = []
    for large, block in ((1 << 40, (512, 8192)), (1, (16, 32)), (2000, (50, 8192))):
        monkeypatch.setattr(lattice, "LARGE", large)
        monkeypatch.setattr(lattice, "BLOCK", block)
        results.append(sorted(map(tuple, lattice.near_duplicates(df).collect())))
    assert results[0] == results[1] == results[2] and max(r[1] for r in results[0]) > 50
    with pytest.raises(ValueError):
        lattice.near_duplicates(df, tables=lattice.MOST_TABLES + 1)


def test_forests_connect_without_cycles():
    rng = np.random.default_rng(3)
    labels, a, b, links = np.arange(60), rng.integers(0, 60, 90), rng.integers(0, 60, 90), []
    for part in (slice(0, 45), slice(45, 90)):
        at = lattice.forest(a[part], b[part], labels)
        links += list(zip(a[part][at].tolist(), b[part][at].tolist()))
    want = components(60, list(zip(a.tolist(), b.tolist())))
    assert components(60, links) == want and len(links) == 60 - len(set(want))


def test_copies_of_a_vector_are_counted(spark):
    v = [float(i) for i in range(1, 9)]
    df = spark.createDataFrame([(i, v, 0) for i in (5, 4, 9, 9)], "vec_id bigint, embedding array<float>, label int")
    got = lattice.near_duplicates(df).collect()
    assert all(r.n_links == 3 and r.component_id == 4 for r in got) and sum(r.kept for r in got) == 1


BENCH = "item_id bigint, text string"


def test_templates_find_copies_and_new_parameters(spark):
    item = "If the farmer Alice buys 12 apples and sells 5 of them to Bob for 30 euro how much money does Alice have left after the sale"
    again = "If the farmer Carol buys 77 apples and sells 8 of them to Dave for 90 euro how much money does Carol have left after the sale"
    wrong = "If the farmer Carol buys 77 apples and sells 8 of them to Dave for 90 euro how much money does Mallory have left after the sale"
    filler = "some ordinary words about nothing at all that go on for a while"
    rows = [(1, f"{filler}\n{item}. {filler}"), (2, f"{filler} {again}"), (3, f"{filler} {wrong}"), (4, filler), (5, None), (6, ""), (7, item.upper().replace(" ", "  ")), (None, item), (8, "Name five colours"), (9, "12 34 56 78 90 12 34 56 78"), (1, f"{filler}\n{item}. {filler}"), (10, "x " * 100_000 + item)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumns({"item": F.lit(1), "h": F.lit(1), "contaminated": F.lit("x"), "hash": F.lit(0)})
    bench = spark.createDataFrame([(20, item), (21, item), (22, None), (None, filler), (23, "name five colours now"), (24, "3 4 5 6"), (25, "")], BENCH).withColumn("doc_id", F.lit(1))
    got = decontaminate.mark(docs, bench).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(got[0].asDict())
    marks = {r.doc_id: r for r in got}
    assert all(marks[i].contaminated for i in (1, 2, 10, None)) and marks[1].item_id == 20
    assert not any(marks[i].contaminated for i in (4, 5, 6, 8, 9))
    # a name that changes on the way contradicts the template
    assert not marks[3].contaminated
    assert decontaminate.mark(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.mark(docs, bench.limit(0)).collect())


def test_leaks_of_all_documents_against_all_items(spark, sf_dir):
    docs, bench = (queries.table(spark, sf_dir, n).collect() for n in ("documents", "benchmark"))
    known = plain_families([(r.item_id, r.text) for r in bench])
    got = {r.doc_id: (r.item_id, r.covered) for r in queries.op4_decontamination(spark, sf_dir).collect()}
    assert got == {r.doc_id: plain_leaks(known, r.text) for r in docs}


def test_leaks_against_plain_windows(spark, sf_dir):
    docs, bench = (queries.table(spark, sf_dir, n).collect() for n in ("documents", "benchmark"))

    def words(t):
        return [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in (t or "").split()) if w]

    grams = {tuple(w[i : i + 13]) for b in bench for w in [words(b.text)] for i in range(len(w) - 12)}
    plain = {d.doc_id for d in docs for w in [words(d.text)] if any(tuple(w[i : i + 13]) in grams for i in range(len(w) - 12))}
    got = {r.doc_id for r in queries.op4_decontamination(spark, sf_dir).collect() if r.contaminated}
    assert plain and plain <= got and len(got - plain) <= 0.2 * len(plain) + 1


def test_template_windows_stay_inside_texts():
    texts = ["one two three four five six seven eight nine", "", "In 5 km Bob ran fast with great joy and zeal"]
    whole = decontaminate.template(texts)
    assert whole.counts.tolist() == [9, 0, 11]
    assert whole.slots.tolist()[9:13] == [0, 1, 3, 2]
    at, hashes = whole.windows(8)
    apart = np.concatenate([decontaminate.template([t]).windows(8)[1] for t in texts])
    assert hashes.tolist() == apart.tolist() and all(itertools.pairwise(at.tolist()))


def found_items(spark, items, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = decontaminate.mark(docs, spark.createDataFrame(list(enumerate(items, 1)), BENCH)).collect()
    return [r.item_id for r in sorted(got, key=lambda r: r.doc_id)]


def test_copies_of_each_item_of_a_template(spark):
    items = [f"In the morning Tom has {a} apples and buys {b} more apples so how many apples does he have now" for a, b in ((5, 5), (3, 7), (5, 5), (3, 9))]
    changed = "In the morning Tom has 4 apples and buys 6 more apples so how many apples does he have now"
    assert found_items(spark, items, [f"some words {x} some words" for x in (items[0], items[1], items[3], changed)]) == [1, 2, 2, 2]
    # a copied part counts even where another value contradicts it further on
    tail = items[1] + " if the other 3 of his friends come along"
    assert found_items(spark, [tail], [tail.replace("other 3", "other 8")]) == [1]


def plain_families(items):
    """Families of (id, text) with their windows: what a text's windows are looked up in."""
    families = {}
    for i, x in items:
        t = decontaminate.template([x])
        values = t.values.tolist()
        fills = tuple(values.index(v) if s else None for v, s in zip(values, t.slots))
        families.setdefault((tuple(t.codes.tolist()), fills), []).append((i, t))
    out, windows = [], {}
    for (codes, fills), members in families.items():
        n, slots = len(codes), members[0][1].slots.tolist()
        size, kinds = min(n, decontaminate.WINDOW), {}
        family = (min(i for i, _ in members), n, size, slots, fills, kinds, {tuple(t.values.tolist()) for _, t in members})
        out.append(family)
        for p in range(n - size + 1) if n >= decontaminate.LEAST_WORDS else ():
            window = slots[p : p + size]
            literal = {0: sum(x == 0 for x in window) > size // 2, 1: sum(x in (0, 2) for x in window) > size // 2, 2: True}
            kinds[p] = min(k for k, ok in literal.items() if ok)
            for _, t in members:
                v = t.values.tolist()
                own = {0: codes[p : p + size], 1: tuple(v[k] if slots[k] == 2 else codes[k] for k in range(p, p + size)), 2: tuple(v[p : p + size])}
                for k in own:
                    if literal[k]:
                        windows.setdefault((k, own[k]), set()).add((len(out) - 1, p))
    return out, windows


def plain_leaks(known, text):
    """(smallest item, covered) of the families that a text leaks, every window being held against all items at every shift."""
    families, windows = known
    d = decontaminate.template([text or ""])
    found, words, codes, slots = [], d.values.tolist(), d.codes.tolist(), d.slots.tolist()
    lines = {tuple(decontaminate.template([x]).values.tolist()) for x in (text or "").split("\n")}
    found += [(item, n) for item, n, *_, members in families if 0 < n < decontaminate.LEAST_WORDS and members & lines]
    hits = {}
    for size in {f[2] for f in families if f[1] >= decontaminate.LEAST_WORDS}:
        for at in range(len(words) - size + 1):
            span = range(at, at + size)
            there = {0: tuple(codes[at : at + size]), 1: tuple(words[k] if slots[k] == 2 else codes[k] for k in span), 2: tuple(words[at : at + size])}
            for k, x in there.items():
                for f, p in windows.get((k, x), ()):
                    hits.setdefault((f, at - p), {}).setdefault((at, p), set()).add(k)
    places = {}
    for (f, _), shift in hits.items():
        item, n, size, _, fills, kinds, _ = families[f]
        pairs = {(at, p): {(fills[p + k], words[at + k]) for k in range(size) if fills[p + k] is not None} for at, p in shift}
        everything = set().union(*pairs.values())
        fits = len({b for b, _ in everything}) == len(everything)
        kept = sorted((at, p) for (at, p), ks in shift.items() if fits or 2 in ks or not pairs[at, p])
        places.setdefault(f, set()).update(p for _, p in kept)
        for _, group in itertools.groupby(enumerate(at for at, _ in kept), lambda x: x[1] - x[0]):
            covered = len(list(group)) + size - 1
            if covered >= min(decontaminate.LEAST_RUN, n):
                found.append((item, covered))
    for f, there in places.items():
        item, kinds = families[f][0], families[f][5]
        for level in range(3):
            total, covered = sum(k <= level for k in kinds.values()), sum(kinds[p] <= level for p in there)
            if covered >= max(decontaminate.LEAST_SHARE * total, 2):
                found.append((item, covered))
    return (min(i for i, _ in found), max(c for _, c in found)) if found else (None, 0)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_leaks_of_sibling_items_against_all_items_and_places(spark, seed):
    rnd = random.Random(seed)
    plain = "the farmer buys sells apples pears and then gives to a friend how many are left in all after that day".split()
    names, units = ["Alice", "Bob", "Carol"], ["kg", "euro"]

    def frame():
        return [rnd.choice(["w", "w", "w", "w", "n", "u", "p"]) for _ in range(rnd.choice([2, 3, 5, 7, 9, 14, 22, 30]))]

    def filled(shape, seed_words):
        out, k = [], 0
        for x in shape:
            k += 1
            out += [seed_words[k % len(seed_words)]] if x == "w" else [str(rnd.randint(1, 3))] if x == "n" else [str(rnd.randint(1, 3)), rnd.choice(units)] if x == "u" else [rnd.choice(names)]
        return " ".join(out)

    shapes = [(frame(), rnd.sample(plain, 12)) for _ in range(8)]
    items = [(k + 1, filled(*shapes[k % len(shapes)])) for k in range(40)]
    docs = []
    for k in range(120):
        shape, seed_words = rnd.choice(shapes)
        words = (rnd.choice(items)[1] if k % 2 else filled(shape, seed_words)).split()
        for _ in range(rnd.choice([0, 0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = rnd.choice([*plain, "7", "Dave"])
        cut = rnd.choice([0, 0, 0, 3])
        words = words[cut:]
        lead = " ".join(rnd.choice(plain) for _ in range(rnd.randint(0, 6)))
        docs.append(f"{lead}{rnd.choice([' ', chr(10)])}{' '.join(words)}{rnd.choice(['', ' and so on', chr(10) + 'more'])}")
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(docs)], DOCS)
    got = {r.doc_id: (r.item_id, r.covered) for r in decontaminate.mark(table, spark.createDataFrame(items, BENCH)).collect()}
    known = plain_families(items)
    want = {i: plain_leaks(known, t) for i, t in enumerate(docs)}
    assert sum(x[0] is not None for x in want.values()) > 20 and sum(x[0] is None for x in want.values()) > 5
    assert got == want


def test_items_of_a_few_words_are_found_as_whole_lines(spark):
    texts = ["Name five\ncolours", "  name FIVE, \nand more", "please Name five colours", "x\n12 + 30\ny", "12 + 30 is"]
    assert found_items(spark, ["Name five", "12 + 30"], texts) == [1, 1, None, 2, None]


def test_a_family_of_items_is_matched_once(spark, monkeypatch):
    counts = {}
    keep = decontaminate.materialise

    def counted(df, tag):
        out = keep(df, tag)
        counts[tag] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "materialise", counted)
    items = [f"In the morning Tom has {a} apples and buys {a + 500} more apples so how many apples does he have now" for a in range(300)]
    assert found_items(spark, items, [items[7], items[290].replace("790", "13")]) == [1, 1]
    assert counts["families"] == 1 and counts["window-matches"] < 40


def test_copies_of_items_full_of_numbers_and_names(spark):
    items = ["What is 12 * 34 + 56 ?", "Barack Obama met Angela Merkel and Emmanuel Macron in Paris in May 2016", "What is 12 plus 34 minus 5 times 6?", "Solve 2x + 3y = 12 and 4x - 5y = 6 for x and y"]
    copies = [f"some words about this and that {x} and so on" for x in items]
    others = ["What is 13 * 35 + 57 ?", "Tony Blair met Gerhard Schroeder and Jacques Chirac in Berlin in June 2001", "3 4 5 6 7"]
    assert found_items(spark, items, copies + others) == [1, 2, 3, 4, None, None, None]
    # windows that only copies can match don't count against a new fill of the rest
    item = "the cook puts a little salt into the pan and 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"
    assert found_items(spark, [item], [item.replace(" 1 ", " 50 ").replace(" 3 ", " 70 ")]) == [1]


def test_copies_in_other_case_or_wrapped_elsewhere(spark):
    item = "If the farmer Alice buys 12 apples and sells 5 of them to Bob for 30 euro how much money does Alice have left after the sale"
    other = item.replace("12", "77").replace("30", "90")
    texts = [x for t in (item, other) for x in (t.lower(), t.upper().replace(" ", "  "), t.replace(" Alice", "\nAlice").replace(" Bob", "\nBob"))]
    assert found_items(spark, [item], texts + ["if the farmer carol buys 12 apples"]) == [1] * 6 + [None]


def test_texts_with_equal_fingerprints_are_verified(spark):
    def text(k, repeated, times, n):
        return f"{repeated} " * times + " ".join(f"w{k}x{i}" for i in range(n))

    texts = [text(k, "all rights to this text are reserved", 40, 100) for k in range(3)] + [text(k, "ha", 200, 150) for k in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, texts[0]])], DOCS)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}


def test_similar_groups_whatever_the_edit(spark):
    rnd = random.Random(8)
    texts, near = [], []
    for k in range(60):
        words = [f"w{rnd.randrange(4000)}" for _ in range(200)]
        block = [f"new{k}x{i}" for i in range(rnd.choice([20, 35, 45, 48]))]
        at = rnd.choice([0, 100, 200])
        texts += [" ".join(words), " ".join(words[:at] + block + words[at:])]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert len(near) > 40 and [got[i] for i in range(len(texts))] == components(len(texts), near)


def test_shingles_are_counted_over_all_texts(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(60))) for _ in range(300)] + ["", "a b c d a b"] * 5
    want = np.zeros(1 << simhash.COMMON_BITS, dtype=np.int64)
    for text in texts:
        want[sorted({xxhash.xxh64_intdigest(x) >> 64 - simhash.COMMON_BITS for x in simhash.shingles(text, 5)})] += 1
    rows = spark.createDataFrame(list(enumerate(texts)), "h bigint, text string")
    for parts in (1, 40):
        assert simhash._levels(rows.repartition(parts), 5).tolist() == [n.bit_length() for n in want.tolist()]
    assert want.max() > 8 and not simhash._levels(rows.limit(0), 5).any()


def test_copies_of_short_lines_go(spark, sf_dir):
    rows = [(1, "All rights reserved.\n\nこの行は空白のない長い行です。\nAll  rights reserved."), (2, "\nこの行は空白のない長い行です。\nAll rights reserved now.\nAll rights reserved."), (3, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.drop_near_copies(docs).collect()}
    assert got == {1: ("All rights reserved.\n\nこの行は空白のない長い行です。", 1), 2: ("\nAll rights reserved now.", 2), 3: ("x", 0)}
    # the query leaves no copy of a line, however short
    kept = [x.split() for r in queries.op6_line_dedup(spark, sf_dir).dropDuplicates(["doc_id"]).collect() for x in (r.text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    assert len({" ".join(x) for x in kept}) > 0.99 * len(kept)


def test_near_duplicate_stage_compares_rows_of_an_id_and_without_one(spark, sf_dir):
    from corpus_pipeline import drop_near_duplicates

    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(7, one), (7, two), (7, two), (8, two), (None, three), (None, three), (None, one), (None, "q r s t u v")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted([(7, one), (7, two), (None, three), (None, "q r s t u v")], key=str)


def test_near_copies_of_the_pipeline_come_from_simhash(spark, sf_dir, monkeypatch):
    from corpus_pipeline import drop_near_duplicates

    rng = np.random.default_rng(9)
    base = [str(w) for w in rng.integers(0, 10**6, 400)]
    near, moved = [*base[:399], "other"], base[:360]
    unlike = [str(w) for w in rng.integers(0, 10**6, 400)]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((base, near, moved, unlike), 1)], "doc_id bigint, text string")
    proposed, own = [], simhash._hashed_pairs
    monkeypatch.setattr(simhash, "_hashed_pairs", lambda sets, *rest: proposed.append(own(sets, *rest)) or proposed[-1])
    assert [r.doc_id for r in drop_near_duplicates(spark, docs, sf_dir).orderBy("doc_id").collect()] == [1, 4]
    fps = simhash.near_duplicates(docs).select("doc_id", "fp").collect()
    bits = {r.doc_id: r.fp & (2**64 - 1) for r in fps}
    close = sum((bits[a] ^ bits[b]).bit_count() <= 3 for a in bits for b in bits if a < b)
    assert close and len(proposed) == 1 and 1 <= proposed[0].count() <= close
