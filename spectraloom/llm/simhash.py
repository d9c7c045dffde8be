"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into two halves; two fingerprints that differ in at most three bits differ in at most one bit of
one half. The anchors of a half are the words of the perfect Hamming code of length 31 (covering radius 1) with the 32nd bit beside
it. Every half has one anchor within the covering radius, its home, and is replicated to all anchors within that radius plus one,
so both meet at each other's home. Fingerprints are compared anchor by anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..tables import chain, materialise
from .shared import finish

#: Fingerprints at an anchor that are compared in one go; more are dealt out as pairs of blocks.
BLOCK = 1024
_SHINGLES = 1 << 16
#: One in so many fingerprints is counted to find large anchors; that decides how members are dealt out and nothing else.
COUNTED = 16
#: Bits of a shingle's hash that name its counter, and those that name the counters of one block.
COMMON_BITS = 22
BLOCK_BITS = 16


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of size words, repeats included, or all words where there are fewer; A-Z are lower-cased, words part at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, ends = b" ".join(words), np.cumsum([len(x) + 1 for x in words]) - 1
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


#: Bits of each byte, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, size: int, seed: int, views: int = 1) -> np.ndarray:
    """SimHashes of the word shingles of a text: the first of their XXH64 values as they are, each further view of these mixed with a constant.

    A bit is set if it is in more than half of the values; a text without words has zeros.
    """
    grams = shingles(text, size)
    if not grams:
        return np.zeros(views, dtype=np.uint64)
    digest, counts = xxhash.xxh64_intdigest, np.zeros((views, 8, 8), dtype=np.int64)
    place = 256 * (np.arange(8) + 8 * np.arange(views)[:, None, None])
    for k in range(0, len(grams), _SHINGLES):
        hashes = np.array([digest(x, seed) for x in grams[k : k + _SHINGLES]], dtype="<u8")
        seen = np.stack([hashes, *(finish(hashes ^ finish(np.array([v], dtype=np.uint64))) for v in range(1, views))])
        values = seen.view(np.uint8).reshape(views, -1, 8) + place
        counts += np.bincount(values.ravel(), minlength=2048 * views).reshape(views, 8, 256) @ _BITS
    return np.packbits(2 * counts.reshape(views, 64) > len(grams), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 3, seed: int = 42, views: int = 1) -> DataFrame:
    """The columns keep, then fps, the fingerprints as signed bigints; texts without words, null or empty, have zeros."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            made = [fingerprint(x or "", size, seed, views) for x in batch.column(len(keep)).to_pylist()]
            flat = np.concatenate(made).view(np.int64) if made else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * views), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists], names=[*keep, "fps"])

    picked = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(batches, f"{kept}, fps array<bigint>")


def _bit(i: int | Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(i) if isinstance(i, int) else i)


def _anchors(nodes: DataFrame) -> DataFrame:
    """(anchor, id, fp, home) for all anchors of both halves of each fingerprint; anchors of different views differ."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    halves = nodes.select("view", "id", "fp", F.posexplode(F.array(low, F.shiftrightunsigned("fp", 32))).alias("half", "x"))
    syndrome = F.lit(0)
    for j in range(5):
        mask = sum(1 << i for i in range(31) if (i + 1) >> j & 1)
        parity = F.bit_count(F.col("x").bitwiseAND(F.lit(mask).cast("bigint"))).bitwiseAND(F.lit(1))
        syndrome = syndrome + parity * F.lit(1 << j)
    named = halves.withColumn("s", syndrome.cast("int"))
    home = F.when(F.col("s") == 0, F.col("x")).otherwise(F.col("x").bitwiseXOR(_bit(F.col("s") - 1)))
    partner = lambda i: i.bitwiseXOR(F.col("s"))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (F.col("s") != 0) & (i < partner(i)))
    others = F.transform(pairs, lambda i: F.col("x").bitwiseXOR(_bit(i - 1)).bitwiseXOR(_bit(partner(i) - 1)))
    flipped = home.bitwiseXOR(F.lit(1 << 31).cast("bigint"))
    named = named.select("view", "id", "fp", "half", F.posexplode(F.concat(F.array(home, flipped), others)).alias("k", "code"))
    space = F.col("view").cast("bigint") * 2 + F.col("half")
    return named.select((F.shiftleft(space, 32) + F.col("code")).alias("anchor"), "id", "fp", (F.col("k") == 0).alias("home"))


def _tree(fps: np.ndarray, homes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in one group) that connect what links between members at home and all members connect, as trees."""
    near = np.bitwise_count(fps[homes][:, None] ^ fps[None, :]) <= most
    at_home = np.full(len(fps), -1)
    at_home[homes] = np.arange(len(homes))
    fresh, used = np.ones(len(fps), dtype=bool), np.zeros(len(homes), dtype=bool)
    left, right = [], []
    for root in range(len(fps)):
        if not fresh[root]:
            continue
        fresh[root], todo = False, [root]
        while todo:
            member = todo.pop()
            # from a member to homes, and from a home to all members
            reach = np.zeros(len(fps), dtype=bool)
            reach[homes[near[:, member]]] = True
            if (row := at_home[member]) >= 0 and not used[row]:
                used[row] = True
                reach |= near[row]
            new = np.flatnonzero(reach & fresh)
            fresh[new] = False
            left += [member] * len(new)
            right += new.tolist()
            todo += new.tolist()
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _compare(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect what is linked in each group: all links of a small one, trees of a large one.

    Rows come sorted by group, at most about 2 BLOCK rows each.
    """
    rest: list[np.ndarray] | None = None

    def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
        group, block, ids, fps, home = columns
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (block[1:] != block[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [len(group)]]))
        found_a, found_b = [], []
        small = np.repeat(sizes <= 32, sizes)
        number = np.cumsum(new)
        for k in range(1, min(32, int(sizes[sizes <= 32].max(initial=1)))):
            pair = small[:-k] & (number[:-k] == number[k:])
            at = np.flatnonzero(pair)
            at = at[np.bitwise_count(fps[at] ^ fps[at + k]) <= most]
            found_a.append(ids[at])
            found_b.append(ids[at + k])
        for start, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
            own = slice(start, start + n)
            left, right = _tree(fps[own], np.flatnonzero(home[own]), most)
            found_a.append(ids[own][left])
            found_b.append(ids[own][right])
        pair = np.stack([np.concatenate(found_a), np.concatenate(found_b)]) if found_a else np.zeros((2, 0), dtype=np.int64)
        pair = np.unique(pair, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    for batch in parts:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        columns[3] = columns[3].view(np.uint64)
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        last = int(np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1])).max(initial=-1)) + 1
        rest = [x[last:] for x in columns]
        if last:
            yield edges([x[:last] for x in columns])
    if rest is not None:
        yield edges(rest)


def link_fingerprints(nodes: DataFrame, most_bits: int = 3) -> DataFrame:
    """Links (a, b) between ids of nodes (view, id, fp; each fp once a view) that connect exactly what all links of at most most_bits bits connect.

    Fingerprints of different views aren't compared. most_bits is at most 3. Anchors with more than about BLOCK members are found
    first, by counting one in COUNTED, and their members are dealt out to pairs of blocks, so no task holds more than about a block of an
    anchor at a time and nothing is left out. Of a large group each block gives trees of links, not every pair, so its rows grow with its members.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("two halves with one bit each cover at most 3 differing bits")
    replicas = _anchors(nodes)
    some = _anchors(nodes.where(F.pmod(F.xxhash64(F.lit("count"), "fp"), F.lit(COUNTED)) == 0)).groupBy("anchor").count()
    heavy = materialise(some.where(F.col("count") > BLOCK // COUNTED).select("anchor", (F.col("count") * COUNTED).alias("count")), "heavy-anchors")
    grouped = replicas.withColumn("block", F.lit(0).cast("bigint"))
    if not heavy.isEmpty():
        blocks = heavy.select("anchor", F.ceil(F.col("count") / F.lit(BLOCK // 2)).alias("blocks"))
        dealt = replicas.join(blocks, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint"))).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        grouped = dealt.select("anchor", "id", "fp", "home", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("block"))
    grouped = grouped.select("anchor", "block", "id", "fp", "home").repartition("anchor", "block").sortWithinPartitions("anchor", "block", "fp")
    return grouped.mapInArrow(lambda parts: _compare(parts, most_bits), "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most_bits: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp, component_id) for each row of df: component_id is the smallest id reachable over links, itself included.

    Texts are taken whole; null and empty ones have fingerprint 0 and are linked like any other. Rows with the same
    fingerprint are one node whatever their number, so copies are never paired; rows that share an id keep their own
    fingerprints and are in one component. Rows with a null id get the component of their fingerprint (null if no other row has it) but
    link nothing. ids must be integers. An empty table gives no rows; other columns are left out.
    """
    made = fingerprints(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), "text", ("id",), size, seed)
    fps = materialise(made.select("id", F.get("fps", F.lit(0)).alias("fp")), "fingerprints")
    nodes = materialise(fps.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("id")), "distinct-fingerprints")
    same_id = fps.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count_distinct("fp").alias("n")).where(F.col("n") > 1).select("id")
    edges = link_fingerprints(nodes.withColumn("view", F.lit(0)), most_bits)
    shared = fps.join(same_id, "id").join(nodes.select("fp", F.col("id").alias("b")), "fp").select(F.col("id").alias("a"), "b")
    own = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    components = connected_components(edges.unionByName(shared).unionByName(own))
    known = materialise(nodes.join(components, nodes["id"] == components["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id")), "components")
    return fps.join(known, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def _similar(parts: Iterator[pa.RecordBatch], size: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        keep = []
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = set(shingles(left or "", size)), set(shingles(right or "", size))
            common = len(x & y)
            keep.append(common >= least * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _hashed_set(text: str, size: int) -> np.ndarray:
    """The different XXH64 values of the shingles of a text, ascending."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x) for x in shingles(text, size)], dtype=np.uint64))


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COMMON_BITS)).astype(np.int64)


def _levels(rows: DataFrame, size: int) -> np.ndarray:
    """For each counter the binary digits of the number of texts of rows (h, text) that have a shingle there.

    All texts are counted, each once a counter; 2^COMMON_BITS counters have a fixed size, whatever the texts, and may serve several shingles. A task
    sends each block of its counters once, without those at zero, and blocks are added as they stream in. The levels order the shingles of a text, rare ones
    first; what is found doesn't depend on them, only how many texts meet for nothing.
    """
    one = 1 << BLOCK_BITS

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COMMON_BITS, dtype=np.int64)
        for batch in parts:
            for text in batch.column(0).to_pylist():
                seen[np.unique(_places(_hashed_set(text, size)))] += 1
        for block, counts in enumerate(seen.reshape(-1, one)):
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_pydict({"block": [block], "places": [at.astype(np.uint16).tobytes()], "counts": [counts[at].tobytes()]})

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            for block, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums.setdefault(block, np.zeros(one, dtype=np.int64))[np.frombuffer(places, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.int64)
        for block, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "levels": [np.frexp(counts)[1].astype(np.uint8).tobytes()]})

    counted = rows.select("text").mapInArrow(count, "block long, places binary, counts binary").repartition("block").mapInArrow(add, "block long, levels binary").toArrow()
    levels = np.zeros((1 << COMMON_BITS - BLOCK_BITS, one), dtype=np.uint8)
    for block, own in zip(counted.column("block").to_pylist(), counted.column("levels").to_pylist(), strict=True):
        levels[block] = np.frombuffer(own, dtype=np.uint8)
    return levels.reshape(-1)


def _prefixes(rows: DataFrame, size: int, least: float) -> DataFrame:
    """(id, h, node, n, fp, prefix) of rows (id, h, text): a hash of the set of shingles, its size, the text's SimHash as op9 takes it, and the part of the
    set that one of each similar pair shares.

    Two sets of which the larger has n members are least similar only if they have least * n in common, so if all sets are in one order
    the first n - least * n + 1 of both have a member in common.
    """
    levels = rows.sparkSession.sparkContext.broadcast(_levels(rows, size))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in parts:
            nodes, sizes, fps, prefixes = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = _hashed_set(text, size)
                n = len(hashes)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sizes.append(n)
                fps.append(fingerprint(text, 3, 42)[0])
                # equal levels stay in the order of hashes
                prefixes.append(hashes[np.argsort(level[_places(hashes)], kind="stable")[: n - math.ceil(least * n - 1e-9) + 1]].view(np.int64))
            lengths = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(np.array(sizes, dtype=np.int32)), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], names=["id", "h", "node", "n", "fp", "prefix"])

    return rows.mapInArrow(batches, "id bigint, h bigint, node bigint, n int, fp bigint, prefix array<bigint>")


def _hashed_pairs(sets: DataFrame, most_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of sets (node, fp) that SimHash proposes: links between fingerprints of at most most_bits bits apart, found by anchors, and of the sets
    with one fingerprint each with the first."""
    heads = materialise(sets.groupBy("fp").agg(F.min("node").alias("id")), "distinct-fingerprints")
    alike = sets.select("node", "fp").join(heads, "fp").where(F.col("node") != F.col("id")).select(F.col("id").alias("a"), F.col("node").alias("b"))
    links = link_fingerprints(heads.withColumn("view", F.lit(0)), most_bits).unionByName(alike)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """(id, h, component) for each different id and text, h being xxhash64 of the text: texts in one component are linked by pairs whose sets of
    shingles of size words are at least least similar (Jaccard).

    SimHash proposes pairs first: fingerprints of op9, three bits, compared at the anchors of their halves. For what it can't see, every such pair that is
    still in different groups is a candidate (prefix filter on the shingles), whatever the edit. Each pair of both ways is verified on the whole texts. Texts with equal sets are
    one node. Null and empty texts are similar to each other. Texts that share a shingle of their prefixes are first held against one of them; then
    pairs that this leaves in different components against each other, so that large groups of near copies cost no pairs of all with all. Unlike texts that
    share a shingle of their prefixes do: their pairs grow with the square of their number.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), "text")
    made = materialise(_prefixes(rows, size, least), "prefixes")
    sets = materialise(made.groupBy("node").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("prefix").alias("prefix")), "shingle-sets")
    places = sets.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    shared = places.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(F.col("low") != F.col("high")).select("token")
    places = materialise(places.join(materialise(shared, "shared-shingles"), "token", "left_semi"), "shared-places")

    def side(c: str, table: DataFrame) -> DataFrame:
        return table.select("token", *(F.col(x).alias(f"{x}_{c}") for x in table.columns if x != "token"))

    # what two sets can have in common from here on, against what they need
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b")
    enough = most * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-6
    # so many members are common at least; the first of them has the others behind it in both sets
    overlap = F.ceil(least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    first = (F.col("n_a") - F.col("at_a") >= overlap) & (F.col("n_b") - F.col("at_b") >= overlap)
    # and so many of these are in the prefixes: those that a set has alone can push no more out of its prefix
    alone = lambda n: n - F.ceil(least * n - 1e-9) + 1 - n
    needed = F.least(alone(F.col("n_a")), alone(F.col("n_b"))) + overlap

    def worth(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose prefixes have enough in common."""
        own = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("prefix").alias(f"prefix_{c}"))
        return pairs.join(own("a"), "a").join(own("b"), "b").where(F.size(F.array_intersect("prefix_a", "prefix_b")) >= needed).select("a", "b")

    def similar(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets whose texts are similar, and of each side the text once."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        ones = sets.select("node", "h").join(wanted, "node", "left_semi")
        texts = materialise(rows.select("h", "text").join(ones, "h").groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")
        end = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        both = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(lambda parts: _similar(parts, size, least), "a bigint, b bigint")

    def apart(links: DataFrame, name: str) -> DataFrame:
        """places with their groups under links, of tokens that different groups share."""
        groups = chain(links, [(f"{name}-components", connected_components)])
        named = materialise(places.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "named-places")
        mixed = named.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where(F.col("low") != F.col("high")).select("token")
        return materialise(named.join(mixed, "token", "left_semi"), "mixed-places")

    proposed = materialise(_hashed_pairs(sets), "hashed-pairs")
    hashed = chain(materialise(worth(proposed), "hashed-candidates"), [("similar-pairs", similar)])
    rest = apart(hashed, "hashed")
    firsts = rest.groupBy("token").agg(F.min(F.struct("node", "n", "at", "group")).alias("x")).select("token", "x.*")
    met = side("a", rest).join(side("b", firsts), "token").where((F.col("group_a") != F.col("group_b")) & enough)
    met = materialise(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct().join(proposed, ["a", "b"], "left_anti"), "met")
    links = materialise(hashed.unionByName(chain(materialise(worth(met), "candidates"), [("similar-pairs", similar)])), "first-links")
    left = apart(links, "first")
    pairs = side("a", left).join(side("b", left), "token").where("node_a < node_b AND group_a != group_b").where(first)
    pairs = materialise(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(met.unionByName(proposed), ["a", "b"], "left_anti"), "met-later")
    later = materialise(worth(pairs), "more-candidates")
    components = chain(links.unionByName(chain(later, [("similar-pairs", similar)])), [("components", connected_components)])
    named = made.select("id", "h", "node").distinct().join(components, "node", "left")
    return named.select("id", "h", F.coalesce("component", "node").alias("component"))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """(id_col, component_id) for each different id: groups of similar_texts, component_id being the smallest id reachable, itself included.

    Of rows that share an id one text, the least hashed, stands for it; null ids are left out, as are other columns.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.col("id").isNotNull())
    one = materialise(rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("id", "x.text"), "texts-by-id")
    found = materialise(similar_texts(one, "id", "text", size, least), "similar-texts")
    least_ids = found.groupBy("component").agg(F.min("id").alias("component_id"))
    return found.join(least_ids, "component").select(F.col("id").alias(id_col), "component_id")
