"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to eight dimensions, once for each table, and decoded to the nearest point of the E8 lattice. Every
vector is stored in the cell it falls into and looks itself up there and in the neighbouring cells that are nearest to it; pairs that meet in some
table, and lie on the same side of most random hyperplanes, are verified by cosine in double precision. Cells with many vectors are
dealt out as pairs of blocks and verified by matrix products, from which only counts and connecting links leave, so that groups of near vectors
never become a table of pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..tables import materialise
from .shared import finish


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, by rule: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([found, halves[(halves < 0).sum(axis=1) % 2 == 0]])


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: even integer points, or those moved by 1/2 in every coordinate."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


#: Bits of a key below its table's number, so that keys of earlier tables are smaller.
KEY_BITS = 57
MOST_TABLES = 1 << 63 - KEY_BITS
#: Cells in which so many pairs meet, or more, are large; they are found by counting one vector in COUNTED, which decides how they are compared and nothing else.
LARGE = 1 << 12
COUNTED = 8
#: Members of a block of a large cell, at least and at most: an eighth of the cell between these bounds, and not more than BLOCK_BYTES of vectors.
BLOCK = (4096, 16384)
BLOCK_BYTES = 1 << 25
#: Pairs looked at in one go inside a block.
_PAIRS = 1 << 17


def _key(cells: np.ndarray, table: int, size: int) -> np.ndarray:
    out = np.full(cells.shape[:-1], size, dtype=np.uint64)
    for k in range(8):
        out = finish(out * np.uint64(3) + np.rint(cells[..., k] * 2).astype(np.int64).view(np.uint64))
    return ((out >> np.uint64(64 - KEY_BITS)) | np.uint64(table << KEY_BITS)).view(np.int64)


@lru_cache(maxsize=64)
def _projection(size: int, table: int, scale: float) -> np.ndarray:
    return np.random.default_rng([size, table]).normal(size=(size, 8)) * scale


def cell_keys(units: np.ndarray, tables: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each vector's own cell (vectors x tables) and of its nearest neighbouring cells (vectors x tables x probes)."""
    size = units.shape[1]
    own, near = np.empty((len(units), tables), dtype=np.int64), np.empty((len(units), tables, probes), dtype=np.int64)
    for t in range(tables):
        x = units @ _projection(size, t, scale)
        cell = decode(x)
        own[:, t] = _key(cell, t, size)
        if probes:
            best = np.argpartition(-((x - cell) @ neighbours().T), probes - 1, axis=1)[:, :probes]
            near[:, t] = _key(cell[:, None, :] + neighbours()[best], t, size)
    return own, near


def most_signs(least_cosine: float) -> int:
    """Of 64 signs those in which a pair to be verified may differ: 6.5 deviations above the mean at the least cosine.

    That is 22 at 0.95, which a linked pair exceeds about once in ten million; unrelated vectors differ in 32 on average.
    """
    share = math.acos(min(1.0, max(-1.0, least_cosine))) / math.pi
    return int(64 * share + 6.5 * math.sqrt(64 * share * (1 - share)))


def signs(units: np.ndarray) -> np.ndarray:
    """A bit for the side of each of 64 random hyperplanes."""
    side = units @ np.random.default_rng([units.shape[1], 64]).normal(size=(units.shape[1], 64)) > 0
    return np.packbits(side, axis=1, bitorder="little").view("<i8")[:, 0]


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Vectors:
    """A column of lists without nulls, as flat numbers."""

    def __init__(self, column: pa.ListArray):
        self.values, self.offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        self.lengths = np.diff(self.offsets)

    def units(self, at: np.ndarray, size: int) -> np.ndarray:
        return _units(self.values[self.offsets[at][:, None] + np.arange(size)])


def meetings(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest key at which each pair of vectors meets, one of them being at home there; the largest number for those that don't.

    p and q hold keys as cell_keys() gives them.
    """
    out = np.full(len(p[0]), np.iinfo(np.int64).max)
    left = np.arange(len(out))
    for t in range(p[0].shape[1]):
        best = np.full(len(left), np.iinfo(np.int64).max)
        for (own, _), (other, near) in ((p, q), (q, p)):
            home = own[left, t]
            met = (other[left, t] == home) | (near[left, t] == home[:, None]).any(axis=1)
            best[met] = np.minimum(best[met], home[met])
        out[left] = best
        # keys of later tables are larger
        left = left[best == np.iinfo(np.int64).max]
        if not len(left):
            break
    return out


def forest(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Places of pairs (a, b) that connect what all of them connect, without cycles; labels, of what is connected already, are brought up to date."""
    picked, at = [], np.arange(len(a))
    while True:
        x, y = labels[a[at]], labels[b[at]]
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        if not len(at):
            return np.concatenate(picked) if picked else np.zeros(0, dtype=np.int64)
        low, high = np.minimum(x, y), np.maximum(x, y)
        # each label but the least hangs itself onto one smaller label
        chosen = np.full(len(labels), -1)
        chosen[high] = np.arange(len(at))
        chosen = chosen[chosen >= 0]
        parent = np.arange(len(labels))
        parent[high[chosen]] = low[chosen]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        labels[:] = parent[labels]
        picked.append(at[chosen])


@dataclass(frozen=True)
class Lattice:
    """Parameters of the tables, and what is done with vectors on the workers."""

    least_cosine: float
    tables: int
    probes: int
    scale: float

    def keys(self, units: np.ndarray, tables: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return cell_keys(units, self.tables if tables is None else tables, self.probes, self.scale)

    def cells(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, v, home, signs) of vectors (v, vector): a row for each key."""
        for batch in parts:
            names, vectors = batch.column(0).to_numpy(), _Vectors(batch.column(1))
            for size in np.unique(vectors.lengths):
                mine = np.flatnonzero(vectors.lengths == size)
                for at in np.array_split(mine, max(1, len(mine) // 1000)):
                    units = vectors.units(at, size)
                    own, near = self.keys(units)
                    keys = np.concatenate([own, near.reshape(len(at), -1)], axis=1)
                    home = np.broadcast_to(np.arange(keys.shape[1]) < self.tables, keys.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(names[at], keys.shape[1])), pa.array(home.ravel()), pa.array(np.repeat(signs(units), keys.shape[1]))], names=["cell", "v", "home", "signs"])

    def verify(self, parts: Iterator[pa.RecordBatch], large: bool) -> Iterator[pa.RecordBatch]:
        """(a, b) of candidates (a, b, cell, vector_a, vector_b) that are near and, where there are large cells, don't meet in one at a smaller key than cell."""
        for batch in parts:
            left, right = _Vectors(batch.column(3)), _Vectors(batch.column(4))
            cells, good = batch.column(2).to_numpy(), []
            for size in np.unique(left.lengths[left.lengths == right.lengths]):
                same = np.flatnonzero((left.lengths == size) & (right.lengths == size))
                for at in np.array_split(same, max(1, len(same) // 4096)):
                    x, y = left.units(at, size), right.units(at, size)
                    near = (x * y).sum(axis=1) >= self.least_cosine
                    at, x, y = at[near], x[near], y[near]
                    good.append(at[meetings(self.keys(x), self.keys(y)) >= cells[at]] if large else at)
            picked = pa.array(np.concatenate(good)) if good else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked)], names=["a", "b"])

    def blocks(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, linked) of rows (cell, low, high, own, v, home, copies, vector) sorted by the first three: counts (b null) and connecting links (linked null)."""
        rest: pa.Table | None = None
        for batch in parts:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            group = np.stack([table.column(k).to_numpy() for k in range(3)])
            ends = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *ends[:-1]], ends, strict=True) if len(ends) else ():
                yield from self._group(table.slice(start, end - start))
            rest = table.slice(ends[-1] if len(ends) else 0)
        if rest is not None:
            yield from self._group(rest)

    def _group(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "linked"]
        cell, low, high = (table.column(k)[0].as_py() for k in range(3))
        own, v, home, copies = (table.column(k).to_numpy() for k in range(3, 7))
        vectors = _Vectors(table.column(7).combine_chunks())
        size = int(vectors.lengths[0])  # keys hold the length, so a cell has one
        units = vectors.units(np.arange(len(v)), size)
        own_keys, near_keys = self.keys(units, (cell >> KEY_BITS) + 1)
        linked, labels = np.zeros(len(v), dtype=np.int64), np.arange(len(v))
        left = np.flatnonzero(own == low)
        right = left if low == high else np.flatnonzero(own == high)
        step = max(1, _PAIRS // max(1, len(right)))
        for start in range(0, len(left), step):
            rows = left[start : start + step]
            near = (units[rows] @ units[right].T >= self.least_cosine) & (home[rows][:, None] | home[right][None, :])
            if low == high:
                near &= rows[:, None] < right[None, :]
            i, j = np.nonzero(near)
            a, b = rows[i], right[j]
            # a pair counts where it meets first
            first = meetings((own_keys[a], near_keys[a]), (own_keys[b], near_keys[b])) == cell
            a, b = a[first], b[first]
            linked += np.bincount(a, copies[b], len(v)).astype(np.int64) + np.bincount(b, copies[a], len(v)).astype(np.int64)
            tree = forest(a, b, labels)
            if len(tree):
                yield pa.RecordBatch.from_arrays([pa.array(v[a[tree]]), pa.array(v[b[tree]]), pa.nulls(len(tree), pa.int64())], names=names)
        some = np.flatnonzero(linked)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(v[some]), pa.nulls(len(some), pa.int64()), pa.array(linked[some])], names=names)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = 0.95, tables: int = 14, probes: int = 16, scale: float = 1.5) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of df.

    n_links counts the other rows with a cosine of at least least_cosine that the lattice tables find (none below it is ever
    linked); component_id is the smallest id reachable over links, itself included; kept says that it is the row's own id. Equal vectors are one node
    with a number of copies and are never paired with each other. Vectors that are null, empty, zero or hold a null or a non-finite number
    link with nothing, nor do those of different lengths with each other; rows with a null id link with nothing either and have no component.
    Rows that share an id and a vector count as copies. With the default parameters a pair at a cosine of exactly 0.95 in 64 dimensions meets with a probability
    over 0.99, closer ones almost surely. Pairs of large cells are verified by matrix products where they stand: m vectors that are all near cost
    m * (m - 1) / 2 products, as their links must be counted, but rows in proportion to m and to the blocks it is dealt to.
    """
    if not 0 < tables <= MOST_TABLES:
        raise ValueError(f"1 to {MOST_TABLES} tables")
    lattice = Lattice(least_cosine, tables, probes, scale)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.coalesce(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    digest = F.when(sound, F.sha2(F.to_binary(F.array_join(F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")), ","), F.lit("utf-8")), 256))
    keyed = rows.withColumn("digest", digest)
    nodes = materialise(keyed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "distinct-vectors")
    # a vector's node is named by a number of its own: rows with different vectors may share an id
    nodes = materialise(nodes.withColumn("v", F.xxhash64("digest")), "nodes")

    placed = materialise(nodes.select("v", "vector").mapInArrow(lattice.cells, "cell bigint, v bigint, home boolean, signs bigint"), "cells")
    some = placed.where(F.pmod(F.xxhash64(F.lit("count"), "v"), F.lit(COUNTED)) == 0).groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("members"))
    large = materialise(some.where(F.col("homes") * F.col("members") * COUNTED * COUNTED >= LARGE).select("cell", (F.col("members") * COUNTED).alias("members")), "large-cells")
    any_large = not large.isEmpty()
    named = nodes.select("v", "node", "copies")

    homes = placed.where("home")
    if any_large:
        homes = homes.join(large.select("cell"), "cell", "left_anti")
    homes, looks = homes.select("cell", F.col("v").alias("a"), F.col("signs").alias("s")), placed.select("cell", F.col("v").alias("b"), F.col("signs").alias("t"))
    close = F.bit_count(F.col("s").bitwiseXOR(F.col("t"))) <= most_signs(least_cosine)
    pairs = homes.join(looks, "cell").where((F.col("a") != F.col("b")) & close).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("cell").alias("cell"))
    pairs = materialise(pairs, "candidates")
    vector = lambda end: nodes.select(F.col("v").alias(end), F.col("vector").alias(f"vector_{end}"))
    links = materialise(pairs.join(vector("a"), "a").join(vector("b"), "b").select("a", "b", "cell", "vector_a", "vector_b").mapInArrow(lambda parts: lattice.verify(parts, any_large), "a bigint, b bigint"), "links")

    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(named.select(F.col("v").alias("b"), "copies"), "b").select(F.col("a").alias("v"), F.col("copies").alias("linked"))
    if any_large:
        found = _large_cells(lattice, placed, large, nodes)
        counts = counts.unionByName(found.where(F.col("linked").isNotNull()).select(F.col("a").alias("v"), "linked"))
        links = links.unionByName(found.where(F.col("linked").isNull()).select("a", "b"))
    counts = counts.groupBy("v").agg(F.sum("linked").alias("linked"))
    # components run over ids, so that rows which share an id are reachable from each other
    ends = links.join(named.select(F.col("v").alias("a"), F.col("node").alias("x")), "a").join(named.select(F.col("v").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    copies = keyed.where(F.col("digest").isNotNull()).select("id", "digest").join(nodes.select("digest", "node"), "digest").where(F.col("id") != F.col("node")).select(F.col("id").alias("x"), F.col("node").alias("y"))
    components = connected_components(ends.unionByName(copies), "x", "y")
    known = materialise(nodes.select("digest", "v", "node", "copies").join(counts, "v", "left").join(components, "node", "left").select("digest", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "known")
    out = keyed.select("id", "digest").join(known, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _large_cells(lattice: Lattice, placed: DataFrame, large: DataFrame, nodes: DataFrame) -> DataFrame:
    """What Lattice.blocks() finds in large cells (cell, members): every pair of blocks of a cell is a group of its own."""
    longest = nodes.agg(F.max(F.size("vector"))).first()[0]
    least, most = (max(1, min(n, BLOCK_BYTES // (8 * longest))) for n in BLOCK)
    blocks = large.select("cell", F.ceil(F.col("members") / F.greatest(F.lit(least), F.least(F.lit(most), F.col("members") / 8))).cast("int").alias("blocks"))
    members = materialise(placed.join(blocks, "cell").select("cell", "blocks", "v", "home", F.pmod(F.xxhash64(F.lit("block"), "v"), F.col("blocks")).cast("int").alias("own")), "members")
    dealt = members.join(nodes.select("v", "copies", "vector"), "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "v", "home", "copies", "vector")
    grouped = dealt.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return materialise(grouped.mapInArrow(lattice.blocks, "a bigint, b bigint, linked bigint"), "block-links")
