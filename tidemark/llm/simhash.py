"""SimHash near-duplicates (operator 6): BK-trees over shards of the fingerprints.

Fingerprints of 64 bits within `radius` differing bits agree on at least m - radius of any m blocks, so each fingerprint
is dealt to one shard for every choice of m - radius blocks, by the bits in them; two that link meet in some shard. m
grows with the number of fingerprints, which keeps shards small at any size without losing a link. Each shard is a
BK-tree: a child hangs below its parent under the integer Hamming distance between the two, and a search follows only
edges within the radius of the distance it sees. Each task gives a spanning forest of the links it found rather than all
pairs, and components of those forests are the groups.

A shard of up to TREE_SIZE rows is one tree in one task. Larger ones, as a large group of near copies makes, are never in one
task. First, trees of about LEADERS of each one's rows are broadcast, in rounds of at most BROADCAST_BYTES, and its rows are
searched in them where they stand. The rows that one group of leaders holds need no search among themselves; every other row goes into a tree (of at
most TREE_SIZE rows, as many trees as that takes), and all rows of the shard, in slices, visit each of those. So every
link has been looked at, or both its ends are known to be in one group. Trees of the small shards travel through a
shuffle: a broadcast would take fingerprints of all documents through the driver.

Fingerprints that differ in few bits belong to texts that are almost equal. For groups by similarity of shingle sets
(group_similar, which the pipeline uses: five words, 0.8 or more) the radius must be wide, and blocks of bits no longer
part the fingerprints. There a shard is a text's smallest shingle hash under one of KEYS orders: texts of similarity s
share each with probability s, so one of 0.8 is missed in 3 of 10,000 cases. The shard's BK-tree is searched within
WIDE_RADIUS, sketches (smallest hashes in BINS parts of the hash range) pass over pairs that are clearly less similar, and
a pair links only if the two sets themselves (of 32-bit hashes) are that similar. All of it is of sets: the fingerprint counts each
different shingle once, and what is compared once, however many documents have it, is a set of shingles (by a hash of
it). Different sets with one fingerprint are compared like any others.

Defined cases: null or blank text has fingerprint zero (the empty set) and links like any other; text of fewer words than a
shingle is one shingle; texts of any length are read whole, in slices; repeated rows and exact copies have one fingerprint, are compared once and have
a row each in the result; a null doc_id has a fingerprint and gets its group's smallest id (null where the group has
none); groups don't depend on ties; only the two named columns are read, so others may have any name and type; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import cut, lean, named, table
from .components import connected_components
from .grouping import BROADCAST_ROWS, join_groups, join_unique, join_verified, runs, sized

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Mean fingerprints of a shard, beyond which one more block is used.
MEAN_SHARD = 128
#: Rows, and bytes of shingle sets, of one tree; a shard with more is searched in parts.
TREE_SIZE, TREE_BYTES = 1024, 16 << 20
#: Rows of a large shard that its broadcast tree holds, about; bytes of one broadcast.
LEADERS, BROADCAST_BYTES = 64, 16 << 20
#: Bytes of a text that are split into words at a time.
SLICE = 4 << 20
SPACES = b"\t\n\x0b\x0c\r "


# ---------------------------------------------------------------- fingerprints
def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            end = min((i for c in SPACES if (i := data.find(c, end, end + SLICE)) >= 0), default=len(data))
        yield data[at:end].split()  # of bytes: ASCII white space only
        at = end


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the whole text; of the whole if it has fewer words; none for no words."""
    import xxhash

    digest, out, words = xxhash.xxh64_intdigest, [], []
    for some in _words((text or "").encode().lower()):  # of bytes: ASCII letters only
        words += some
        if len(words) >= shingle:
            joined, count = b" ".join(words), len(words) - shingle + 1
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[:count].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            out.append(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype="<u8", count=count))
            words = words[count:]
    if not out:
        return np.array([digest(b" ".join(words), SEED)] if words else [], dtype="<u8")
    return out[0] if len(out) == 1 else np.concatenate(out)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("id", kind), StructField("fp", LongType(), False)])
    picked = docs.select(named(id_col).alias("id"), named(text_col).cast(StringType()).alias("text"))
    return picked.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- BK-trees
class BKForest:
    """BK-trees of many shards at once. shard: the shard of each node's value."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values = values.astype(np.uint64, copy=False)
        n = len(values)
        self.parent = np.full(n, -1, dtype=np.int64)
        self.edge = np.zeros(n, dtype=np.int64)
        _, first, back = np.unique(shard, return_index=True, return_inverse=True)
        self.roots = dict(zip(shard[first].tolist(), first.tolist(), strict=True))
        at = first[back]  # the node that each value has come down to
        left = np.flatnonzero(at != np.arange(n))
        while len(left):
            gap = np.bitwise_count(self.values[left] ^ self.values[at[left]]).astype(np.int64)
            _, first, back = np.unique(at[left] * 128 + gap, return_index=True, return_inverse=True)
            child = left[first]
            self.parent[child], self.edge[child] = at[child], gap[first]
            at[left] = child[back]
            left = left[at[left] != left]
        below = np.flatnonzero(self.parent >= 0)
        key = self.parent[below] * 128 + self.edge[below]
        order = np.argsort(key, kind="stable")
        self.child, self.key = below[order], key[order]

    def within(self, queries: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query's position, node) at most radius bits apart in the query's shard."""
        queries = queries.astype(np.uint64, copy=False)
        root = np.array([self.roots.get(s, -1) for s in shard.tolist()], dtype=np.int64)
        who = np.flatnonzero(root >= 0)
        node, found = root[who], []
        while len(who):
            gap = np.bitwise_count(queries[who] ^ self.values[node]).astype(np.int64)
            hit = gap <= radius
            found.append((who[hit], node[hit]))
            low = np.searchsorted(self.key, node * 128 + np.maximum(gap - radius, 0), "left")
            high = np.searchsorted(self.key, node * 128 + gap + radius, "right")
            many = high - low
            who = np.repeat(who, many)
            start = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)
            node = self.child[start + np.arange(len(who))]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


Same = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Trees:
    """The trees of some shards, searched by rows that may link with what is in them; groups by position, a row of a tree
    before any other. sets: the rows' shingle sets, if pairs must also be similar."""

    def __init__(self, values: np.ndarray, shard: np.ndarray, radius: int, sets: Sets | None = None):
        self.trees, self.radius, self.sets, self.n = BKForest(values, shard), radius, sets, len(values)
        self.root = np.arange(self.n)
        _, counts = np.unique(shard, return_counts=True)
        self.step = max(64, int(1_000_000 // max(1, counts.max(initial=1))))
        for at in range(0, self.n, self.step):
            a, b = self.trees.within(values[at : at + self.step], shard[at : at + self.step], radius)
            self.root = self._joined(self.root, a + at, b, self.sets)

    def _joined(self, root: np.ndarray, a: np.ndarray, b: np.ndarray, sets: Sets | None) -> np.ndarray:
        a, b = a[a != b], b[a != b]
        if sets is None:
            return join_groups(root, a, b)
        return join_verified(root, a, b, sets.similar)

    def visit(self, values: np.ndarray, shard: np.ndarray, sets: Sets | None = None) -> np.ndarray:
        """For each row the position, in the trees, of a group that it links with, or -1; groups that it links with become one."""
        out = np.full(len(values), -1, dtype=np.int64)
        for at in range(0, len(values), self.step):
            part = values[at : at + self.step]
            q, node = self.trees.within(part, shard[at : at + self.step], self.radius)
            both = None if self.sets is None else self.sets.beside(sets, at, at + len(part))
            root = self._joined(np.concatenate([self.root, self.n + np.arange(len(part))]), q + self.n, node, both)
            self.root, mine = root[: self.n], root[self.n :]
            out[at : at + len(part)] = np.where(mine < self.n, mine, -1)
        return out

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, root) of the rows in the trees that aren't their group's first."""
        some = np.flatnonzero(self.root != np.arange(self.n))
        return some, self.root[some]


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """How many blocks: the fewest that keep the mean shard within MEAN_SHARD, up to twice the radius."""
    for m in range(radius + 1, 2 * radius):
        if count <= MEAN_SHARD * 2 ** (BITS * (m - radius) // m):
            return m
    return 2 * radius


def shard_keys(fp: Column, m: int, radius: int = RADIUS) -> Column:
    """array<struct<choice, bits>>: one shard for each choice of m - radius of m blocks."""
    edges = [BITS * i // m for i in range(m + 1)]
    cuts = [
        F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(m)
    ]
    keys = []
    for number, choice in enumerate(combinations(range(m), m - radius)):
        bits = F.lit(0).cast("long")
        for i in choice:
            bits = F.shiftleft(bits, edges[i + 1] - edges[i]).bitwiseOR(cuts[i])
        keys.append(F.struct(F.lit(number).alias("choice"), bits.alias("bits")))
    return F.array(*keys)


def _by_shard(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by the first `keys` columns -> columns of whole shards, many at a time, with the shard's number first."""
    held: list[list[np.ndarray]] = []

    def whole(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        new = np.ones(len(columns[0]), dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
        shard = np.cumsum(new) - 1
        some = np.bincount(shard)[shard] > 1
        return [shard[some], *[c[some] for c in columns[keys:]]]

    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, 2 * TREE_SIZE):
            batch = whole_batch.slice(at, 2 * TREE_SIZE)
            part = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(batch.num_columns)]
            last = np.all([c == c[-1] for c in part[:keys]], axis=0)
            start = 0 if last.all() else len(last) - int(np.argmin(last[::-1]))
            follows = held and all(held[-1][i][-1] == part[i][0] for i in range(keys))
            if start or not follows:
                if start:
                    held.append([c[:start] for c in part])
                if held:
                    yield whole(held)
                held = []
            held.append([c[start:] for c in part])
    if held:
        yield whole(held)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(column: np.ndarray | None, similarity: float | None) -> Sets | None:
    return None if similarity is None else Sets([np.frombuffer(x, dtype="<u4") for x in column], similarity)


def _whole_shards(batches: Iterator[pa.RecordBatch], radius: int, similarity: float | None) -> Iterator[pa.RecordBatch]:
    """Rows (choice, bits, unit, fp, hashes?) of small shards sorted by the first two -> links of units."""
    for shard, unit, fp, *hashes in _by_shard(batches, 2):
        if len(fp):
            a, b = Trees(fp.view(np.uint64), shard, radius, _sets(*hashes or [None], similarity)).moved()
            yield _pairs(unit[a], unit[b])


class _Leaders:
    """The broadcast trees of some large shards."""

    def __init__(self, rows: pa.Table, radius: int, similarity: float | None):
        columns = [c.to_numpy() for c in rows.columns]
        self.keys = {k: i for i, k in enumerate(sorted(set(self._shards(columns))))}
        self.choice, self.bits, self.unit, self.similarity = *columns[:3], similarity
        self.trees = Trees(columns[3].view(np.uint64), self._numbers(columns), radius, _sets(*columns[4:] or [None], similarity))
        self.own = self.trees.root

    @staticmethod
    def _shards(columns: list[np.ndarray]) -> list[tuple[int, int]]:
        return list(zip(columns[0].tolist(), columns[1].tolist(), strict=True))

    def _numbers(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.array([self.keys[k] for k in self._shards(columns)], dtype=np.int64)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (choice, bits, unit, fp, hashes?) -> (choice, bits, unit, root): a leader of the group that the row joins, or
        null; and a row more for each leader whose group a row made one with another."""
        for whole in batches:
            for at in range(0, whole.num_rows, TREE_SIZE):
                columns = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in whole.slice(at, TREE_SIZE).columns]
                self.trees.root = self.own
                found = self.trees.visit(columns[3].view(np.uint64), self._numbers(columns), _sets(*columns[4:] or [None], self.similarity))
                made = np.flatnonzero(self.trees.root != self.own)
                roots = np.concatenate([found, self.trees.root[made]])
                names = pa.array(self.unit[np.maximum(roots, 0)], pa.int64(), mask=roots < 0)
                rows = [pa.array(np.concatenate([x, y[made]])) for x, y in zip(columns, (self.choice, self.bits, self.unit), strict=False)]
                yield pa.RecordBatch.from_arrays([*rows, names], names=["choice", "bits", "unit", "root"])


def _searching(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lean(lambda batches: shared.value.run(batches))


def _by_leaders(hot: DataFrame, attach: Callable[[DataFrame], DataFrame], radius: int, similarity: float | None) -> DataFrame:
    """(choice, bits, unit, root) of the rows of large shards, hot(choice, bits, n, unit, fp, size); see _Leaders."""
    spark, keys, kind = hot.sparkSession, ["choice", "bits"], "choice int, bits long, unit long, root long"
    part = F.pmod(F.xxhash64("unit", F.lit(7)), F.lit(1 << 30))
    leaders = hot.where(part < F.lit(LEADERS * 2.0**30) / F.col("n"))
    size = leaders.agg(F.sum(F.lit(64) + F.col("size"))).first()[0] or 0
    rounds = int(size // BROADCAST_BYTES) + 1
    here = F.pmod(F.xxhash64(*keys), F.lit(rounds))
    out = []
    for k in range(rounds):
        trees = _Leaders(attach(leaders.where(here == k)).toArrow(), radius, similarity)
        rows = hot.where(here == k)
        alone = F.lit(None).cast("long").alias("root")
        if not trees.keys:  # by chance, no row of these shards leads
            out.append(rows.select(*keys, "unit", alone))
            continue
        known = F.broadcast(leaders.where(here == k).select(*keys).distinct())  # as many as trees
        shared = spark.sparkContext.broadcast(trees)
        out.append(attach(rows.join(known, keys, "left_semi")).mapInArrow(_searching(shared), kind))
        out.append(rows.join(known, keys, "left_anti").select(*keys, "unit", alone))
    return cut(reduce(DataFrame.unionByName, out))


def _visits(batches: Iterator[pa.RecordBatch], radius: int, similarity: float | None) -> Iterator[pa.RecordBatch]:
    """Rows (choice, bits, tree, slice, own, unit, fp, hashes?), a tree's own rows before a slice of its visitors -> links."""
    now, held, trees, names = None, [], None, None

    def columns(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
        return [np.asarray(rows.column(i).to_numpy()) if isinstance(rows, pa.Table) else np.asarray(rows.column(i).to_numpy(zero_copy_only=False)) for i in range(5, rows.num_columns)]

    def planted() -> tuple[Trees, np.ndarray]:
        unit, fp, *hashes = columns(pa.Table.from_batches(held))
        return Trees(fp.view(np.uint64), np.zeros(len(fp), np.int64), radius, _sets(*hashes or [None], similarity)), unit

    def ends() -> Iterator[pa.RecordBatch]:
        if trees is not None:
            a, b = trees.moved()
            yield _pairs(names[a], names[b])

    for key, rows in runs(batches, 4):
        if key != now:
            yield from ends()
            now, held, trees = key, [], None
        own = rows.column(4).to_pylist()
        first = own.index(False) if not own[-1] else len(own)
        if first:
            held.append(rows.slice(0, first))
        for at in range(first, rows.num_rows, TREE_SIZE):
            if trees is None:
                trees, names = planted()
            unit, fp, *hashes = columns(rows.slice(at, TREE_SIZE))
            root = trees.visit(fp.view(np.uint64), np.zeros(len(fp), np.int64), _sets(*hashes or [None], similarity))
            some = np.flatnonzero(root >= 0)
            yield _pairs(unit[some], names[root[some]])
    yield from ends()


def shard_links(rows: DataFrame, radius: int, similarity: float | None = None, sets: DataFrame | None = None) -> DataFrame:
    """rows(choice, bits, unit, fp) -> (a, b): links of units that span the groups found in all shards. sets(u2, size, hashes): the units'
    shingle sets, where pairs must be similar too; they are joined to rows only on the way to their tree."""
    keys, kinds = ["choice", "bits"], "a long, b long"
    if sets is None:
        rows = rows.withColumn("size", F.lit(0))
    else:
        rows = cut(rows.join(sets.select("u2", "size"), F.col("unit") == F.col("u2")).drop("u2"))

    def attach(some: DataFrame, *more: str) -> DataFrame:
        names = [*keys, *more, "unit", "fp"]
        if sets is None:
            return some.select(*names)
        return some.join(sets.select("u2", "hashes"), F.col("unit") == F.col("u2")).select(*names, "hashes")

    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    large = cut(sizes.where((F.col("n") > TREE_SIZE) | (F.col("bytes") > TREE_BYTES)).drop("bytes"))
    count = large.count()
    small = attach(rows.join(sized(large, count), keys, "left_anti") if count else rows)
    links = small.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(lambda it: _whole_shards(it, radius, similarity)), kinds)
    if not count:
        return links
    hot = cut(rows.join(sized(large, count), keys))
    found = _by_leaders(hot, attach, radius, similarity)
    joined = found.where("root is not null")
    links = links.unionByName(joined.select(F.col("unit").alias("a"), F.col("root").alias("b")))
    # The largest group of each shard; all other rows go into trees.
    main = joined.groupBy(*keys, "root").count().groupBy(*keys).agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    inside = found.join(sized(main, count), keys).where("root = main").select(*keys, "unit").distinct()
    others = cut(hot.join(inside, [*keys, "unit"], "left_anti"))
    trees = F.greatest(F.ceil(F.count(F.lit(1)) / TREE_SIZE), F.ceil(F.sum("size") / TREE_BYTES), F.lit(1)).cast("int")
    sums = others.groupBy(*keys).agg(trees.alias("trees"))
    spread = lambda n, salt: F.pmod(F.xxhash64("unit", F.lit(salt)), n).cast("int")
    slices = F.ceil(F.col("n") / TREE_SIZE).cast("int")
    own = others.join(sized(sums, count), keys).withColumns({"tree": spread(F.col("trees"), 1), "own": F.lit(True)})
    own = own.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    guests = hot.join(sized(sums, count), keys).withColumns({"slice": spread(slices, 2), "own": F.lit(False)})
    guests = guests.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    at = ["choice", "bits", "tree", "slice"]
    dealt = attach(own.unionByName(guests), "tree", "slice", "own").repartition(*at).sortWithinPartitions(*at, F.desc("own"))
    return links.unionByName(dealt.mapInArrow(lean(lambda it: _visits(it, radius, similarity)), kinds)).where("a <> b")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct(fp), each once -> (a, b): links that span the groups of fingerprints within the radius."""
    m = blocks_for(distinct.count(), radius)
    rows = distinct.select("fp", F.explode(shard_keys(F.col("fp"), m, radius)).alias("k"))
    return shard_links(rows.select("k.choice", "k.bits", F.col("fp").alias("unit"), "fp"), radius)


# ---------------------------------------------------------------- similarity of shingle sets
#: Odd numbers that put hashes in different orders. Fixed values.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
KEYS, BINS, WIDE_RADIUS = len(ORDERS), 1024, 24
#: A sketch tells similarity with an error of about 0.0125; pairs that seem less similar by this much aren't looked at.
CLEARLY = 0.08


def smallest(hashes: np.ndarray) -> list[int]:
    """The smallest hash in each order, as signed longs."""
    return [int((hashes * np.uint64(order)).min().view(np.int64)) for order in ORDERS] if len(hashes) else [0] * KEYS


def packed(hashes: np.ndarray) -> bytes:
    """A set as it travels: 32 bits of each hash, sorted. Of two sets of 1,000 shingles one pair in 4,000 has two different shingles that are taken
    for the same."""
    return np.unique(hashes >> np.uint64(32)).astype("<u4").tobytes()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin: 8 bits of it, 0 for an empty bin."""
    mixed = np.sort(hashes.astype(np.uint64) * np.uint64(ORDERS[0]))
    bins, first = np.unique((mixed >> np.uint64(64 - 10)).astype(np.int64), return_index=True)
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins] = 1 + (mixed[first] >> np.uint64(8)) % np.uint64(255)
    return out


class Sets:
    """Shingle sets, each as sorted numbers, by position."""

    def __init__(self, sets: list[np.ndarray], similarity: float, table: np.ndarray | None = None):
        self.sets, self.similarity = sets, similarity
        self.table = np.stack([sketch(x) for x in sets]) if table is None and sets else table

    def beside(self, other: Sets, start: int, stop: int) -> Sets:
        """These and, behind them, some of another's."""
        return Sets([*self.sets, *other.sets[start:stop]], self.similarity, np.concatenate([self.table, other.table[start:stop]]))

    def may_be_similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), dtype=bool)
        for at in range(0, len(a), 8192):
            x, y = self.table[a[at : at + 8192]], self.table[b[at : at + 8192]]
            same, there = ((x == y) & (x > 0)).sum(axis=1), ((x > 0) | (y > 0)).sum(axis=1)
            out[at : at + 8192] = same >= (self.similarity - CLEARLY) * np.maximum(there, 1)
        return out

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets themselves are that similar, asked where their sketches don't tell that they aren't."""
        out = self.may_be_similar(a, b)
        for k in np.flatnonzero(out).tolist():
            x, y = self.sets[a[k]], self.sets[b[k]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[k] = both >= self.similarity * (len(x) + len(y) - both) - 1e-9
        return out


def shingle_set(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """A hash of the text's set of shingles (as a signed long), and the set as sorted hashes."""
    import xxhash

    hashes = np.unique(shingle_hashes(text, shingle))
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)), hashes


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id_col, unit, fp, keys) of each document's set of shingles; unit is the set's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, fps, keys = [], [], []
            for text in batch.column(1):
                unit, hashes = shingle_set(text.as_py(), shingle)
                units.append(unit)
                fps.append(majority(hashes))
                keys.append(smallest(hashes))
            columns = [batch.column(0), pa.array(units, pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "unit", "fp", "keys"])

    kind = docs.schema[id_col].dataType
    more = [StructField("unit", LongType()), StructField("fp", LongType()), StructField("keys", ArrayType(LongType()))]
    picked = docs.select(named(id_col).alias("id"), named(text_col).cast(StringType()).alias("text"))
    return picked.mapInArrow(lean(run), StructType([StructField("id", kind), *more])).withColumnRenamed("id", id_col)


def sets_of(docs: DataFrame, found: DataFrame, units: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(u2, size, hashes) of the sets that are among units(unit), packed, each set once. found(id_col, unit).

    Only some rows have such a set; while one id for each of them is few enough to broadcast, no other texts are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = dict(shingle_set(text.as_py(), shingle) for text in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(some.keys(), pa.int64()), pa.array([packed(h) for h in some.values()], pa.binary())], names=["unit", "hashes"])

    count, id_ = units.count(), named(id_col)
    if count <= BROADCAST_ROWS:
        ids = found.join(F.broadcast(units), "unit", "left_semi").groupBy("unit").agg(F.min(id_).alias("__first")).select("__first").distinct()
        docs = docs.join(F.broadcast(cut(ids)), id_.eqNullSafe(F.col("__first")), "left_semi")
    known = docs.select(named(text_col).cast(StringType()).alias("text")).mapInArrow(lean(run), "unit long, hashes binary")
    known = known.join(sized(units, count), "unit", "left_semi").dropDuplicates(["unit"])
    return known.select(F.col("unit").alias("u2"), F.length("hashes").cast("long").alias("size"), "hashes")


def similar_links(docs: DataFrame, found: DataFrame, distinct: DataFrame, similarity: float, id_col: str, text_col: str, shingle: int, radius: int = WIDE_RADIUS) -> DataFrame:
    """distinct(unit, fp, keys), each set of docs once -> (a, b): links of units that span the groups."""
    keys = distinct.select("unit", "fp", F.posexplode("keys").alias("choice", "bits"))
    shared = keys.groupBy("choice", "bits").count().where("count > 1").select(F.col("choice").alias("c2"), F.col("bits").alias("b2"))
    met = cut(keys.join(shared, (F.col("choice") == F.col("c2")) & (F.col("bits") == F.col("b2")), "left_semi"))
    sets = cut(sets_of(docs, found, cut(met.select("unit").distinct()), id_col, text_col, shingle))
    return shard_links(met.select("choice", "bits", "unit", "fp"), radius, similarity, sets)


def _units(docs: DataFrame, links: DataFrame, unit: str) -> DataFrame:
    """docs(id_col, unit) -> (unit, root), each unit once: the group that links put it into, by its smallest unit."""
    comps = cut(connected_components(links))
    units = docs.select(unit).distinct()
    return join_unique(units, unit, comps, "node", comps.count()).select(unit, F.coalesce("component", unit).alias("root"))


def _grouped(docs: DataFrame, links: DataFrame, id_col: str, unit: str = "fp") -> DataFrame:
    """docs(id_col, unit) with component_id: the smallest id over the units that links join."""
    id_ = named(id_col)
    roots = cut(_units(docs, links, unit))
    reps = docs.groupBy(F.col(unit).alias("u2")).agg(F.min(id_).alias("rep"))
    roots = cut(roots.join(reps, F.col(unit) == F.col("u2")).select(unit, "root", "rep"))
    least = roots.groupBy(F.col("root").alias("r2")).agg(F.min("rep").alias("component_id"))
    count = roots.count()
    by_unit = cut(join_unique(roots, "root", least, "r2", count, count).select(F.col(unit).alias("u3"), "component_id"))
    return join_unique(docs, unit, by_unit, "u3", count).select(id_, unit, "component_id")


def group_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, unit, component_id): groups of documents linked by the similarity of their shingle sets."""
    found, links = _similar(docs, id_col, text_col, shingle, similarity)
    return _grouped(found.select(named(id_col), "unit"), links, id_col, "unit")


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    found = cut(signatures(docs, id_col, text_col, shingle))
    distinct = cut(found.groupBy("unit").agg(F.min(F.struct("fp", "keys")).alias("s")).select("unit", "s.fp", "s.keys"))
    found = found.select(named(id_col), "unit")
    return found, cut(similar_links(docs, found, distinct, similarity, id_col, text_col, shingle))


def group_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(id_col, fp long, component_id): one row per document; component_id is the smallest id of its group."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    return _grouped(fps, fingerprint_links(cut(fps.select("fp").distinct()), radius), id_col)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stand for their group of similar documents, one for each group: the one with the smallest id
    (none last), then the smallest hash of its set of shingles.

    Rows that share an id but not a group are apart. Rows that repeat both an id and a set of shingles stay once, as the one with
    the smallest text (null first), then the smallest row as JSON. Other columns may have any name and type. Decisions are made on ids and hashes;
    whole rows move only if more ids go than are broadcast, or where an id is missing or repeated.
    """
    id_ = named(id_col)
    found, links = _similar(docs, id_col, text_col, shingle, similarity)
    found = found.select(id_.alias("__id"), "unit")
    roots = cut(_units(found, links, "unit").select(F.col("unit").alias("u2"), "root"))
    placed = join_unique(found, "unit", roots, "u2", roots.count())
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("unit").alias("unit")))
    chosen = cut(placed.groupBy("root").agg(first.alias("r")).select(F.col("r.id").alias("__id"), F.col("r.unit").alias("__unit")))
    # Ids that one row has: those of the rows that go, taken away.
    counts = found.where("__id is not null").groupBy("__id").count()
    single = counts.where("count = 1").select("__id")
    gone = cut(single.join(chosen.where("__id is not null"), "__id", "left_anti").withColumnRenamed("__id", "__gone"))
    twice = cut(counts.where("count > 1").select(F.col("__id").alias("__twice")))
    n_twice, some_null = twice.count(), not found.where("__id is null").isEmpty()
    kept = docs.join(sized(gone, gone.count()), id_ == F.col("__gone"), "left_anti")
    if not n_twice and not some_null:
        return kept
    plain = kept.where(id_.isNotNull()).join(sized(twice, n_twice), id_ == F.col("__twice"), "left_anti")
    odd = docs.where(id_.isNull()).unionByName(docs.join(sized(twice, n_twice), id_ == F.col("__twice"), "left_semi"))
    odd = unit_column(odd, text_col, shingle)
    repeated = chosen.join(sized(twice, n_twice), F.col("__id") == F.col("__twice"), "left_semi")
    keys = repeated.unionByName(chosen.where("__id is null")).withColumnRenamed("__unit", "__u2")
    some = odd.join(keys, id_.eqNullSafe(F.col("__id")) & (F.col("__unit") == F.col("__u2")), "left_semi")
    whole = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    once = some.select(id_.alias("__id"), "__unit", whole.alias("__row"), named(text_col).cast(StringType()).alias("__text"))
    once = once.groupBy("__id", "__unit").agg(F.min_by("__row", F.struct("__text", F.to_json("__row"))).alias("__row"))
    return plain.unionByName(once.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def unit_column(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """docs with the hash of its set of shingles in __unit."""

    @F.pandas_udf("long")
    def unit(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle)[0] for t in texts], dtype="int64")

    return docs.withColumn("__unit", unit(named(text_col).cast(StringType())))


# ---------------------------------------------------------------- query
def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    groups = group_near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
