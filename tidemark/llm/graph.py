"""Embedding near-duplicates (operator 4): links found on a robust-pruned flat graph.

Vectors of one label are dealt to shards by their nearest cluster centre. A vector also visits, as a guest, every shard
that may hold a vector within the radius of it: u lies on its own centre's side of the plane between two centres, so v
can be within the radius r of u only if |v-c(u)|^2 - |v-c(v)|^2 <= 2 r |c(u)-c(v)|. No linked pair is ruled out, whatever the
size of a group. Where nothing can be ruled out, as in a large group of near copies or among vectors without clusters, a
vector visits many shards, and work grows with the square of what can't be told apart.

In each shard a flat graph is built: every vector's nearest candidates are pruned robustly (a candidate goes if a kept one is
ALPHA times nearer to it than the vector itself), links are made mutual and pruned again. The shard's own vectors are
searched on the graph: greedily with a beam, from the shard's medoids and from the vector's own place and list, and from
there the search widens over every vector within the radius until none is new. Guests have no place in the graph; they
are measured against every vector of the shard. A pair counts as linked only once its cosine is verified in double
precision. Each block's recall is audited: AUDITED of its vectors are measured against the whole block, and a block in which the search
has missed a link is searched by brute force. audit() compares a result with brute force over the table.

A link of v to u counts in the shard of u, where v is at home or a guest, so links are counted where they are found and
never written out. Each shard gives a spanning forest of its links; components of the forests are the groups. Exact copies
are one vertex with a count. A shard with more than BLOCK vectors is split into blocks, each with a graph of its own; those of the
other blocks are its guests. Guests stream through a task, which holds one block. Cluster centres come from a sample of at
most SAMPLE vectors and SAMPLE_BYTES, and are at most CENTRES, which bounds the broadcast; beyond some CENTRES * SHARD
vectors shards have more blocks, and a vector visits more of them.

Defined cases: vectors that are null, zero or hold null or non-finite components, and those without a label, link with
nothing; vectors of other lengths are never compared; rows that repeat an id and a vector are one; rows that repeat an id
with different vectors share one vertex, and each counts its own links; a null id has no links and no component and isn't
kept; ties don't matter to links; empty tables give empty results; columns named like an added one are replaced, others may have
any name and type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import cut, named, replacing, table
from .components import connected_components
from .grouping import join_groups, join_unique, runs, sized
from .vectors import kmeans, matrix, usable

COSINE = 0.93
#: Vectors that are meant to be at home in a shard, and beyond which it is split into blocks of half as many.
SHARD, BLOCK = 1024, 2048
SAMPLE, CENTRES = 131_072, 16_384
#: Bytes of the sample, and of the centres, in double precision.
SAMPLE_BYTES, CENTRE_BYTES = 128 << 20, 32 << 20
#: Guests that are measured at once; vectors of a block whose links are audited.
GUESTS, AUDITED = 1024, 64
#: Near and far neighbours of a vector in one graph, candidates for them, pruning factor, width of the search, entries.
DEGREE, FAR, POOL, ALPHA, BEAM, MEDOIDS = 16, 4, 48, 1.2, 32, 16


# ---------------------------------------------------------------- graph
def robust_prune(sims: np.ndarray, order: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """sims (n, n): all cosines; order (n, pool): candidates of each vector, nearest first (-1: none) -> (n, degree), -1
    where fewer are kept."""
    n = len(order)
    kept = np.full((n, degree), -1, dtype=np.int64)
    for at in range(0, n, 512):
        own = order[at : at + 512]
        rows = np.arange(len(own))
        near = np.maximum(own, 0)
        apart = 2 - 2 * sims[near[:, :, None], near[:, None, :]]  # squared distances among candidates
        away = 2 - 2 * sims[at + rows[:, None], near]
        open_, filled = own >= 0, np.zeros(len(own), dtype=np.int64)
        for _ in range(degree):
            pick = np.argmax(open_, axis=1)  # the nearest that is still open
            some = open_[rows, pick]
            if not some.any():
                break
            kept[at + rows[some], filled[some]] = own[rows[some], pick[some]]
            filled[some] += 1
            open_ &= ~(some[:, None] & (alpha * alpha * apart[rows, pick] <= away))
            open_[rows, pick] = False
    return kept


def _nearest_first(sims: np.ndarray, some: np.ndarray) -> np.ndarray:
    value = np.where(some >= 0, sims[np.arange(len(some))[:, None], np.maximum(some, 0)], -2.0)
    return np.take_along_axis(some, np.argsort(-value, axis=1, kind="stable"), 1)


def build_graph(unit: np.ndarray) -> np.ndarray:
    """(n, 2 * DEGREE + FAR) neighbours, -1 where fewer.

    A tight group's nearest candidates are all its own; so FAR neighbours are pruned from random candidates, nearest first,
    and keep every group within reach.
    """
    n = len(unit)
    if n < 2:
        return np.full((n, 1), -1, dtype=np.int64)
    sims, rows = unit @ unit.T, np.arange(n)
    np.fill_diagonal(sims, -2.0)
    pool = min(POOL, n - 1)
    near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
    one_way = robust_prune(sims, _nearest_first(sims, near), DEGREE)
    a, slot = np.nonzero(one_way >= 0)
    b = one_way[a, slot]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    by = np.lexsort((b, -sims[a, b], a))
    a, b = a[by], b[by]
    place = np.arange(len(a)) - np.searchsorted(a, rows)[a]
    mutual, fits = np.full((n, POOL), -1, dtype=np.int64), place < POOL
    mutual[a[fits], place[fits]] = b[fits]
    some = np.random.default_rng(n).integers(0, n, size=(n, pool))
    some[some == rows[:, None]] = -1
    far = robust_prune(sims, _nearest_first(sims, some), FAR)
    return np.concatenate([robust_prune(sims, mutual, 2 * DEGREE), far], axis=1)


class Mutual:
    """Adjacency lists of n vectors with every link in both directions, so pruning leaves none that can't be reached."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.next = pairs % max(n, 1)
        self.begin = np.searchsorted(pairs // max(n, 1), np.arange(n + 1))

    def expand(self, who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each (who, node) turned into (who, neighbour) for all neighbours."""
        many = self.begin[node + 1] - self.begin[node]
        start = np.repeat(self.begin[node] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
        return np.repeat(who, many), self.next[start + np.arange(len(start))]


def range_search(unit: np.ndarray, graph: Mutual, queries: np.ndarray, own: np.ndarray, known: tuple[np.ndarray, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of cosine at least `cosine`. own: the query's place in the graph, or -1. known: pairs (query,
    vector) to start from, by query; beside them every search starts from the medoids."""
    n, out_q, out_v = len(unit), [], []
    centres = kmeans(unit, min(MEDOIDS, n), 3, np.random.default_rng(n))
    medoids = np.unique(np.argmax(unit @ centres.T, axis=0))
    for at in range(0, len(queries), 128):
        q, mine = queries[at : at + 128], own[at : at + 128]
        count = len(q)
        rows = np.arange(count)
        seen = np.zeros((count, n), dtype=bool)
        sims = np.full((count, n), -2.0)

        def look(who: np.ndarray, what: np.ndarray, q=q, seen=seen, sims=sims) -> tuple[np.ndarray, np.ndarray]:
            """Those of the pairs that are new, once each, now seen and measured."""
            keys = np.unique(who * n + what)
            who, what = keys // n, keys % n
            new = ~seen[who, what]
            who, what = who[new], what[new]
            seen[who, what] = True
            for k in range(0, len(who), 65_536):
                part = slice(k, k + 65_536)
                sims[who[part], what[part]] = np.einsum("pd,pd->p", q[who[part]], unit[what[part]])
            return who, what

        part = slice(*np.searchsorted(known[0], (at, at + count)))
        look(
            np.concatenate([np.repeat(rows, len(medoids)), rows[mine >= 0], known[0][part] - at]),
            np.concatenate([np.tile(medoids, count), mine[mine >= 0], known[1][part]]),
        )
        done = np.zeros((count, n), dtype=bool)
        width = min(BEAM, n)
        while True:  # one step of every query that isn't finished
            beam = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            value = np.where(done[rows[:, None], beam], -3.0, sims[rows[:, None], beam])
            best = np.argsort(-value, axis=1)[:, :4]
            who, slot = np.nonzero(value[rows[:, None], best] > -2)
            if not len(who):
                break
            node = beam[who, best[who, slot]]
            done[who, node] = True
            look(*graph.expand(who, node))
        hits = (sims >= cosine) & ~done
        while hits.any():  # widen over all within the radius
            who, node = np.nonzero(hits)
            done |= hits
            hits = np.zeros_like(hits)
            for k in range(0, len(who), 16_384):
                w, v = look(*graph.expand(who[k : k + 16_384], node[k : k + 16_384]))
                hits[w, v] = sims[w, v] >= cosine
        found = sims >= cosine
        found[rows[mine >= 0], mine[mine >= 0]] = False
        who, node = np.nonzero(found)
        out_q.append(who + at)
        out_v.append(node)
    return np.concatenate(out_q), np.concatenate(out_v)


# ---------------------------------------------------------------- shards
def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares can then neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _centres(nodes: DataFrame) -> dict:
    """(label, length) -> cluster centres, for the labels that need more than one shard."""
    counts = nodes.groupBy("label", "d").count().where(F.col("count") > SHARD).orderBy(F.desc("count"), "label").limit(CENTRES).collect()
    if not counts:
        return {}
    total, widest = sum(r["count"] for r in counts), max(r["d"] for r in counts)
    sample, most = min(SAMPLE, SAMPLE_BYTES // (8 * widest)), max(2, min(CENTRES, CENTRE_BYTES // (8 * widest)))
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total))
    wanted = {(r["label"], r["d"]): r["count"] for r in counts}
    rows = nodes.where(part).select("label", "d", "v").limit(2 * sample).toArrow()
    by: dict = {}
    for i, key in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
        if key in wanted:
            by.setdefault(key, []).append(i)
    out, left, vectors = {}, most, rows.column(2).combine_chunks()
    for key, mine in sorted(by.items(), key=lambda x: -wanted[x[0]]):
        k = min(-(-wanted[key] // SHARD), max(2, len(mine) // 8), left)
        if k >= 2:
            out[key] = kmeans(_units(matrix(vectors.take(pa.array(mine)))), k, 8, np.random.default_rng(11))
            left -= k
    return out


def shards_of(unit: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, list[list[int]]]:
    """Each vector's own shard, and the other shards in which a vector can be that has this cosine with it."""
    radius, square = np.sqrt(2 - 2 * cosine), (centres * centres).sum(axis=1)
    homes, guests = [], []
    step = max(1, 4_000_000 // len(centres))
    for at in range(0, len(unit), step):
        away = square - 2 * (unit[at : at + step] @ centres.T)  # squared distances, less the same for all of a row
        home = np.argmin(away, axis=1)
        rows = np.arange(len(home))
        apart = np.sqrt(np.maximum(square + square[home][:, None] - 2 * (centres[home] @ centres.T), 0))
        near = away - away[rows, home][:, None] <= 2 * radius * apart + 1e-6  # far more than rounding
        near[rows, home] = False
        homes.append(home)
        guests += [np.flatnonzero(x).tolist() for x in near]
    return np.concatenate(homes), guests


def _deal(nodes: DataFrame, cosine: float) -> DataFrame:
    """nodes with home, their own shard, and guest_in, the other shards they visit."""
    shared = nodes.sparkSession.sparkContext.broadcast(_centres(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            home, visits = [0] * len(keys), [[]] * len(keys)
            for key in set(keys):
                centres = shared.value.get(key)
                if centres is None:
                    continue
                mine = [i for i, k in enumerate(keys) if k == key]
                own, others = shards_of(_units(matrix(batch.column(4).take(pa.array(mine)))), centres, cosine)
                for i, h, o in zip(mine, own.tolist(), others, strict=True):
                    home[i], visits[i] = h, o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "home", "guest_in"])

    return nodes.mapInArrow(run, StructType([*nodes.schema.fields, StructField("home", IntegerType()), StructField("guest_in", ArrayType(IntegerType()))]))


class Block:
    """The vectors at home in a block of a shard: the links of each, and of the guests that come by."""

    def __init__(self, node: np.ndarray, many: np.ndarray, unit: np.ndarray, cosine: float):
        self.node, self.many, self.unit, self.cosine = node, many.astype(np.float64), unit, cosine
        self.root, self.links = np.arange(len(node)), np.zeros(len(node), dtype=np.int64)
        if len(node) > 1:
            graph = build_graph(unit)
            begin, slot = np.nonzero(graph >= 0)
            known = begin, graph[begin, slot]
            q, v = range_search(unit, Mutual(len(unit), *known), unit, self.root.copy(), known, cosine)
            if not self.complete(q):
                q, v = self.every_link()
            self.links = np.bincount(q, weights=self.many[v], minlength=len(node)).astype(np.int64)
            self.root = join_groups(self.root, q, v)

    def complete(self, q: np.ndarray) -> bool:
        """Whether as many links were found of the audited vectors, spread over the block, as there are."""
        n = len(self.unit)
        asked = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(np.int64))
        there = (self.unit[asked] @ self.unit.T >= self.cosine).sum(axis=1) - 1
        return bool((np.bincount(q, minlength=n)[asked] >= there).all())

    def every_link(self) -> tuple[np.ndarray, np.ndarray]:
        near = self.unit @ self.unit.T >= self.cosine
        np.fill_diagonal(near, False)
        return np.nonzero(near)

    def guests(self, node: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, one that it links to) of the guests that link; their links join the groups of the block."""
        near = unit @ self.unit.T >= self.cosine
        first = np.argmax(near, axis=1)
        q, v = np.nonzero(near)
        n = len(self.node)
        pairs = np.unique(v * n + first[q])
        self.root = join_groups(self.root, pairs // n, pairs % n)
        some = near.any(axis=1)
        return node[some], (near[some] @ self.many).astype(np.int64), self.node[first[some]]

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = (self.links > 0) | (self.root != np.arange(len(self.node)))
        return self.node[some], self.links[some], self.node[self.root[some]]


def _links(batches: Iterator[pa.RecordBatch], cosine: float, label_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (label, d, shard, block, own, node, many, v), a block's own before its guests -> (label, d, node, links, root)."""
    now, held, block = None, [], None

    def out(key: tuple, rows: tuple) -> pa.RecordBatch:
        n = len(rows[0])
        columns = [pa.array([key[0]] * n, label_type), pa.array([key[1]] * n, pa.int32()), *[pa.array(x) for x in rows]]
        return pa.RecordBatch.from_arrays(columns, names=["label", "d", "node", "links", "root"])

    def made() -> Block:
        rows = pa.Table.from_batches(held)
        return Block(rows.column(5).to_numpy(), rows.column(6).to_numpy(), _units(matrix(rows.column(7).combine_chunks())), cosine)

    for key, rows in runs(batches, 4):
        if key != now:
            if held:
                yield out(now, (block or made()).own())
            now, held, block = key, [], None
        own = rows.num_rows if rows.column(4)[-1].as_py() else rows.column(4).to_pylist().index(False)
        if own:
            held.append(rows.slice(0, own))
        if not held:
            continue  # nothing is at home in the block
        for at in range(own, rows.num_rows, GUESTS):
            block = block or made()
            part = rows.slice(at, GUESTS)
            yield out(key, block.guests(part.column(5).to_numpy(), _units(matrix(part.column(7)))))
    if held:
        yield out(now, (block or made()).own())


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vectors, without the vector and label, with n_links, component_id and kept."""
    vectors = replacing(vectors, "n_links", "component_id", "kept")
    id_, label, vector = named(id_col), named(label_col), named(vector_col)
    takes_part = usable(vector) & label.isNotNull() & id_.isNotNull()
    # What tells one vector of a label from others; rows find their vertex by it.
    which = F.concat_ws(":", F.xxhash64(label, vector), F.xxhash64(F.lit(1), vector, label))
    good = vectors.where(takes_part).select(id_.cast("long").alias("id"), label.alias("label"), vector.alias("v"), which.alias("which"))
    nodes = good.distinct().groupBy("label", "v", "which").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("many")).withColumn("d", F.size("v"))
    nodes = cut(nodes.select("label", "d", "node", "many", "v", "which"))
    dealt = cut(_deal(nodes.drop("which"), cosine))
    keys = ["label", "d", "shard", "block"]
    sizes = dealt.groupBy("label", "d", F.col("home").alias("shard")).count()
    large = cut(sizes.where(F.col("count") > BLOCK).select("label", "d", "shard", F.ceil(2 * F.col("count") / BLOCK).cast("int").alias("blocks")))
    visits = dealt.withColumn("shard", F.explode(F.concat(F.array("home"), "guest_in")))
    visits = visits.join(sized(large, large.count()), keys[:3], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own_block = F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int")
    own = (F.col("home") == F.col("shard")) & (own_block == F.col("block"))
    seen = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, own.alias("own"), "node", "many", "v")
    seen = seen.repartition(*keys).sortWithinPartitions(*keys, F.desc("own"), "node")
    label_type = nodes.schema["label"].dataType
    arrow_type = to_arrow_type(label_type)
    found = cut(seen.mapInArrow(lambda it: _links(it, cosine, arrow_type), f"label {label_type.simpleString()}, d int, node long, links long, root long"))
    counts = found.groupBy("label", "d", "node").agg(F.sum("links").alias("links"))
    per_node = nodes.select("label", "d", "node", "many", "which").join(counts, ["label", "d", "node"], "left")
    per_node = per_node.select(F.col("which").alias("which_"), "node", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links_"))
    comps = cut(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))).withColumnRenamed("node", "n2")
    per_node = join_unique(per_node, "node", comps, "n2", comps.count())
    per_node = cut(per_node.select("which_", "links_", F.coalesce("component", "node").alias("component_")))
    rest = [c for c in vectors.columns if c not in (vector_col, label_col)]
    names = [*[named(c) for c in rest], "links_", "component_"]
    yes = vectors.where(takes_part).select(*[named(c) for c in rest], which.alias("__which"))
    yes = join_unique(yes, "__which", per_node, "which_", per_node.count())
    no = vectors.where(~takes_part).withColumns({"links_": F.lit(0).cast("long"), "component_": id_})
    both = yes.select(*names).unionByName(no.select(*names))
    kept = F.coalesce(id_ == F.col("component_"), F.lit(False))
    return both.select(*[named(c) for c in rest], F.col("links_").cast("long").alias("n_links"), F.col("component_").alias("component_id"), kept.alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, sample: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> tuple[int, int]:
    """(links found, links there) of the `sample` vectors whose hash comes first: their counts in result, and by brute force.

    The sample is a stated query set; one pass over the table measures it against every vector.
    """
    good = vectors.where(usable(vector_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = good.select(id_col, label_col, vector_col).orderBy(F.xxhash64(id_col)).limit(sample).collect()
    if not rows:
        return 0, 0
    asked = vectors.sparkSession.sparkContext.broadcast([(r[0], r[1], np.array(r[2], dtype=np.float64)) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = 0
        for batch in batches:
            ids, labels, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()), batch.column(2).to_pylist()
            for i, label, q in asked.value:
                mine = [k for k in np.flatnonzero((labels == label) & (ids != i)) if len(x[k]) == len(q)]
                if mine:
                    unit = _units(np.array([x[k] for k in mine], dtype=np.float64))
                    there += int((unit @ _units(q[None])[0] >= cosine).sum())
        yield pa.RecordBatch.from_arrays([pa.array([there])], names=["there"])

    there = good.select(id_col, label_col, vector_col).distinct().mapInArrow(run, "there long").agg(F.sum("there")).first()[0]
    mine = result.join(F.broadcast(vectors.sparkSession.createDataFrame([(r[0],) for r in rows], "asked long")), F.col(id_col) == F.col("asked"), "left_semi")
    return int(mine.agg(F.sum("n_links")).first()[0] or 0), int(there or 0)


# ---------------------------------------------------------------- query
def op4_graph_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP4_SQL = f"""
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT a AS node, a AS seen FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.seen = link.a),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(many.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(vec_id = coalesce(component, vec_id), false) AS kept
FROM embeddings LEFT JOIN many ON vec_id = many.a LEFT JOIN comp ON vec_id = comp.node"""
