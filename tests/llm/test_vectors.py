"""Nearest neighbours and embedding near-duplicates against brute force."""

import numpy as np
import pytest

from tidemark.llm import additive as A
from tidemark.llm import graph as G

NAN, INF = float("nan"), float("inf")


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def clustered(rng, n, d=16):
    centres = rng.normal(size=(n // 10, d))
    x = centres[rng.integers(0, len(centres), size=n)] + rng.choice([0.02, 0.15, 1.0], size=(n, 1)) * rng.normal(size=(n, d))
    return x.astype(np.float32).astype(float)


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [NAN] + [1.0] * 15, 1), (9004, [INF] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1), (9006, [1.0, 2.0], 1), (None, [1.0] * 16, 1), (9008, [], 1)]


def test_search_is_exact(spark):
    x = clustered(np.random.default_rng(1), 700)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9000, x[0].tolist(), None), *ODD]
    out = A.search(table_of(spark, rows), A.F.col("id") % 50 == 0).collect()
    ids = np.array([*range(700), 9000])
    all_x = np.vstack([x, x[:1]])
    for q in [*range(0, 700, 50), 9000]:
        d = np.sqrt(((all_x - all_x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:10]
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [g[1] for g in got] == ids[order].tolist() and [g[0] for g in got] == list(range(1, 11))
        assert np.allclose([g[2] for g in got], d[order], rtol=1e-12)
    assert {r.query_id for r in out} == {*range(0, 700, 50), 9000}


def test_search_in_blocks_of_queries(spark, monkeypatch):
    x = clustered(np.random.default_rng(2), 60)
    frame = table_of(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    one = sorted(map(tuple, A.search(frame, A.F.col("id") % 5 == 0, k=3).collect()))
    monkeypatch.setattr(A, "QUERY_BYTES", 3 * 16 * 8)
    out = A.search(frame, A.F.col("id") % 5 == 0, k=3)
    assert out.count() == 12 * 3 and sorted(map(tuple, out.collect())) == one


def test_many_queries_at_a_time(monkeypatch):
    x = clustered(np.random.default_rng(5), 200)
    model = A.train(x, books=4, words=16)
    codes = model.encode(x)
    near = model.decode(codes)
    pa = A.pa
    columns = [pa.array(np.arange(200)), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((near * near).sum(axis=1)), pa.array(np.sqrt(((x - near) ** 2).sum(axis=1)))]
    batch = pa.RecordBatch.from_arrays(columns, names=["id", "v", "codes", "norm", "error"])
    found = []
    for at_once, rows in ((2048, 2048), (7, 30)):
        monkeypatch.setattr(A, "AT_ONCE", at_once)
        monkeypatch.setattr(A, "ROWS", rows)
        out = pa.Table.from_batches(A._scan(iter([batch]), np.arange(50), x[:50], model.books, 5))
        found.append(sorted(zip(*[c.to_pylist() for c in out.columns], strict=True)))
    assert found[0] == found[1] and len(found[0]) == 250


def test_lengths_are_searched_apart(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(6)] + [(10 + i, [float(i), 2.0, 1.0], 0) for i in range(4)]
    frame = table_of(spark, rows).withColumnRenamed("embedding", "the.vector")
    out = sorted((r.query_id, r["rank"], r.vec_id) for r in A.search(frame, A.F.col("id") % 10 == 0, vector_col="the.vector", k=2).collect())
    assert out == [(0, 1, 1), (0, 2, 2), (10, 1, 11), (10, 2, 12)]


def test_few_candidates_and_none(spark):
    few = table_of(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1)])
    assert sorted((r.query_id, r.rank, r.vec_id) for r in A.search(few, A.F.col("id") == 0).collect()) == [(0, 1, 2), (0, 2, 1)]
    assert A.search(few.limit(0), A.F.col("id") == 0).count() == 0
    assert A.search(table_of(spark, ODD[:5]), A.F.col("id") > 0).count() == 0


def test_codes_carry_most_of_a_vector():
    x = np.random.default_rng(3).normal(size=(1500, 16))
    model = A.train(x, books=16, words=32)
    gap = lambda codes: ((x - model.decode(codes)) ** 2).sum() / (x**2).sum()
    wide, narrow = gap(model.encode(x, beam=8)), gap(model.encode(x, beam=1))
    assert wide < 0.1 and wide <= narrow


def slow_links(rows):
    good = [(i, np.array(v, dtype=float), l) for i, v, l in rows if i is not None and l is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i, _, _ in good}
    for a, (i, v, l) in enumerate(good):
        for j, w, m in good[:a]:
            if i != j and l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= G.COSINE:
                links[i].add(j)
                links[j].add(i)
    label = {i: i for i in links}
    for i in links:
        for j in links[i]:
            a, b = label[i], label[j]
            if a != b:
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return {i: (len(links[i]), label[i]) for i in links}


@pytest.mark.parametrize(("shard", "block"), [(256, 2048), (30, 2048), (30, 40)])
def test_links_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(G, "SHARD", shard)
    monkeypatch.setattr(G, "BLOCK", block)
    x = clustered(np.random.default_rng(4), 400)
    rows = [(i, v.tolist(), i % 2 if i % 50 else None) for i, v in enumerate(x)]
    rows += [(1000, x[1].tolist(), 1), (1001, x[1].tolist(), 1), (1001, x[1].tolist(), 1), (1002, (3 * x[1]).tolist(), 1), *ODD]
    frame = table_of(spark, rows)
    out = G.link_vectors(frame).collect()
    assert len(out) == len(rows)
    want, links, found = slow_links([(i, np.float32(v).tolist() if v and None not in v else v, l) for i, v, l in rows]), 0, 0
    for r in out:
        if r.vec_id in want:
            links, found = links + want[r.vec_id][0], found + r.n_links
            assert r.n_links <= want[r.vec_id][0]
        else:
            assert (r.n_links, r.component_id) == (0, r.vec_id)
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    assert found == links and {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id in want} == want


def test_a_block_with_a_missed_link_is_searched_again(monkeypatch):
    x = clustered(np.random.default_rng(11), 300)
    unit = G._units(x)
    none = np.empty(0, dtype=np.int64)
    monkeypatch.setattr(G, "range_search", lambda *_: (none, none))
    block = G.Block(np.arange(300), np.ones(300), unit, G.COSINE)
    near = unit @ unit.T >= G.COSINE
    np.fill_diagonal(near, False)
    assert near.any() and block.links.tolist() == near.sum(axis=1).tolist()


def test_sql_on_planted_links(spark, monkeypatch):
    """The query's SQL, over clusters, a vector that a third of all rows hold, several shards and blocks."""
    import duckdb

    monkeypatch.setattr(G, "SHARD", 40)
    monkeypatch.setattr(G, "BLOCK", 60)
    import tidemark.llm.grouping as H

    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(H, "LEAST_HOT", 20)
    x = clustered(np.random.default_rng(12), 300)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist(), 0) for i in range(150)] + [(7, x[7].tolist(), 1), *ODD[:5]]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in rows])
    want = sorted(con.execute(G.OP4_SQL).fetchall(), key=repr)
    out = G.link_vectors(table_of(spark, rows))
    assert sorted((tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr) == want
    assert sum(r[1] > 100 for r in want) >= 150 and len({r[2] for r in want}) > 20


@pytest.mark.parametrize("block", [2048, 80])
def test_every_link_of_a_group_larger_than_a_shard(spark, monkeypatch, block):
    monkeypatch.setattr(G, "SHARD", 32)
    monkeypatch.setattr(G, "BLOCK", block)
    rng = np.random.default_rng(8)
    tight = rng.normal(size=16) + 0.2 * rng.normal(size=(300, 16))  # mean cosine about 0.96, some pairs below 0.93
    x = np.vstack([tight, rng.normal(size=(600, 16))]).astype(np.float32)
    unit = G._units(x.astype(float))
    near = unit @ unit.T >= G.COSINE
    np.fill_diagonal(near, False)
    assert near[:300].sum() > 30_000
    got = {r.vec_id: r.n_links for r in G.link_vectors(table_of(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()}
    assert [got[i] for i in range(len(x))] == near.sum(axis=1).tolist()


def test_shards_that_can_hold_a_link_are_visited():
    rng = np.random.default_rng(9)
    unit = G._units(np.vstack([rng.normal(size=8) + 0.3 * rng.normal(size=(200, 8)), rng.normal(size=(400, 8))]))
    home, guest_in = G.shards_of(unit, G.kmeans(unit, 20, 8, rng), G.COSINE)
    for a, b in zip(*np.nonzero(unit @ unit.T >= G.COSINE), strict=True):
        assert home[a] == home[b] or home[b] in guest_in[a]


def test_audit_and_empty(spark):
    x = clustered(np.random.default_rng(6), 200)
    frame = table_of(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])
    found, there = G.audit(frame, G.link_vectors(frame), sample=50)
    assert there > 0 and found >= 0.9 * there
    none = G.link_vectors(frame.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "n_links", "component_id", "kept"]
    clash = frame.withColumn("kept", G.F.lit("x")).withColumn("other", G.F.lit(1))
    assert G.link_vectors(clash).columns == ["vec_id", "other", "n_links", "component_id", "kept"]


def test_robust_prune_keeps_the_near_and_the_diverse():
    unit = G._units(np.array([[1, 0], [0.99, 0.02], [0.99, 0.021], [0.9, -0.5]], dtype=float))
    kept = G.robust_prune(unit @ unit.T, np.array([[1, 2, 3]]), 2)
    assert kept.tolist() == [[1, 3]]
