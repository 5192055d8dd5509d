"""SimHash fingerprints, BK-trees, links and groups, against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import simhash as S
from tidemark.llm.components import connected_components


def slow_fingerprint(text, shingle):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB \n\té\x0b\x1c", max_size=60), st.integers(1, 5))
def test_fingerprint(text, shingle):
    assert S.fingerprint(text, shingle) == slow_fingerprint(text, shingle)


def test_fingerprint_cases():
    assert S.fingerprint(None) == S.fingerprint("") == S.fingerprint(" \n") == 0
    assert S.fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42)
    long = " ".join(str(i % 977) for i in range(60_000))
    assert S.fingerprint(long) == slow_fingerprint(long, 4)


def groups_of(values, radius):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (int(values[i]) ^ int(values[j])).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def near_values(rng, n, groups):
    centres = rng.integers(0, 2**63, size=groups, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, size=rng.integers(0, 5)).astype(np.uint64), initial=np.uint64(0)) for _ in range(n)], dtype=np.uint64)
    return np.unique(centres[rng.integers(0, groups, size=n)] ^ flips)


def test_bk_search_finds_all_and_only_near():
    rng = np.random.default_rng(0)
    values = near_values(rng, 300, 40)
    shard = rng.integers(0, 3, size=len(values))
    forest = S.BKForest(values, shard)
    for v, p, e in zip(values, forest.parent, forest.edge, strict=True):
        assert p < 0 or (int(v) ^ int(values[p])).bit_count() == e  # a child hangs by its distance
    q, node = forest.within(values, shard, 4)
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if shard[i] == shard[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 4}
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == want and len(q) == len(want)


def test_long_texts_are_read_in_slices(monkeypatch):
    text = " ".join(f"w{i * i % 101}" for i in range(500)) + " \n" + "x" * 300 + "  end"
    whole = [S.shingle_hashes(text, n).tolist() for n in (1, 4, 600)]
    monkeypatch.setattr(S, "SLICE", 64)
    assert [S.shingle_hashes(text, n).tolist() for n in (1, 4, 600)] == whole
    assert S.fingerprint(text, 4) == slow_fingerprint(text, 4)


@pytest.mark.parametrize(("tree_size", "leaders", "most"), [(10, 4, 1 << 24), (10, 1, 200), (40, 64, 1 << 24), (4096, 64, 1 << 24)])
def test_links_over_shards_and_split_trees(spark, monkeypatch, tree_size, leaders, most):
    monkeypatch.setattr(S, "TREE_SIZE", tree_size)
    monkeypatch.setattr(S, "LEADERS", leaders)
    monkeypatch.setattr(S, "BROADCAST_BYTES", most)
    values = np.unique(np.concatenate([near_values(np.random.default_rng(3), 400, 25), near_values(np.random.default_rng(4), 300, 1)]))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = [(r.a, r.b) for r in S.fingerprint_links(frame).collect()]
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    label = list(range(len(values)))
    for a, b in links:
        assert (a ^ b) != 0
        x, y = label[place[a]], label[place[b]]
        label = [min(x, y) if z in (x, y) else z for z in label]
    same = groups_of(values, 4)
    assert [label.index(x) for x in label] == [same.index(x) for x in same]


@pytest.mark.parametrize("m", [5, 6, 7, 8])
def test_near_values_share_a_shard_at_any_number_of_blocks(spark, m):
    values = near_values(np.random.default_rng(m), 60, 4)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    import pyspark.sql.functions as F

    keys = {r.fp: {tuple(k) for k in r.k} for r in frame.select("fp", S.shard_keys(F.col("fp"), m).alias("k")).collect()}
    for a in keys:
        for b in keys:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                assert keys[a] & keys[b]


def test_blocks_grow_with_the_corpus():
    assert [S.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**12, 10**15)] == [5, 6, 6, 7, 8, 8]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (90, 100), (100, 100), (7, 3), (55, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(31), 0) | {90: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


BASE = " ".join(f"word{i}" for i in range(200))
DOCS = [
    (1, BASE, "x"), (2, BASE, "y"), (3, BASE.upper(), None), (4, BASE.replace("word100 ", "other "), "z"), (5, None, "n"), (6, "", "e"), (7, " \n ", None),
    (8, "clean text of its own", "c"), (9, "clean text of their own", "c"), (None, BASE, "null id"), (None, "no id and alone", "q"), (None, "no id and alone", "q"), (8, "clean text of its own", "c"),
]


def test_groups(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, component_id string")
    out = [(r.doc_id, r.component_id) for r in S.group_near_duplicates(docs).collect()]
    assert len(out) == len(DOCS)
    by = dict(x for x in out if x[0] is not None)
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == by[7] == 5 and by[8] == 8 and by[9] == 9
    assert sorted(c for d, c in out if d is None and c is not None) == [1] and sum(c is None for _, c in out) == 2
    assert S.group_near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: slow_fingerprint(r.text, 4) for r in rows}
    ids = sorted(prints)
    label = groups_of(np.array([prints[i] for i in ids], dtype=np.uint64), 4)
    want = {i: (f"{prints[i]:016x}", ids[k]) for i, k in zip(ids, label, strict=True)}
    out = S.op6_simhash_near_dedup(spark, sf_dir).collect()
    assert len(out) == len(rows) and {r.doc_id: (r.fingerprint, r.component_id) for r in out} == want


def test_texts_under_one_id_are_apart(spark):
    rows = [(1, "one text about the sea and ships", {"a": 1}, "x"), (1, "another that speaks of hills and goats", {"a": 2}, "y"), (1, "ONE text  about the sea and ships", {"b": 3}, "z"),
            (2, "another that speaks of hills and goats", None, "w"), (3, "a third", {}, None), (None, "a third", {}, "n"), (None, "only here", None, "n"), (None, "only here", None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `odd.name` string")
    kept = S.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.schema["m"].dataType == docs.schema["m"].dataType
    got = sorted(((r.doc_id or 0), r.text, r["odd.name"]) for r in kept.collect())
    assert got == [(0, "only here", "m"), (1, "ONE text  about the sea and ships", "z"), (1, "another that speaks of hills and goats", "y"), (3, "a third", None)]


def test_keeping_one_of_each(spark):
    docs = spark.createDataFrame([(d, t, "l", "s", 1) for d, t, _ in DOCS], "doc_id long, text string, lang string, fp string, n_chars long")
    kept = S.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "no id and alone"), (1, BASE), (5, None), (8, "clean text of its own"), (9, "clean text of their own")]
    assert S.keep_one_each(docs.limit(0)).count() == 0


def changed(words, share, rng):
    return " ".join(f"new{rng.integers(10**9)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("tree_size", [8, 1024])
def test_similar_groups_against_jaccard(spark, monkeypatch, tree_size):
    monkeypatch.setattr(S, "TREE_SIZE", tree_size)
    rng = np.random.default_rng(5)
    texts = []
    for g in range(40):
        words = [f"w{g}x{i}" for i in range(int(rng.integers(20, 400)))]
        texts += [changed(words, s, rng) for s in (0, 0, 0.005, 0.01, 0.02, 0.02, 0.025, 0.3)]
    words = [f"hot{i}" for i in range(200)]
    texts += [changed(words, 0.01, rng) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.group_similar(docs).collect()}
    sets = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(both := sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(both)):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert got == dict(enumerate(label))


def test_texts_that_share_a_repeated_line_only_stay(spark):
    line = " ".join(f"line{i}" for i in range(21)) + " "
    own = [" ".join(f"own{d}x{i}" for i in range(500)) for d in range(3)]
    texts = [line * 150 + t for t in own] + [own[0], own[1]]
    near = own[0].replace("own0x250 ", "other ")
    texts += [line * 150 + near, line * 3 + own[2]]
    assert S.fingerprint(texts[0], 5) == S.fingerprint(texts[1], 5)  # which counts repeats
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.group_similar(docs).collect()}
    assert got == {0: 0, 3: 0, 5: 0, 1: 1, 4: 1, 2: 2, 6: 2}
    assert sorted(r.doc_id for r in S.keep_one_each(docs).collect()) == [0, 1, 2]
