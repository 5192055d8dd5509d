"""Mixing: targets, whole copies, thresholds."""

import duckdb
import pytest

from tidemark.llm import mixing as M

KIND = "doc_id long, text string, source string"


def words(n):
    return " ".join(["w"] * n) or ""


def against_sql(spark, rows):
    docs = spark.createDataFrame(rows, KIND)
    got = sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in M.mix(docs).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted(((d, s, z, t, k) for d, s, z, t, k in con.execute(M.OP9_SQL).fetchall()), key=repr)
    assert got == want
    return got


def test_against_sql_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 7)
    rows = [(i, words(i * 7 % 23), "abcd"[i * i % 4]) for i in range(120)]
    rows += [(None, words(5), "a"), (None, None, "b"), (500, None, None), (501, words(40), None), (502, "", "empty"), (3, words(21), "a"), (3, words(21), "a"), (503, words(3000), "c")]
    out = against_sql(spark, rows)
    assert len(out) == len(rows)
    by = {}
    for (_, size, _, target, taken), _ in zip(out, out, strict=True):
        assert taken <= 3 * size and (size == 0 or taken % size == 0)
        by.setdefault(target, 0)
        by[target] += taken


def test_sources_come_near_their_targets(spark):
    rows = [(i, words(10 + i % 40), f"s{i % 6}") for i in range(1200)]
    got = {}
    for r in M.mix(spark.createDataFrame(rows, KIND)).collect():
        t, k = got.get(r.source, (r.target, 0))
        got[r.source] = (t, k + r.taken)
    assert abs(sum(t for t, _ in got.values()) - sum(10 + i % 40 for i in range(1200))) < 1e-6
    for target, taken in got.values():
        assert abs(taken - target) <= 25


def test_targets_by_water_filling(spark):
    def slow(sizes):
        names = sorted(sizes, key=lambda x: (x is None, x))
        weight = {n: i % 3 + 1 for i, n in enumerate(names)}
        total, full = sum(sizes.values()), set()
        while True:
            left, w = total - sum(3 * sizes[n] for n in full), sum(weight[n] for n in names if n not in full)
            more = {n for n in names if n not in full and weight[n] * left > 3 * sizes[n] * w}
            if not more:
                return {n: 3 * sizes[n] if n in full else weight[n] * left / w for n in names}
            full |= more

    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 10, "c": 1, None: 5}, {"a": 7}, {"é": 5, "z": 50, "Z": 1, "": 3}, {"a": 0, "b": 9}):
        rows = spark.createDataFrame([(n, s) for n, s in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in M.targets(rows).collect()}
        assert got == pytest.approx(slow(sizes))


def test_whole_copies_are_certain_and_reruns_agree(spark):
    rows = [(i, words(10), "a") for i in range(90)] + [(100 + i, words(10), "b") for i in range(10)]
    docs = spark.createDataFrame(rows, KIND)
    first = {r.doc_id: r.copies for r in M.mix(docs).collect()}
    assert {c for d, c in first.items() if d >= 100} == {3}  # at the limit
    again = {r.doc_id: r.copies for r in M.mix(docs.repartition(5)).collect()}
    assert first == again
    mixed = M.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(first.values())


def test_weights_make_inclusion_unequal(spark):
    rows = [(i, words(10), "a", 4.0 if i % 2 else 1.0) for i in range(400)] + [(1000 + i, words(10), "b", 1.0) for i in range(400)]
    out = M.mix(spark.createDataFrame(rows, KIND + ", w double"), weight_col="w").where("source = 'a'").collect()
    heavy, light = (sum(r.copies for r in out if r.w == w) for w in (4.0, 1.0))
    assert heavy > 2.5 * light and abs(sum(r.taken for r in out) - out[0].target) <= 10


def test_empty_and_clashing(spark):
    assert M.mix(spark.createDataFrame([], KIND)).count() == 0
    docs = spark.createDataFrame([(1, "a b", "s", 9, "x")], KIND + ", size int, `odd.name` string")
    out = M.mix(docs)
    assert out.columns.count("size") == 1 and out.first()["size"] == 2 and out.first()["odd.name"] == "x"
