"""Set-based replay against statement by statement in SQLite."""

import sqlite3

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import apply

KIND = "k long, lsn long, op string, a string, b string, has_a boolean, has_b boolean"
change = st.tuples(st.integers(0, 4), st.sampled_from("cuud"), st.sampled_from(["x", "y", None]), st.sampled_from(["p", None]), st.booleans(), st.booleans())


def sequential(base, log):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, a TEXT, b TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", base)
    for k, _, op, a, b, has_a, has_b in log:
        if op == "c":
            db.execute("INSERT OR REPLACE INTO t VALUES (?, ?, ?)", (k, a if has_a else None, b if has_b else None))
        elif op == "d":
            db.execute("DELETE FROM t WHERE k = ?", (k,))
        else:
            for name, v, has in (("a", a, has_a), ("b", b, has_b)):
                if has:
                    db.execute(f"UPDATE t SET {name} = ? WHERE k = ?", (v, k))
    return sorted(db.execute("SELECT * FROM t").fetchall())


def declared(spark, base, log):
    rows = spark.createDataFrame(log, KIND)
    out = apply.replay_onto(spark.createDataFrame(base, "k long, a string, b string"), rows, ["k"], ["lsn"], ["a", "b"], present={"a": F.col("has_a"), "b": F.col("has_b")})
    return sorted(tuple(r) for r in out.select("k", "a", "b").collect())


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(change, max_size=25), st.sets(st.integers(0, 5)))
def test_replay_equals_statements(spark, moves, keys):
    base = [(k, f"a{k}", f"b{k}") for k in sorted(keys)]
    log = [(k, i, op, a, b, ha, hb) for i, (k, op, a, b, ha, hb) in enumerate(moves)]
    once = declared(spark, base, log)
    assert once == sequential(base, log)
    # Split anywhere, applied in two steps: the same.
    half = len(log) // 2
    assert declared(spark, declared(spark, base, log[:half]), log[half:]) == once


def test_full_images_and_barrier(spark):
    log = spark.createDataFrame([(1, 1, "c", "x"), (2, 2, "u", "y"), (3, 3, "c", "z"), (1, 4, "d", None), (1, 5, "c", "w")], "k long, lsn long, op string, v string").withColumn("after", F.struct("v"))
    out = lambda b=None: sorted(tuple(r) for r in apply.replay(log, ["k"], ["lsn"], ["v"], b).collect())
    assert out() == [(1, "w", 5), (3, "z", 3)]
    assert out(F.struct(F.lit(3).cast("long").alias("lsn"))) == [(1, "w", 5)]


def test_null_keys_match_only_in_full_identity(spark):
    base = spark.createDataFrame([(None, "old")], "k long, v string")
    log = spark.createDataFrame([(None, 1, "u", "new")], "k long, lsn long, op string, v string")
    plain = apply.replay_onto(base, log, ["k"], ["lsn"], ["v"])
    full = apply.replay_onto(base, log, ["k"], ["lsn"], ["v"], null_safe=True)
    assert [tuple(r) for r in plain.collect()] == [(None, "old")]
    assert [tuple(r) for r in full.collect()] == [(None, "new")]


def test_truncations(spark):
    log = spark.createDataFrame([(1, "t", ["public.a", "b"]), (5, "t", ["public.a"]), (6, "u", None)], "lsn long, event string, tables array<string>")
    assert sorted(tuple(r) for r in apply.truncations(log).collect()) == [("public", "a", 5), ("public", "b", 1)]


def test_rows_without_a_key(spark):
    moves = [("c", "a", "x", None, None), ("c", "a", "x", None, None), ("u", "a", "y", "a", "x"), ("c", "b", None, None, None), ("u", "b", "z", "b", None), ("d", None, None, "a", "y"), ("c", "a", "q", None, None), ("d", None, None, "b", "none such")]
    base = [("b", None), ("c", "k"), ("c", "k")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (g TEXT, v TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", base)
    for op, g, v, old_g, old_v in moves:
        if op == "c":
            db.execute("INSERT INTO t VALUES (?, ?)", (g, v))
        elif op == "u":
            db.execute("UPDATE t SET g = ?, v = ? WHERE g IS ? AND v IS ?", (g, v, old_g, old_v))
        else:
            db.execute("DELETE FROM t WHERE g IS ? AND v IS ?", (old_g, old_v))
    want = sorted(db.execute("SELECT * FROM t").fetchall(), key=repr)
    log = spark.createDataFrame([(m[0], i, *m[1:]) for i, m in enumerate(moves)], "op string, lsn long, g string, v string, old_g string, old_v string")
    for by in (["g"], []):
        out = apply.replay_rows(spark.createDataFrame(base, "g string, v string"), log, ["g", "v"], ["lsn"], by)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == want
