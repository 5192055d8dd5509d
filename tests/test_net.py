"""A batch's net effect is what its changes do one by one."""

import random
import sqlite3

import pytest

from tidemark.functions.dialects import SQLITE
from tidemark.operators.net import can_fold
from tidemark.schema import CHANGELOG
from tidemark.sinks.sql import SqlSink
from tidemark.sinks.sqlite import SqliteConnection

TABLE = "CREATE TABLE t (id TEXT PRIMARY KEY ON CONFLICT REPLACE, a TEXT, b TEXT)"


def change(lsn, event, before=None, after=None, identity="default", keys=("id",), tables=None):
    image = lambda d: None if d is None else [(n, "null" if v is None else "text", None if v is None else v.encode()) for n, v in d.items()]
    return (lsn, 0, lsn // 5, None, lsn // 5 * 5 + 4, None, event, "s", "t", None, identity, list(keys), image(before), image(after), tables)


def some_changes():
    pick, out = random.Random(7), []
    for lsn in range(1, 600):
        row = {"id": f"k'{pick.randrange(25)}", "a": pick.choice([None, "1", "x;y"]), "b": str(lsn)}
        event = pick.choice("ccduuuu")
        part = {c: row[c] for c in ("id", *pick.sample(["a", "b"], pick.choice([1, 2])))}
        out.append(change(lsn, event, None if event == "c" or pick.random() < 0.3 and event != "d" else row, {"c": row, "u": part, "d": None}[event]))
    return out


@pytest.mark.parametrize("batch_size", [0, 3])
def test_net_is_one_by_one(spark, tmp_path, batch_size):
    log, found, runs = spark.createDataFrame(some_changes(), CHANGELOG), [], []
    assert can_fold(log)
    for net in (False, True):
        path = str(tmp_path / f"{net}.db")
        db = sqlite3.connect(path)
        db.executescript(TABLE + ";INSERT INTO t VALUES ('k''1', 'old', 'old'), ('k''24', 'old', 'old'), ('other', 'old', 'old')")
        sink = SqlSink(SqliteConnection(path), SQLITE, batch_size=batch_size, net=net)
        run, done = sink.connection.execute, []
        sink.connection.execute = lambda sql, run=run, done=done: (done.append(sql), run(sql))
        sink.write(log, 0)
        found.append((sorted(db.execute("SELECT * FROM t").fetchall(), key=repr), sink.applied()))
        runs.append(len(done))
    assert found[0] == found[1]
    assert runs[1] < runs[0] / 3


def test_what_cannot_be_folded(spark):
    fold = lambda *rows: can_fold(spark.createDataFrame(list(rows), CHANGELOG))
    a, b = {"id": "1", "a": "x"}, {"id": "2", "a": "x"}
    assert fold(change(1, "c", None, a), change(2, "u", a, a), change(3, "u", None, a), change(4, "d", a))
    assert not fold(change(1, "u", a, b))
    assert not fold(change(1, "u", a, {"a": "y"}))
    assert not fold(change(1, "c", None, {"a": "x"}))
    assert not fold(change(1, "c", None, a), change(2, "c", None, b, keys=("a",)))
    assert not fold(change(1, "d", a, identity="full"))
    assert not fold(change(1, "c", None, a), change(2, "t", tables=["s.t"]))
    assert not fold(change(1, "d", {"id": None, "a": "x"}))
