"""Sources, streams and sinks on real files."""

import gzip
import json
import sqlite3
import urllib.error
import urllib.request
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.errors import DataError, SinkError, UnsupportedError
from tidemark.operators import assemble, envelope, resume
from tidemark.schema import CHANGELOG
from tidemark.sinks import spool as spool_out
from tidemark.sinks.kafka import KafkaSink
from tidemark.sinks.sqlite import SqliteSink
from tidemark.sources import spool
from tidemark.sources.wal import read_log, slot_status
from tidemark.streaming.assemble import committed, start
from tidemark.streaming.listener import Metrics, serve

AT = datetime(2024, 1, 15, 10)


def text(**columns):
    return [(k, "null" if v is None else "text", None if v is None else str(v).encode()) for k, v in columns.items()]


def row(lsn, event, tx, sub=None, before=None, after=None, tables=None, identity="default", commit_lsn=None):
    return (lsn, 0, tx, sub, commit_lsn, AT if event in ("commit", "stream_commit") or commit_lsn else None, event, "public", "users", None, identity, ["id"], before, after, tables)


LOG = [
    row(1, "begin", 1), row(2, "c", 1, after=text(id=1, name="a")), row(3, "c", 1, after=text(id=2, name="it's")), row(4, "commit", 1),
    row(5, "stream_start", 2), row(6, "c", 2, 20, after=text(id=3, name="s")), row(7, "c", 2, 21, after=text(id=4, name="gone")), row(8, "stream_stop", 2),
    row(9, "begin", 3), row(10, "u", 3, before=text(id=1), after=text(id=1, name="b")), row(11, "d", 3, before=text(id=2)), row(12, "commit", 3),
    row(13, "stream_abort", 2, 21), row(14, "stream_commit", 2),
    row(15, "begin", 4), row(16, "c", 4, after=text(id=9, name="aborted")), row(17, "stream_abort", 4),
    row(18, "begin", 5), row(19, "c", 5, after=text(id=8, name="open")),
]
WANT = [(1, "b"), (3, "s")]


def write_lines(path, rows, spark):
    """One file of the log, as an outside writer would put it there."""
    made = spark.createDataFrame(rows, CHANGELOG).toJSON().collect()
    path.write_text("\n".join(made) + "\n\n")


def users(path):
    db = sqlite3.connect(path)
    return sorted(db.execute("SELECT id, name FROM users").fetchall())


def new_db(path):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY ON CONFLICT REPLACE, name TEXT)")
    db.commit()
    db.close()
    return str(path)


def run(spark, folder, db, checkpoint):
    sink = SqliteSink(db)
    query = start(spool.stream_events(spark, str(folder)), sink, str(checkpoint), once=True)
    query.awaitTermination()
    state = sink.applied()
    sink.close()
    return state


@pytest.mark.parametrize("cuts", [[], [4], [2, 7, 12], [6, 10, 13]])
def test_interrupted_streams_end_like_a_clean_pass(spark, tmp_path, cuts):
    folder, db = tmp_path / "in", new_db(tmp_path / "t.db")
    folder.mkdir()
    edges = [0, *cuts, len(LOG)]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        write_lines(folder / f"{i}.json", LOG[a:b], spark)
        run(spark, folder, db, tmp_path / "cp")  # stops and starts again from the checkpoint
    assert users(db) == WANT


def test_batches_apply_once(spark, tmp_path):
    db = new_db(tmp_path / "t.db")
    rows = spark.createDataFrame([row(2, "c", 1, after=text(id=1, name="a"), commit_lsn=4), row(6, "t", 2, tables=["public.users", "public.users"], commit_lsn=8), row(7, "c", 2, after=text(id=5, name="z"), commit_lsn=8)], CHANGELOG)
    sink, hooks = SqliteSink(db), []
    for n in (0, 0, 1):
        sink.write(rows, n, lambda: hooks.append(1))
    assert users(db) == [(5, "z")] and len(hooks) == 2 and sink.applied() == (1, 8)
    bad = spark.createDataFrame([row(9, "c", 3, after=text(id=6, name="q"), commit_lsn=9), row(10, "c", 3, after=text(no_such="x"), commit_lsn=9)], CHANGELOG)
    with pytest.raises(SinkError):
        sink.write(bad, 2)
    with pytest.raises(RuntimeError):
        sink.write(spark.createDataFrame([row(11, "c", 4, after=text(id=7, name="h"), commit_lsn=11)], CHANGELOG), 3, lambda: (_ for _ in ()).throw(RuntimeError("hook")))
    assert users(db) == [(5, "z")] and sink.applied() == (1, 8)


def test_committed_positions(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_lines(folder / "a.json", LOG, spark)
    query = committed(spool.stream_events(spark, str(folder))).writeStream.format("memory").queryName("done").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.lsn, r.tx_id, r.commit_lsn, r.commit_ts) for r in spark.table("done").collect())
    assert got == [(2, 1, 4, AT), (3, 1, 4, AT), (6, 2, 14, AT), (10, 3, 12, AT), (11, 3, 12, AT)]


def test_log_source(spark, tmp_path):
    acks = tmp_path / "acks"
    query = read_log(spark, "tests.log_transport:ListTransport", acks=str(acks)).writeStream.format("memory").queryName("wal").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [r.event for r in spark.table("wal").orderBy("lsn").collect()] == ["begin", "c", "c", "commit"]
    with pytest.raises(Exception, match="slot's name"):
        slot_status(spark, "jdbc:x", "Bad Name")


def test_owners_over_spans(spark):
    rows = [(1, "u", None), (2, "stream_start", 5), (3, "u", None), (4, "begin", 9), (5, "u", None), (6, "begin", 10), (7, "u", None), (8, "commit", None), (9, "u", None), (10, "stream_stop", None), (11, "u", None)]
    log = spark.createDataFrame(rows, "lsn long, event string, tx_id long")
    for span in (1, 3, 100):
        got = {r.lsn: r.owner for r in assemble.owners(log, span=span).collect()}
        assert [got[i] for i in (1, 3, 5, 7, 9, 11)] == [None, 5, 9, 10, 5, None]


def test_resume_truth_table(spark):
    cases = [(100, "found", 500), (900, "found", 500), (500, "found", 500), (None, "found", 500), (700, "found", None), (5, "absent", None), (None, "absent", None), (5, "failed", None), (None, "failed", None)]
    rows = spark.createDataFrame(cases, "disk long, state string, confirmed long").select(resume.resume_decision(F.col("disk"), F.col("state"), F.col("confirmed")).alias("r")).collect()
    assert [tuple(r.r) for r in rows] == [
        (500, 500, "slot"), (500, 900, "slot"), (500, 500, "slot"), (500, 500, "slot"), (None, 700, "slot"),
        (None, 5, "slot_deleted_fallback"), (None, 0, "fresh"), (None, 5, "query_failed_fallback"), (None, 0, "fresh"),
    ]


def test_spool_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f" INSERT {i} 'a;b' ;") for i in range(2500)], "n int, statement string")
    for name, compress in (("plain", False), ("packed", True)):
        spool_out.write_statements(rows.coalesce(1), str(tmp_path / name), compress=compress, rows_per_segment=1000)
        back = spool.read_statements(spark, str(tmp_path / name))
        assert back.count() == 2500 and back.select("file").distinct().count() == 3
        assert back.agg(F.max("pos")).first()[0] == 999
    assert spool.read_statements(spark, str(tmp_path / "plain"), start=999).count() == 2
    (tmp_path / "two.sql.gz").write_bytes(gzip.compress(b"a;\nb;\n") + gzip.compress(b"c;\n"))
    assert [r.statement for r in spool.read_statements(spark, str(tmp_path / "two.sql.gz")).orderBy("pos").collect()] == ["a", "b", "c"]
    with pytest.raises(DataError):
        spool_out.write_statements(rows.limit(0), str(tmp_path / "none"), compress=True)
    points = spool_out.sync_points(rows.withColumn("g", F.lit(1)), ["g"], "n").orderBy("statement_index").collect()
    assert [p.statement_index for p in points] == [0, 1000, 2000] and points[0].byte_offset == 0
    found = spool.sync_point(spark.createDataFrame([(0, 0), (1000, 55)], "statement_index long, byte_offset long"), spark.createDataFrame([(0,), (999,), (1000,), (5000,)], "target long"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, 0), (999, 0, 0), (1000, 1000, 55), (5000, 1000, 55)]


def test_event_files(spark, tmp_path):
    spool_out.write_events(spark.createDataFrame(LOG, CHANGELOG), str(tmp_path / "log"), compress=True)
    assert spool.read_events(spark, str(tmp_path / "log")).count() == len(LOG)
    (tmp_path / "bad.json").write_text('{"lsn": 1}\n{"lsn": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        spool.read_events(spark, str(tmp_path / "bad.json")).collect()


def test_pending_order(spark, tmp_path):
    lines = [{"tx_id": 3, "commit_lsn": None}, {"tx_id": 2, "commit_lsn": 9}, {"tx_id": 1, "commit_lsn": 9}, {"tx_id": 4, "commit_lsn": 5}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, lines)))
    assert [r.tx_id for r in spool.read_pending(spark, str(tmp_path / "p.json")).collect()] == [4, 1, 2, 3]


def test_position(spark, tmp_path):
    assert spool.load_position(spark, str(tmp_path)) is None
    for lsn in (5, 9):
        spool_out.save_position(spark, str(tmp_path), lsn, last_tx=2)
        assert spool.load_position(spark, str(tmp_path))["flush_lsn"] == lsn
    (tmp_path / spool_out.POSITION).write_text("{")
    (tmp_path / f".{spool_out.POSITION}.crc").unlink(missing_ok=True)
    assert spool.load_position(spark, str(tmp_path)) is None


def test_envelopes(spark):
    rows = [
        row(1, "c", 100, after=[("id", "text", b"1"), ("name", "text", b"Alice"), ("raw", "binary", b"\x00\xff"), ("bad", "text", b"\xff"), ("none", "null", None)], commit_lsn=12345),
        row(2, "u", 100, before=text(id=1), after=text(id=2, name='q"\n'), commit_lsn=12345), row(3, "c", 100, after=text(id=3), commit_lsn=12345), row(4, "t", 100, tables=["public.users"], commit_lsn=12345),
    ]
    out = envelope.envelope(spark.createDataFrame(rows, CHANGELOG), "app", "db", {"public": "main"}).orderBy("lsn").collect()
    values = [json.loads(r.value) for r in out]
    assert [r.topic for r in out] == ["app.main.users"] * 4
    assert values[0]["payload"]["after"] == {"id": "1", "name": "Alice", "raw": "AP8=", "bad": "/w==", "none": None} and values[0]["payload"]["before"] is None
    assert [f["type"] for f in values[0]["schema"]["fields"][0]["fields"]] == ["string", "string", "bytes", "string", "string"]
    assert values[0]["payload"]["source"] == {"version": "1", "connector": "tidemark", "name": "app", "ts_ms": 1705312800000, "db": "db", "schema": "main", "table": "users", "txId": 100, "lsn": 12345}
    assert [v["payload"]["op"] for v in values] == ["c", "u", "c", "t"] and values[1]["payload"]["after"]["name"] == 'q"\n'
    keys = [json.loads(r.key) if r.key else None for r in out]
    assert keys[0] is None and keys[1]["payload"] == {"id": "1"} and keys[2]["payload"] == {"id": "3"} and keys[3] is None  # learned by the second row
    assert keys[1]["schema"]["name"] == "app.main.users.Key"
    fixed = envelope.envelope(spark.createDataFrame(rows, CHANGELOG), "app", "db", keys={"public.users": ["name"]}).orderBy("lsn").collect()
    assert json.loads(fixed[0].key)["payload"] == {"name": "Alice"}


def test_kafka_frame(spark):
    sink = KafkaSink("h:1", "app", "db")
    assert sink.messages(spark.createDataFrame(LOG, CHANGELOG)).columns == ["topic", "key", "value"] and sink.settings["kafka.acks"] == "all"
    with pytest.raises(UnsupportedError):
        sink.write_sql([])


def test_metrics_endpoint():
    metrics = Metrics()
    metrics.counters["rows_total"] += 3
    server = serve(metrics)
    at = f"http://127.0.0.1:{server.server_port}"
    assert "changelog_rows_total 3" in urllib.request.urlopen(f"{at}/metrics").read().decode()
    assert json.loads(urllib.request.urlopen(f"{at}/health").read()) == {"status": "ok"}
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}/other")
    server.shutdown()


def test_retries(spark):
    from tidemark.errors import ConfigError, ConnectionLost
    from tidemark.streaming.retry import run as again

    waits, tries = [], []

    class Query:
        def awaitTermination(self):
            tries.append(1)
            if len(tries) < 4:
                raise ConnectionLost("gone")

    again(Query, wait=waits.append)
    assert waits == [1, 2, 4]
    with pytest.raises(ConfigError):
        again(lambda: (_ for _ in ()).throw(ConfigError("no")), wait=waits.append)


def test_open_transactions_in_the_order_of_their_files(spark, tmp_path):
    import os

    for n, at in ((5, 300), (6, 100)):
        (tmp_path / f"{n}.json").write_text(json.dumps({"tx_id": n}))
        os.utime(tmp_path / f"{n}.json", (at, at))
    assert [r.tx_id for r in spool.read_open(spark, str(tmp_path)).collect()] == [6, 5]


def test_a_large_transaction(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    n = 25_000
    rows = spark.range(2, n + 2).select(F.col("id").alias("lsn"), F.lit(0).alias("seq"), F.lit(1).cast("long").alias("tx_id"), F.lit("c").alias("event"))
    rows.union(spark.createDataFrame([(1, 0, 1, "begin"), (n + 2, 0, 1, "commit")], rows.schema)).write.json(str(folder / "big"))
    log = spark.readStream.schema(CHANGELOG).json(str(folder / "big"))
    query = committed(log).writeStream.format("memory").queryName("big").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("big").where(f"commit_lsn = {n + 2}").count() == n


def test_transactions_that_end_in_their_batch_dont_reach_the_state_store(spark, tmp_path):
    ids = spark.range(300).select((F.col("id") * 10 + 1).alias("lsn"), F.lit(0).alias("seq"), F.col("id").alias("tx_id"), F.lit("begin").alias("event"))
    make = lambda event, by: ids.withColumns({"lsn": F.col("lsn") + by, "event": F.lit(event)})
    ids.union(make("c", 1)).union(make("u", 2)).union(make("commit", 3)).coalesce(1).write.json(str(tmp_path / "in"))
    log = spark.readStream.schema(CHANGELOG).json(str(tmp_path / "in"))
    query = committed(log).writeStream.format("memory").queryName("whole").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("whole").where("commit_lsn = tx_id * 10 + 4").count() == 600
    assert [s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]] == [0]


@pytest.mark.parametrize("held", [1, 32 << 20])
def test_parts_in_the_state_store(spark, tmp_path, held):
    """Transactions over three batches, with changes put off in the middle of a batch, and sub-transactions that a double can't tell apart."""
    big, late = 2**53, datetime(2024, 3, 1)
    batches = [
        [row(1, "begin", 1), row(2, "c", 1, big), row(3, "c", 1, big + 1), row(4, "begin", 2), row(5, "c", 2), row(6, "begin", 3), row(7, "c", 3), row(8, "c", 4)],
        [row(9, "c", 1), row(10, "stream_abort", 1, big), row(11, "c", 2), row(12, "begin", 3), row(13, "c", 3), row(14, "c", 3, 5), row(15, "stream_abort", 3, 5)],
        [row(16, "c", 1, big), row(17, "commit", 1), row(18, "stream_abort", 2), row(19, "c", 3), row(20, "commit", 3), row(21, "c", 4), row(22, "begin", 5), row(23, "c", 5), row(24, "commit", 5)],
        [row(25, "c", 1), row(26, "commit", 1), row(27, "c", 2), (28, 0, 2, None, None, late, "commit", *[None] * 8)],
    ]
    (folder := tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        write_lines(folder / f"{i}.json", rows, spark)
        log = committed(spool.stream_events(spark, str(folder)), held)
        log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.lsn, r.tx_id, r.commit_lsn, r.commit_ts) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(3, 1, 17, AT), (9, 1, 17, AT), (13, 3, 20, AT), (19, 3, 20, AT), (23, 5, 24, AT), (25, 1, 26, AT), (27, 2, 28, late)]


def test_a_log_in_several_files_is_read_by_as_many_tasks(spark, tmp_path):
    from tidemark.sources.replay import JsonTransport
    from tidemark.sources.wal import LogReader, Range

    folder = tmp_path / "log"
    folder.mkdir()
    for i, rows in enumerate((LOG[:6], LOG[6:14], LOG[14:])):  # names don't follow the order
        write_lines(folder / f"{9 - i}.json", rows, spark)
    (folder / "_SUCCESS").touch()
    options = {"transport": "tidemark.sources.replay:JsonTransport", "path": f"file://{folder}"}
    reader = LogReader(options)
    assert reader.latestOffset() == {"lsn": 19}
    parts = reader.partitions({"lsn": 2}, {"lsn": 17})
    assert [(p.after, p.upto) for p in parts] == [(2, 6), (6, 14), (14, 17)] and reader.partitions({"lsn": 17}, {"lsn": 17}) == []
    got = [b.to_pylist() for p in parts for b in reader.read(p)]
    assert [[r["lsn"] for r in b] for b in got] == [[3, 4, 5, 6], list(range(7, 15)), [15, 16, 17]]
    want = spark.createDataFrame(LOG[2:3], CHANGELOG).toArrow().to_pylist()
    assert got[0][:1] == want and got[0][1]["commit_ts"].replace(tzinfo=None) == AT
    opened, lines = [], JsonTransport._lines
    try:
        JsonTransport._lines = lambda self, path: (opened.append(r["lsn"]) or r for r in lines(self, path))
        fresh = JsonTransport(options)
        assert fresh.latest() == fresh.latest() == 19 and sorted(opened) == [1, 7, 15]  # a file's ends are read, once
        write_lines(folder / "7.json", LOG[14:17], spark)
        assert fresh.latest() == 17 and [r[0] for r in fresh.records(13, 16)] == [14, 15, 16]
    finally:
        JsonTransport._lines = lines
    (tmp_path / "long.json").write_text(json.dumps({"lsn": 1}) + "\n" + json.dumps({"lsn": 2, "table": "x" * 300_000}) + "\n\n\n")
    assert JsonTransport({"path": f"file://{tmp_path}/long.json"}).latest() == 2
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'{"lsn": 4}\n{"lsn": 5}\n'))
    assert [r[0] for r in JsonTransport({"path": f"file://{tmp_path}/a.json.gz"}).records(4, 9)] == [5]
    (tmp_path / "none.json").touch()
    assert JsonTransport({"path": f"file://{tmp_path}/none.json"}).latest() == 0
    assert [(p.after, p.upto) for p in LogReader({"transport": "tests.log_transport:ListTransport"}).partitions({"lsn": 0}, {"lsn": 4})] == [(0, 4)]
    with pytest.raises(FileNotFoundError):
        next(JsonTransport({"path": f"file://{tmp_path}/missing"}).records(0, 9))
    rows = spark.createDataFrame([row(n, "c", 1, after=text(id=n)) for n in range(2500)], CHANGELOG).toJSON().collect()
    (tmp_path / "many.json").write_text("\n".join(rows))
    many = LogReader(options | {"path": f"file://{tmp_path}/many.json"})
    assert [r["lsn"] for b in many.read(Range(-1, 2400)) for r in b.to_pylist()] == list(range(2401))
