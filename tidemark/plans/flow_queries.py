"""Queries that go through files, sinks and streams and read back what came out."""

from __future__ import annotations

import sqlite3
import tempfile
import urllib.error
import urllib.request
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SinkError
from ..functions.dialects import ANSI
from ..operators import assemble
from ..schema import CHANGELOG, image
from ..sinks import spool as spool_out
from ..sinks.jdbc import BulkLoader, driver_bulk, driver_rows
from ..sinks.kafka import KafkaSink
from ..sinks.registry import create_sink, register_sink
from ..sinks.sql import JdbcConnection, SqlSink
from ..sinks.sqlite import SqliteSink
from ..sinks.storage import storage
from ..sources import spool as spool_in
from ..sources import wal
from ..streaming.assemble import committed as committed_stream
from ..streaming.lifecycle import stop
from ..streaming.listener import Metrics, NoMetrics, serve
from .folder import shared_folder
from .queries import CL, LIFE, TX, changes, committed
from .registry import query, read

# ---------------------------------------------------------------- spool
STATEMENTS = """s AS (SELECT CAST(floor(event_id / 1500) AS BIGINT) AS tx_id, event_id % 1500 AS pos, 'INSERT INTO t VALUES (''' || event_id || ';' || chr(10) || event_type || ''')' AS statement FROM events)"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of 1,500 statements, with line ends and semicolons inside their quotes."""
    at = F.col("event_id")
    text = F.concat(F.lit("INSERT INTO t VALUES ('"), at.cast("string"), F.lit(";\n"), F.col("event_type"), F.lit("')"))
    return read(spark, sf_dir, "events").select(F.floor(at / 1500).cast("long").alias("tx_id"), (at % 1500).alias("pos"), text.alias("statement"))


@query("spool_plain", f"WITH {STATEMENTS} SELECT statement FROM s")
def spool_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written as lines, in segments of 400, and split again."""
    folder = shared_folder(spark, "plain")
    rows = _statements(spark, sf_dir).withColumn("statement", F.concat(F.lit("  "), F.col("statement"), F.lit(" ; ")))
    spool_out.write_statements(rows, folder, rows_per_segment=400)
    return spool_in.read_statements(spark, folder).select("statement")


@query("spool_gzip", f"WITH {STATEMENTS} SELECT statement FROM s")
def spool_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "gzip")
    spool_out.write_statements(_statements(spark, sf_dir), folder, compress=True)
    return spool_in.read_statements(spark, folder).select("statement")


@query("storage_plain", f"WITH {STATEMENTS} SELECT tx_id, CAST(pos AS INTEGER) AS pos, statement FROM s WHERE pos >= 700")
def storage_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as folders of text, read from their 700th statement on."""
    folder, store = shared_folder(spark, "plain"), storage("plain")
    store.write(_statements(spark, sf_dir), folder)
    return store.read(spark, folder, 700).select("tx_id", F.col("pos").cast("int").alias("pos"), "statement")


@query("storage_packed", f"WITH {STATEMENTS} SELECT tx_id, pos, statement FROM s WHERE pos >= 1100")
def storage_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as gzip members of 1,000 statements; from the 1,100th on only the second of each is read."""
    folder, store = shared_folder(spark, "packed"), storage("gzip")
    store.write(_statements(spark, sf_dir), folder)
    return store.read(spark, folder, 1100).select("tx_id", "pos", "statement")


@query("packed_index", "SELECT CAST(floor(event_id / 1500) AS BIGINT) AS tx_id, count(*) AS total, CAST(1 + (count(*) - 1) // 1000 AS INTEGER) AS members FROM events GROUP BY 1")
def packed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where members begin, as JSON that is read back."""
    members = spool_out.pack(_statements(spark, sf_dir), ["tx_id"], "pos")
    kind = "struct<total_statements:long,offsets:array<struct<statement_index:long,byte_offset:long>>>"
    found = spool_out.index_json(members, ["tx_id"]).select("tx_id", F.from_json("index", kind).alias("i"))
    return found.select("tx_id", F.col("i.total_statements").alias("total"), F.size("i.offsets").alias("members"))


@query(
    "sync_points",
    f"""WITH {STATEMENTS}, n AS (SELECT tx_id, pos, sum(length(statement) + 2) OVER (PARTITION BY tx_id ORDER BY pos) - length(statement) - 2 AS byte_offset FROM s)
SELECT tx_id, pos AS statement_index, CAST(byte_offset AS BIGINT) AS byte_offset FROM n WHERE pos % 1000 = 0""",
)
def sync_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spool_out.sync_points(_statements(spark, sf_dir), ["tx_id"], "pos")


@query(
    "sync_point_seek",
    """SELECT event_id AS target, coalesce(p.i, 0) AS statement_index, coalesce(p.b, 0) AS byte_offset FROM events e
ASOF LEFT JOIN (SELECT event_id AS i, event_id * 40 AS b FROM events WHERE event_id % 1000 = 0 AND event_id > 0) p ON e.event_id >= p.i""",
)
def sync_point_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sync point at or before a statement, over many spans of the log."""
    at = read(spark, sf_dir, "events").select("event_id")
    points = at.where("event_id % 1000 = 0 and event_id > 0").select(F.col("event_id").alias("statement_index"), (F.col("event_id") * 40).alias("byte_offset"))
    return spool_in.sync_point(points, at.select(F.col("event_id").alias("target")))


@query(
    "segments_by_bytes",
    """WITH RECURSIVE n AS (SELECT user_id AS tx_id, event_id AS pos, length(props) + 2 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT tx_id, pos, i, cost AS filled, CAST(0 AS BIGINT) AS segment FROM n WHERE i = 1
      UNION ALL SELECT n.tx_id, n.pos, n.i, CASE WHEN g.filled + n.cost > 500 THEN n.cost ELSE g.filled + n.cost END, CASE WHEN g.filled + n.cost > 500 THEN g.segment + 1 ELSE g.segment END
      FROM g JOIN n ON n.tx_id = g.tx_id AND n.i = g.i + 1)
SELECT tx_id, pos, segment FROM g""",
)
def segments_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a transaction dealt to segments of 500 bytes."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("tx_id"), F.col("event_id").alias("pos"), F.col("props").alias("statement"))
    return spool_out.segments(rows, ["tx_id"], "pos", segment_bytes=500).select("tx_id", "pos", "segment")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a changelog: creates, updates and deletes of users' values, ten to a transaction."""
    row = image(id=F.col("k"), value=F.col("value"), kind=F.col("event_type"))
    none = F.lit(None)
    rows = changes(spark, sf_dir)
    at = {"lsn": F.col("lsn") * 2, "seq": F.lit(0), "tx_id": F.col("tx_id"), "sub_xid": none, "commit_lsn": F.col("tx_id") * 20 + 19, "commit_ts": F.col("ts"), "event": F.col("op"), "schema": F.lit("public"), "table": F.lit("users")}
    more = {"relation_oid": none, "replica_identity": F.lit("default"), "key_columns": F.array(F.lit("id")), "before": F.when(F.col("op") != "c", row), "after": F.when(F.col("op") != "d", row), "tables": none}
    return rows.select(*[(at | more)[f.name].cast(f.dataType).alias(f.name) for f in CHANGELOG.fields])


@query("spool_events", f"WITH {CL} SELECT lsn * 2 AS lsn, tx_id, op AS event, CASE WHEN op <> 'd' THEN CAST(k AS VARCHAR) END AS id FROM cl")
def spool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as compressed lines of JSON and read again."""
    folder = shared_folder(spark, "events")
    spool_out.write_events(_log(spark, sf_dir), folder, compress=True)
    return spool_in.read_events(spark, folder).select("lsn", "tx_id", "event", F.get("after", F.lit(0))["bytes"].cast("string").alias("id"))


@query("pending_order", f"WITH {TX} SELECT tx_id, commit_lsn, row_number() OVER (ORDER BY commit_lsn NULLS LAST, tx_id) - 1 AS place FROM tx")
def pending_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that were left on disk, in the order they are applied in."""
    folder = shared_folder(spark, "pending")
    committed(spark, sf_dir).select("tx_id", "commit_lsn").write.json(folder)
    return assemble.in_commit_order(spool_in.read_pending(spark, folder)).select("tx_id", "commit_lsn", (F.col("place") - 1).alias("place"))


@query("open_transactions", "SELECT DISTINCT user_id AS tx_id FROM events")
def open_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "open")
    read(spark, sf_dir, "events").select(F.col("user_id").alias("tx_id")).distinct().write.json(folder)
    return spool_in.read_open(spark, folder).select("tx_id")


@query("position_kept", "SELECT max(event_id) AS flush_lsn, max(user_id) AS last_tx, true AS fresh, true AS broken FROM events")
def position_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position that is applied, replaced on disk and read back; none where there is none, or a broken file."""
    folder = shared_folder(spark, "position")
    fresh = spool_in.load_position(spark, folder) is None
    last = read(spark, sf_dir, "events").agg(F.max("event_id"), F.max("user_id")).first()
    for lsn in (1, last[0]):
        spool_out.save_position(spark, folder, lsn, last_tx=last[1])
    state = spool_in.load_position(spark, folder)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{spool_out.POSITION}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(b'{"flush_lsn": '))
    out.close()
    broken = spool_in.load_position(spark, folder) is None
    return spark.createDataFrame([(state["flush_lsn"], state["last_tx"], fresh, broken)], "flush_lsn long, last_tx long, fresh boolean, broken boolean")


# ---------------------------------------------------------------- sinks
FINAL = f"""WITH {CL}, {LIFE}
SELECT CAST(cl.k AS VARCHAR) AS id, arg_max(cl.event_type, cl.lsn) AS kind FROM cl JOIN c ON cl.k = c.k WHERE cl.lsn >= c.c AND cl.op IN ('c', 'u') GROUP BY cl.k"""


def _sqlite(rows: str = "id TEXT PRIMARY KEY ON CONFLICT REPLACE, value TEXT, kind TEXT") -> str:
    """A new SQLite file of the driver, which is the database here."""
    path = str(Path(tempfile.mkdtemp(prefix="sqlite-")) / "t.db")
    db = sqlite3.connect(path)
    db.execute(f"CREATE TABLE users ({rows})")
    db.commit()
    db.close()
    return path


def _rows(spark: SparkSession, path: str) -> DataFrame:
    db = sqlite3.connect(path)
    rows = db.execute("SELECT id, kind FROM users").fetchall()
    db.close()
    return spark.createDataFrame(rows, "id string, kind string")


@query("sqlite_apply", FINAL)
def sqlite_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole log applied to a SQLite file, a batch twice."""
    path = _sqlite()
    sink = SqliteSink(path)
    for _ in range(2):
        sink.write(_log(spark, sf_dir), 0)
    sink.close()
    return _rows(spark, path)


@query("sqlite_resume", FINAL)
def sqlite_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, stopped inside of a transaction and taken up again behind the last statement that was done."""
    path = _sqlite()
    sink = SqliteSink(path, batch_size=100)
    run, left = sink.connection.execute, [250]

    def fails(sql: str) -> None:
        left[0] -= 1
        if left[0] == 0:
            raise SinkError("stopped")
        run(sql)

    sink.connection.execute = fails
    try:
        sink.write(_log(spark, sf_dir), 0)
    except SinkError:
        pass
    sink.connection.execute = run
    sink.write(_log(spark, sf_dir), 0)
    sink.close()
    return _rows(spark, path)


#: What JDBC is tried with: a database that Spark brings along, inside the driver's JVM.
DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def _derby(spark: SparkSession) -> str:
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(Path(tempfile.gettempdir()) / "derby.log"))
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


@query("jdbc_apply", FINAL)
def jdbc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log applied to a database behind JDBC, in packets of 20,000 bytes and transactions of 500 statements, and read back over JDBC. A create of a
    row that is there is a deletion and a create, as nothing replaces by itself there. Derby compiles each statement, so the log's net effect is applied."""
    url = _derby(spark)
    connection = JdbcConnection(spark, url, **DERBY)
    connection.execute('CREATE SCHEMA "main"')
    connection.execute('CREATE TABLE "main"."users" ("id" VARCHAR(20) PRIMARY KEY, "value" VARCHAR(60), "kind" VARCHAR(20))')
    connection.commit()
    sink = SqlSink(connection, ANSI, {"public": "main"}, packet=20_000, max_rows=50, batch_size=500, net=True)
    log = _log(spark, sf_dir)
    first = log.where("event = 'c'").withColumns({"event": F.lit("d"), "before": F.col("after"), "after": F.lit(None).cast(log.schema["after"].dataType), "seq": F.lit(-1)})
    sink.write(log.unionByName(first), 0)
    sink.close()
    return driver_rows(spark, url.removesuffix(";create=true"), '"main"."users"', ["id", "kind"], shared_folder(spark, "table"), **DERBY)


@query("jdbc_bulk_load", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'bulk, insert, insert' AS ways FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 'bulk, insert, insert' FROM customer WHERE c_custkey % 3 <> 0")
def jdbc_bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows loaded in bulk; where that fails, by INSERTs of many rows, and the table isn't tried again. The database is in the driver's JVM, out of
    the executors' reach, so rows go through the driver both ways."""
    url = _derby(spark)
    connection = JdbcConnection(spark, url, **DERBY)
    for table in ("good", "bad"):
        connection.execute(f'CREATE TABLE "{table}" ("id" VARCHAR(20), "name" VARCHAR(60))')
    connection.commit()
    at = url.removesuffix(";create=true")
    plain = driver_bulk(spark, at, **DERBY)

    def bulk(rows: DataFrame, table: str, columns: list[str]) -> None:
        if table == '"bad"':
            raise SinkError("no bulk here")
        plain(rows, table, columns)

    loader = BulkLoader(SqlSink(connection, ANSI, max_rows=200), bulk)
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lsn"), image(id=F.col("c_custkey"), name=F.col("c_name")).alias("after"))
    parts = (('"good"', rows.where("lsn % 3 = 0")), ('"bad"', rows.where("lsn % 3 = 1")), ('"bad"', rows.where("lsn % 3 = 2")))
    ways = [loader.write(part, table, ["id", "name"]) for table, part in parts]
    good, bad = (driver_rows(spark, at, table, ["id", "name"], shared_folder(spark, "table"), **DERBY) for table in ('"good"', '"bad"'))
    out = good.unionByName(bad)
    connection.close()
    return out.select("id", "name", F.lit(", ".join(ways)).alias("ways"))


@query("slot_lookup", "SELECT 281474976710672 AS restart_lsn, 4294967296 AS confirmed_flush_lsn, true AS active")
def slot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot's row looked up over JDBC."""
    url = _derby(spark)
    connection = JdbcConnection(spark, url, **DERBY)
    connection.execute("CREATE TABLE pg_replication_slots (slot_name VARCHAR(20), restart_lsn VARCHAR(20), confirmed_flush_lsn VARCHAR(20), active VARCHAR(5))")
    connection.execute("INSERT INTO pg_replication_slots VALUES ('a', '10000/10', '1/0', 't'), ('b', '0/1', '0/1', 'f')")
    connection.commit()
    connection.close()
    found = wal.slot_status(spark, url.removesuffix(";create=true"), "a", **DERBY).toDF("restart", "confirmed", "active")
    return found.select(wal.slot_fields(F.col("restart"), F.col("confirmed"), F.col("active")).alias("s")).select("s.*")


@query("kafka_messages", f"WITH {CL} SELECT 'app.main.users' AS topic, op, count(*) AS n, count(CASE WHEN op <> 'c' THEN 1 END) AS keyed, CAST(3 AS BIGINT) AS tries FROM cl GROUP BY op")
def kafka_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages handed to the connector, which takes them at the third try."""
    from ..errors import ConnectionLost

    got, waits = [], []

    def deliver(messages: DataFrame, options: dict[str, str]) -> None:
        got.append(messages)
        if len(got) < 3:
            raise ConnectionLost("UNKNOWN_TOPIC_OR_PARTITION")

    KafkaSink("h:1", "app", "db", {"public": "main"}, deliver=deliver, wait=waits.append, environment={}).write(_log(spark, sf_dir), 0)
    op = F.get_json_object("value", "$.payload.op")
    own = F.when(op != "c", F.get_json_object("key", "$.payload.id"))
    return got[-1].groupBy("topic", op.alias("op")).agg(F.count(F.lit(1)).alias("n"), F.count(own).alias("keyed"), F.lit(len(got)).cast("long").alias("tries"))


@query("custom_sink", "SELECT event_type, count(*) AS n, true AS fresh, 1 AS hooks FROM events GROUP BY event_type")
def custom_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that a user brings, found by name; each is new, and its hook runs once."""

    class Counting:
        dialect, takes_events = "ansi", False

        def __init__(self) -> None:
            self.frame: DataFrame | None = None

        def write(self, batch: DataFrame, batch_id: int, hook=None) -> None:
            self.frame = batch.groupBy("event_type").count()
            hook()

        def close(self) -> None:
            pass

    register_sink("counting", Counting)
    sink, hooks = create_sink("Counting"), []
    sink.write(read(spark, sf_dir, "events"), 0, lambda: hooks.append(1))
    fresh = create_sink("counting") is not sink
    return sink.frame.select("event_type", F.col("count").alias("n"), F.lit(fresh).alias("fresh"), F.lit(len(hooks)).alias("hooks"))


@query("metrics_endpoint", "SELECT * FROM (VALUES ('/metrics', 200, true), ('/health', 200, true), ('/other', 404, false)) AS t(path, status, expected)")
def metrics_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = Metrics()
    metrics.counters["rows_total"] += 7
    server, out = serve(metrics), []
    for path, word in (("/metrics", "changelog_rows_total 7"), ("/health", '"ok"'), ("/other", "")):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}") as answer:
                out.append((path, answer.status, word in answer.read().decode()))
        except urllib.error.HTTPError as error:
            out.append((path, error.code, False))
    server.shutdown()
    server.server_close()
    return spark.createDataFrame(out, "path string, status int, expected boolean")


# ---------------------------------------------------------------- streams
STREAM = """r AS (SELECT event_id, CAST(floor(event_id / 10) AS BIGINT) AS tx_id, event_id % 10 AS n, event_type FROM events),
t AS (SELECT tx_id, min(event_id) * 3 + 40 AS commit_lsn FROM r WHERE tx_id % 5 <> 0 GROUP BY tx_id)
SELECT r.event_id * 3 AS lsn, r.tx_id, t.commit_lsn FROM r JOIN t ON r.tx_id = t.tx_id WHERE r.tx_id % 7 <> 0 AND NOT (r.tx_id % 4 = 0 AND r.n % 3 = 1) AND NOT (r.tx_id % 6 = 1 AND r.n < 4)"""


def _raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with its controls: every fifth transaction stays open, every seventh aborts, of every fourth a part does, and some begin again."""
    at, n = F.col("event_id"), F.col("event_id") % 10
    events = read(spark, sf_dir, "events").select("event_id", F.floor(at / 10).cast("long").alias("tx_id"), n.alias("n"), "event_type", "ts")
    row = {f.name: F.lit(None).cast(f.dataType) for f in CHANGELOG.fields} | {"seq": F.lit(0), "schema": F.lit("public"), "table": F.lit("users")}
    make = lambda frame, **given: frame.select(*[(row | given)[f.name].cast(f.dataType).alias(f.name) for f in CHANGELOG.fields])
    lsn, tx = F.col("event_id") * 3, F.col("tx_id")
    rows = make(events, lsn=lsn, tx_id=tx, sub_xid=F.when(tx % 4 == 0, F.col("n") % 3), event=F.lit("u"), after=image(id=F.col("event_id")))
    ids = events.groupBy("tx_id").agg(F.min("event_id").alias("event_id"), F.min("ts").alias("ts"))
    begins = make(ids, lsn=lsn - 1, tx_id=tx, event=F.lit("begin"))
    again = make(ids.where("tx_id % 6 = 1"), lsn=lsn + 11, tx_id=tx, event=F.lit("begin"))
    parts = make(ids.where("tx_id % 4 = 0"), lsn=lsn + 35, tx_id=tx, sub_xid=F.lit(1), event=F.lit("stream_abort"))
    aborts = make(ids.where("tx_id % 7 = 0"), lsn=lsn + 36, tx_id=tx, event=F.lit("stream_abort"))
    ends = make(ids.where("tx_id % 5 <> 0"), lsn=lsn + 40, tx_id=tx, commit_ts=F.col("ts"), event=F.when(tx % 2 == 0, "commit").otherwise("stream_commit"))
    return rows.unionByName(begins).unionByName(again).unionByName(parts).unionByName(aborts).unionByName(ends)


@query("stream_assembly", f"WITH {STREAM}")
def stream_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions put together by a stream over several batches of files, with their state in the store between."""
    folder = shared_folder(spark, "stream")
    log = _raw_log(spark, sf_dir)
    cuts = [0, 9001, 2**62]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        log.where((F.col("lsn") >= a - 1) & (F.col("lsn") < b - 1)).write.json(f"{folder}/in/{i}")
    for i in range(len(cuts) - 1):  # each run takes up what came since the last, from its checkpoint
        # the files of a part aren't in the log's order, so one batch takes all of them
        part = spool_in.stream_events(spark, f"{folder}/in/[0-{i}]", files_per_trigger=2**31 - 1)
        run = committed_stream(part).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("lsn", "tx_id", "commit_lsn")


#: Rows of the log in a file, about, which one task sorts and one reads.
LOG_ROWS = 50_000


@query("log_stream", "SELECT event_id * 2 AS lsn, true AS acknowledged FROM events WHERE event_id > 0")
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a data source in batches of a quarter, from a transport over files, each of which is a task's; each batch is acknowledged
    before the next."""
    folder, log = shared_folder(spark, "log"), _log(spark, sf_dir)
    last, rows = log.agg(F.max("lsn"), F.count("lsn")).first()
    log.repartitionByRange(rows // LOG_ROWS + 1, "lsn").sortWithinPartitions("lsn").write.json(f"{folder}/in")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/in")
    path = at.getFileSystem(conf).getFileStatus(at).getPath().toUri().toString()
    path = "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    options = {"path": path, "acks": f"{folder}/acks", "max_positions": str(last // 4 + 1)}
    stream = wal.read_log(spark, "tidemark.sources.replay:JsonTransport", **options)
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    run.processAllAvailable()
    run.stop()
    from ..sources.replay import JsonTransport

    acknowledged = last // 2 <= JsonTransport(options).confirmed() <= last
    return spark.read.parquet(f"{folder}/out").select("lsn", F.lit(acknowledged).alias("acknowledged"))


@query("stop_in_order", "SELECT * FROM (VALUES (0, 'acknowledged'), (1, 'kept'), (2, 'closed')) AS t(step, what)")
def stop_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An orderly end: what is applied is acknowledged, then kept, then the sink is closed, whatever fails before."""
    folder, done = shared_folder(spark, "stop"), []

    class Ended:
        def applied(self) -> tuple[int, int]:
            return 3, 41

        def close(self) -> None:
            kept = spool_in.load_position(spark, folder)
            done.append("kept" if kept and kept["flush_lsn"] == 41 else "lost")
            done.append("closed")

    class Failing:
        def stop(self) -> None:
            raise ConnectionError("gone")

        def awaitTermination(self) -> None:
            pass

    try:
        stop(spark, Failing(), Ended(), folder, lambda lsn: done.append("acknowledged" if lsn == 41 else "wrong"))
    except ConnectionError:
        pass
    return spark.createDataFrame(list(enumerate(done)), "step int, what string")


@query("retry_streams", "SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 2.0::DOUBLE), (2, 4.0::DOUBLE)) AS t(attempt, seconds)")
def retry_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is lost three times is started again after waits that double."""
    from ..errors import ConnectionLost
    from ..streaming.retry import run

    waits: list[float] = []

    class Query:
        def awaitTermination(self) -> None:
            if len(waits) < 3:
                raise ConnectionLost("gone")

    run(Query, wait=waits.append)
    return spark.createDataFrame(list(enumerate(waits)), "attempt int, seconds double")


@query("no_metrics", "SELECT '' AS text, 0 AS counters")
def no_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same interface where nothing is counted."""
    quiet = NoMetrics()
    spark.streams.addListener(quiet)
    spark.streams.removeListener(quiet)
    return spark.createDataFrame([(quiet.text(), len(quiet.counters))], "text string, counters int")
