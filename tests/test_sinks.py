"""Statements written as few, sinks over SQL, bulk loads, deliveries, storages."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, ConnectionLost, SinkError
from tidemark.functions.dialects import ANSI, MYSQL, SQLITE, SQLSERVER
from tidemark.operators import statements
from tidemark.schema import CHANGELOG, image
from tidemark.sinks.jdbc import BulkLoader, MysqlSink, SqlServerSink, load_statement, server_settings
from tidemark.sinks.kafka import KafkaSink
from tidemark.sinks.sql import PACKET
from tidemark.sinks.sqlite import SqliteSink
from tidemark.sinks.storage import storage
from tidemark.sources.wal import LogReader, Range
from tests.test_streaming import new_db, row, text, users


class Recorder:
    """A connection that notes what it is told, and fails where it is told to."""

    def __init__(self, answers=None, fails=()):
        self.said, self.answers, self.fails = [], answers or {}, list(fails)

    def begin(self):
        self.said.append("BEGIN")

    def commit(self):
        self.said.append("COMMIT")

    def rollback(self):
        self.said.append("ROLLBACK")

    def execute(self, sql):
        if self.fails and self.fails[0] in sql:
            self.fails.pop(0)
            raise SinkError("refused")
        self.said.append(sql)

    def query(self, sql):
        for part, rows in self.answers.items():
            if part in sql:
                if isinstance(rows, Exception):
                    raise rows
                return rows
        return []

    def close(self):
        self.said.append("CLOSE")


def random_statements(rng):
    name = lambda: rng.choice("abc")
    out = []
    for _ in range(rng.randrange(1, 25)):
        kind, i, j = rng.randrange(8), rng.randrange(4), rng.randrange(4)
        out.append(
            [
                f"""INSERT INTO "t" ("id", "n", "m") VALUES ('{i}', '{name()}', 'x;y');""",
                f"""INSERT INTO "t" ("id", "n", "m") VALUES ('{i}', '{name()}', NULL);""",
                f"""UPDATE "t" SET "id" = '{i}', "n" = '{name()}', "m" = 'it''s {j}' WHERE "id" = '{i}';""",
                f"""UPDATE "t" SET "id" = '{i}', "n" = '{name()}', "m" = 'k' WHERE "id" = '{j}';""",
                f"""UPDATE "t" SET "n" = '{name()}' WHERE "id" = '{i}' AND "m" IS NULL;""",
                f"""UPDATE "t" SET "m" = NULL WHERE "id" = '{i}' AND "m" IS NULL;""",
                f"""UPDATE "t" SET "m" = '{j}' WHERE "n" = '{name()}';""",
                f"""DELETE FROM "t" WHERE "id" = '{i}';""",
            ][kind]
        )
    return out


def table_after(texts):
    db = sqlite3.connect(":memory:")
    db.execute('CREATE TABLE "t" ("id" TEXT PRIMARY KEY ON CONFLICT REPLACE, "n" TEXT, "m" TEXT)')
    for t in texts:
        db.execute(t)
    return sorted(db.execute('SELECT * FROM "t"').fetchall(), key=repr)


@pytest.mark.parametrize(("dialect", "packet", "max_rows"), [(SQLITE, 1 << 20, 0), (ANSI, 1 << 20, 0), (SQLITE, 600, 3)])
def test_few_statements_do_what_many_did(spark, dialect, packet, max_rows):
    rng = random.Random(7)
    runs = {tx: random_statements(rng) for tx in range(150)}
    rows = spark.createDataFrame([(tx, i, s) for tx, texts in runs.items() for i, s in enumerate(texts)], "tx_id long, lsn long, statement string")
    out = statements.coalesced(rows, dialect, packet, max_rows).orderBy("tx_id", "first").collect()
    for tx, texts in runs.items():
        mine = [r for r in out if r.tx_id == tx]
        assert sum(r.n for r in mine) == len(texts)
        assert table_after([r.statement for r in mine]) == table_after(texts), (texts, [r.statement for r in mine])
    assert len(out) < 0.9 * sum(map(len, runs.values()))
    if dialect is SQLITE:
        assert any("UNION ALL" in r.statement for r in out) and any("CASE" in r.statement for r in out)


def log_of(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGELOG)


def test_mysql(spark):
    answers = {"max_allowed_packet": [("max_allowed_packet", "4096")], "local_infile": [("local_infile", "ON")], "batch_id, lsn": [("-1", "0", "-1", "0")], "SELECT batch_id FROM": [("-1",)]}
    db = Recorder(answers)
    sink, hooks = MysqlSink(db, {"public": "main"}), []
    assert sink.packet == 4096 and sink.loads and sink.dialect == "mysql"
    changes = [row(2 + i, "u", 1, before=text(id=i), after=text(id=i, name=f"n{i}"), commit_lsn=9) for i in range(3)]
    sink.write(log_of(spark, *changes, row(8, "t", 1, tables=["public.a", "public.b"], commit_lsn=9)), 0, lambda: hooks.append(list(db.said)))
    tail = db.said[db.said.index("BEGIN") :]
    assert tail[1].startswith("UPDATE `main`.`users` AS t JOIN (SELECT '0' AS `id`, 'n0' AS `name` UNION ALL") and tail[2:4] == ["TRUNCATE TABLE `main`.`a`", "TRUNCATE TABLE `main`.`b`"]
    assert tail[4] == "UPDATE `_applied` SET batch_id = 0, lsn = 9, open_batch = -1, done = 0;" and tail[5] == "COMMIT" and hooks[0][-1] == tail[4]
    assert server_settings(Recorder({"local_infile": SinkError("no")})) == (PACKET, False)


def test_failures_roll_back(spark):
    answers = {"batch_id, lsn": [("-1", "0", "-1", "0")], "SELECT batch_id FROM": [("-1",)]}
    db = Recorder(answers, fails=["INSERT INTO [public]"])
    sink = SqlServerSink(db)
    assert sink.max_rows == 1000
    with pytest.raises(SinkError):
        sink.write(log_of(spark, row(1, "c", 1, after=text(id=1), commit_lsn=2)), 0)
    assert db.said[-1] == "ROLLBACK"
    with pytest.raises(RuntimeError):
        sink.write(log_of(spark, row(1, "c", 1, after=text(id=1), commit_lsn=2)), 0, lambda: (_ for _ in ()).throw(RuntimeError("hook")))
    assert db.said[-1] == "ROLLBACK"


def test_a_batch_goes_on_where_it_stopped(spark, tmp_path):
    path = new_db(tmp_path / "t.db")
    rows = [row(1, "c", 1, after=text(id=i, name="a"), commit_lsn=9) if i < 5 else row(6, "t", 1, tables=["public.users"] * 3, commit_lsn=9) if i == 5 else row(1 + i, "c", 1, after=text(id=i, name="b"), commit_lsn=9) for i in range(12)]
    rows = [(n + 1, *r[1:]) for n, r in enumerate(rows)]
    for stop_at in range(1, 9):
        sink = SqliteSink(path, batch_size=2)
        sink.max_rows = 1  # a statement for each row
        run, left = sink.connection.execute, [stop_at]

        def execute(sql, run=run, left=left):
            left[0] -= 1
            if not left[0]:
                raise SinkError("killed")
            run(sql)

        sink.connection.execute = execute
        with pytest.raises(SinkError):
            sink.write(log_of(spark, *rows), stop_at)
        sink.connection.execute = run
        sink.write(log_of(spark, *rows), stop_at)
        sink.write(log_of(spark, *rows), stop_at)
        assert users(path) == [(i, "b") for i in range(6, 12)] and sink.applied()[0] == stop_at
        sink.connection.execute("UPDATE _applied SET lsn = 0")
        sink.close()


def test_bulk_loads_fall_back_and_are_not_tried_again(spark):
    answers = {"batch_id, lsn": [("-1", "0", "-1", "0")], "SELECT batch_id FROM": [("-1",)]}
    db, tried, hooks = Recorder(answers), [], []

    def bulk(rows, table, columns):
        tried.append(table)
        if table == "`bad`":
            raise SinkError("no")

    sink = MysqlSink(db)
    sink.max_rows = 2
    loader = BulkLoader(sink, bulk)
    rows = spark.range(5).select(F.col("id").alias("lsn"), image(id=F.col("id")).alias("after"))
    ways = [loader.write(rows, t, ["id"], hook=lambda: hooks.append(1)) for t in ("`good`", "`bad`", "`bad`", "`good`")]
    assert ways == ["bulk", "insert", "insert", "bulk"] and tried == ["`good`", "`bad`", "`good`"] and len(hooks) == 4
    assert [s for s in db.said if s.startswith("INSERT INTO `bad`")][:3] == ["INSERT INTO `bad` (`id`) VALUES ('0'), ('1');", "INSERT INTO `bad` (`id`) VALUES ('2'), ('3');", "INSERT INTO `bad` (`id`) VALUES ('4');"]
    assert load_statement("`t`", ["`a`", "`b`"], "f") == r"LOAD DATA LOCAL INFILE 'f' INTO TABLE `t` FIELDS TERMINATED BY '\t' LINES TERMINATED BY '\n' (`a`, `b`)"


def test_identifiers_are_escaped():
    from tidemark.operators.coalesce import join_update_sql

    assert join_update_sql(MYSQL, "t", ["a`b"], ["c"], [["1", "2"]]).count("`a``b`") == 3
    assert SQLSERVER.named("x]y") == "[x]]y]"


def test_deliveries(spark):
    got, waits, hooks = [], [], []

    def deliver(messages, options):
        got.append(options["kafka.acks"])
        if len(got) < 5:
            raise ConnectionLost("UnknownTopicOrPartition")

    log = log_of(spark, row(1, "c", 1, after=text(id=1), commit_lsn=2))
    KafkaSink("h", deliver=deliver, wait=waits.append, environment={"CDC_KAFKA_TOPIC_PREFIX": "p"}).write(log, 0, lambda: hooks.append(1))
    assert len(got) == 5 and waits == [0.1, 0.2, 0.4, 0.8] and hooks == [1]
    with pytest.raises(ConnectionLost):
        KafkaSink("h", deliver=lambda *_: (_ for _ in ()).throw(ConnectionLost("x")), wait=waits.append, environment={}).write(log, 0, lambda: hooks.append(2))
    with pytest.raises(SinkError):
        KafkaSink("h", deliver=lambda *_: (_ for _ in ()).throw(SinkError("too large")), wait=lambda _: pytest.fail("no wait"), environment={}).write(log, 0)
    assert hooks == [1]


def test_storages(spark, tmp_path):
    rows = spark.createDataFrame([(tx, i, f"INSERT '{tx};{i}\n'") for tx in (1, 2) for i in range(2300)], "tx_id long, pos long, statement string")
    for kind in ("plain", "gzip"):
        store = storage(kind)
        store.write(rows, str(tmp_path / kind))
        back = store.read(spark, str(tmp_path / kind), start=1999).collect()
        assert sorted((r.tx_id, r.pos, r.statement) for r in back) == [(tx, i, f"INSERT '{tx};{i}\n'") for tx in (1, 2) for i in range(1999, 2300)]
    members = spark.read.parquet(str(tmp_path / "gzip")).where("tx_id = 1").orderBy("statement_index").collect()
    assert [(m.statement_index, m.n) for m in members] == [(0, 1000), (1000, 1000), (2000, 300)]
    whole = b"".join(bytes(m.data) for m in members)
    import gzip

    assert gzip.decompress(whole[members[1].byte_offset :]).decode().startswith("INSERT '1;1000\n';\n")  # members are a file, its index their places
    with pytest.raises(ConfigError):
        storage("tar")


class Flaky:
    def __init__(self, options):
        self.options, self.left = options, 2

    def confirmed(self):
        return 0

    def latest(self):
        return 10

    def records(self, after, upto):
        for lsn in range(after + 1, upto + 1):
            yield (lsn, 0)
            if lsn == 4 and self.left:
                self.left -= 1
                raise ConnectionLost("gone")
            yield (lsn, 1)

    def acknowledge(self, upto):
        pass


def test_the_log_is_read_on_after_errors_and_in_steps():
    reader = LogReader({"transport": "tests.test_sinks:Flaky", "max_positions": "3"})
    reader.sleep = None
    assert list(reader.read(Range(0, 6))) == [(lsn, k) for lsn in range(1, 7) for k in (0, 1)]
    assert [reader.latestOffset()["lsn"] for _ in range(5)] == [3, 6, 9, 10, 10]
    reader.transport.left = 99
    with pytest.raises(ConnectionLost):
        list(reader.read(Range(0, 6)))


def test_statements_travel_packed(spark, monkeypatch):
    """Packs keep rows and their order, over partitions and several packs of one, and are far smaller than the texts."""
    from tidemark.sinks import sql

    monkeypatch.setattr(sql, "PACK", 5000)
    rows = spark.range(4000).selectExpr("if(id % 7 = 0, null, id) as commit_lsn", "'insert' as kind", "concat('INSERT INTO t VALUES (''é', id, ''');') as statement", "id").repartition(3).orderBy("id").drop("id")
    packs = sql.packed(rows)
    assert [tuple(r) for r in sql.unpacked(packs)] == [tuple(r) for r in rows.collect()]
    assert sum(len(r.pack) for r in packs.collect()) * 5 < sum(len(r.statement) for r in rows.collect())
