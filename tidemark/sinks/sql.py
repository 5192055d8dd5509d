"""Databases as sinks: the statements of a batch in commit order, written as few, in transactions that hold their progress.

A sink needs a connection that runs SQL text. SQLite's is Python's own; any database with a JDBC driver on the cluster is reached
through the driver's JVM. One sink is one writer, so statements stream through the driver, partition by partition; they
are never held whole. Progress (the batch, its last position, and how many of its statements are done) is a row of a table in the
same database, so a batch that was cut short goes on behind its last statement and none is applied twice.
"""

from __future__ import annotations

import json
import logging
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConnectionLost, SinkError
from ..functions.dialects import ANSI, Dialect
from ..functions.sqltext import split_statements
from ..operators.net import can_fold, net_changes
from ..operators.render import change_sql
from ..operators.statements import coalesced
from ..schema import only_changes
from .registry import Hook

log = logging.getLogger(__name__)
#: Rows of one INSERT by dialect (0: as many as the packet holds), and the packet where the server doesn't tell. Fixed values.
ROWS_PER_INSERT = {"sqlserver": 1000, "sqlite": 500}
PACKET = 64 << 20
#: Characters of the statements that travel to the driver as one compressed pack.
PACK = 4 << 20


class Connection(Protocol):
    """What a sink needs. begin, commit and rollback frame a transaction; query gives rows of text."""

    def begin(self) -> None: ...

    def commit(self) -> None: ...

    def rollback(self) -> None: ...

    def execute(self, sql: str) -> None: ...

    def query(self, sql: str) -> list[tuple]: ...

    def close(self) -> None: ...


class JdbcConnection:
    """A JDBC connection of the driver's JVM."""

    def __init__(self, spark: SparkSession, url: str, **properties: str):
        jvm = spark.sparkContext._jvm
        given = jvm.java.util.Properties()
        for name, value in properties.items():
            given.setProperty(name, value)
        if "driver" in properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
        self.raw = self._call(lambda: jvm.java.sql.DriverManager.getConnection(url, given))
        self.raw.setAutoCommit(False)

    @staticmethod
    def _call(run: Callable):
        """Failures of the database as sink errors; those of SQL state 08 are lost connections."""
        from py4j.protocol import Py4JJavaError

        try:
            return run()
        except Py4JJavaError as error:
            java = error.java_exception
            state = java.getSQLState() if hasattr(java, "getSQLState") and "SQL" in java.getClass().getName() else ""
            raise (ConnectionLost if (state or "").startswith("08") else SinkError)(java.getMessage()) from error

    def begin(self) -> None:
        pass  # a transaction begins with its first statement

    def commit(self) -> None:
        self._call(self.raw.commit)

    def rollback(self) -> None:
        self._call(self.raw.rollback)

    def execute(self, sql: str) -> None:
        statement = self.raw.createStatement()
        try:
            self._call(lambda: statement.execute(sql.removesuffix(";")))
        finally:
            statement.close()

    def query(self, sql: str, timeout: int = 0) -> list[tuple]:
        """timeout: seconds that the database may take; 0 for any."""
        statement = self.raw.createStatement()
        try:
            statement.setQueryTimeout(timeout)
            found = self._call(lambda: statement.executeQuery(sql.removesuffix(";")))
            count, out = found.getMetaData().getColumnCount(), []
            while found.next():
                out.append(tuple(found.getString(i + 1) for i in range(count)))
            return out
        finally:
            statement.close()

    def close(self) -> None:
        self._call(self.raw.close)


def packed(rows: DataFrame) -> DataFrame:
    """(pack): rows of texts and numbers in their order, compressed on the executors, as statements of a log are much alike. The last column tells sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda held: pa.RecordBatch.from_arrays([pa.array([zlib.compress(json.dumps(held).encode())], pa.binary())], names=["pack"])
        for batch in batches:
            held, size = [], 0
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                if (size := size + len(row[-1])) >= PACK:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)

    return rows.mapInArrow(run, "pack binary")


def unpacked(packs: DataFrame) -> Iterator[list]:
    """The rows that were packed, partition by partition."""
    for row in packs.toLocalIterator():
        yield from json.loads(zlib.decompress(row["pack"]))


class SqlSink:
    """Applies rows of the changelog. batch_size: statements of one transaction of the database; 0 takes a whole batch.

    net: apply what a batch leaves of each row instead of each change, where operators.net can tell; all deletions come first, then updates, then
    creates. For tables whose rows don't depend on each other (no foreign keys, no other unique columns).
    """

    takes_events = False
    state_table = "_applied"

    def __init__(
        self, connection: Connection, dialect: Dialect = ANSI, mappings: dict[str, str] | None = None, packet: int = PACKET, max_rows: int | None = None, batch_size: int = 0,
        net: bool = False,
    ):
        self.connection, self.render, self.dialect = connection, dialect, dialect.name
        self.mappings, self.packet, self.batch_size, self.net = mappings or {}, packet, batch_size, net
        self.max_rows = ROWS_PER_INSERT.get(dialect.name, 0) if max_rows is None else max_rows
        self._ready()

    def _ready(self) -> None:
        """The progress table with its one row."""
        table = self.render.named(self.state_table)
        try:
            found = self.connection.query(f"SELECT batch_id FROM {table}")
        except SinkError:
            self.connection.rollback()
            self.connection.execute(f"CREATE TABLE {table} (batch_id BIGINT, lsn BIGINT, open_batch BIGINT, done BIGINT)")
            found = []
        if not found:
            self.connection.execute(f"INSERT INTO {table} VALUES (-1, 0, -1, 0)")
        self.connection.commit()

    def progress(self) -> tuple[int, int, int, int]:
        """(last batch, last position, batch that was cut short, its statements that are done)."""
        found = self.connection.query(f"SELECT batch_id, lsn, open_batch, done FROM {self.render.named(self.state_table)}")[0]
        self.connection.commit()
        return tuple(int(x) for x in found)

    def applied(self) -> tuple[int, int]:
        """(last batch, last position), -1 and 0 before the first."""
        return self.progress()[:2]

    def _stage(self, batch: int, lsn: int, open_batch: int, done: int) -> None:
        self.connection.execute(f"UPDATE {self.render.named(self.state_table)} SET batch_id = {batch}, lsn = {lsn}, open_batch = {open_batch}, done = {done};")

    def statements(self, batch: DataFrame, last_lsn: int) -> DataFrame:
        """(commit_lsn, statement) in the order they are run in."""
        rows = batch.where(F.col("commit_lsn").isNull() | (F.col("commit_lsn") > last_lsn)) if last_lsn else batch
        at = F.struct(F.col("commit_lsn").isNull().alias("late"), "commit_lsn", "tx_id", "lsn", "seq")
        # Statements are filtered behind the parser only: a filter on them could be moved before the one that picks rows to render.
        rows = rows.where(only_changes())
        rows = net_changes(rows, at) if self.net and can_fold(rows) else rows.withColumns({"tx": F.struct("commit_lsn", "tx_id"), "at": at})
        rows = rows.select("tx", "at", change_sql(self.render, self.mappings).alias("statement"))
        few = coalesced(rows, self.render, self.packet, self.max_rows, "tx", "at").where("statement is not null and statement <> ';'")
        return few.orderBy("first").select(F.col("tx.commit_lsn").alias("commit_lsn"), "kind", "statement")

    def write(self, batch: DataFrame, batch_id: int, hook: Hook | None = None) -> None:
        """Apply a batch once: one that is applied is passed over, one that was cut short goes on where it stopped."""
        last_batch, last_lsn, open_batch, skip = self.progress()
        if batch_id <= last_batch:
            return
        skip = skip if open_batch == batch_id else 0
        texts = self._each(unpacked(packed(self.statements(batch, last_lsn))))
        done, highest = 0, last_lsn
        for _ in islice(texts, skip):
            done += 1
        try:
            while True:
                self.connection.begin()
                some = 0
                for commit_lsn, text in islice(texts, self.batch_size or None):
                    self.connection.execute(text)
                    some, highest = some + 1, max(highest, commit_lsn or 0)
                done += some
                if self.batch_size and some == self.batch_size:
                    self._stage(last_batch, last_lsn, batch_id, done)
                    self.connection.commit()
                    continue
                self._stage(batch_id, max(highest, self._highest(batch)), -1, 0)
                if hook is not None:
                    hook()
                self.connection.commit()
                return
        except BaseException:
            self.connection.rollback()
            raise

    @staticmethod
    def _highest(batch: DataFrame) -> int:
        return batch.agg(F.max("commit_lsn")).first()[0] or 0

    @staticmethod
    def _each(rows: Iterator) -> Iterator[tuple[int | None, str]]:
        for commit_lsn, kind, statement in rows:
            for text in split_statements(statement) if kind == "other" else [statement]:
                yield commit_lsn, text

    def close(self) -> None:
        self.connection.close()
