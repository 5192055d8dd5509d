"""A SQLite file as a sink."""

from __future__ import annotations

import sqlite3

from ..errors import SinkError
from ..functions.dialects import SQLITE
from .registry import register_sink
from .sql import SqlSink


class SqliteConnection:
    """A file, made if it isn't there, with a write-ahead journal and foreign keys checked."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(path, isolation_level=None, check_same_thread=False)  # Spark calls from threads of its own, one at a time
        self.db.execute("PRAGMA journal_mode = WAL")
        self.db.execute("PRAGMA foreign_keys = ON")

    def _run(self, sql: str) -> sqlite3.Cursor:
        try:
            return self.db.execute(sql)
        except sqlite3.Error as error:
            raise SinkError(str(error)) from error

    def begin(self) -> None:
        self._run("BEGIN IMMEDIATE")

    def commit(self) -> None:
        if self.db.in_transaction:
            self._run("COMMIT")

    def rollback(self) -> None:
        if self.db.in_transaction:
            self._run("ROLLBACK")

    def execute(self, sql: str) -> None:
        self._run(sql)

    def query(self, sql: str) -> list[tuple]:
        return self._run(sql).fetchall()

    def close(self) -> None:
        self.db.close()


class SqliteSink(SqlSink):
    def __init__(self, path: str, mappings: dict[str, str] | None = None, batch_size: int = 0):
        super().__init__(SqliteConnection(path), SQLITE, mappings, batch_size=batch_size)


register_sink("sqlite", SqliteSink)
