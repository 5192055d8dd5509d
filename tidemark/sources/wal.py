"""A stream of log records as a Python data source: offsets are log positions, and a commit acknowledges what is applied.

The transport (the connection to the database) is a class that the caller names; what is here is what Spark needs of it.
No server can be reached from this repository's tests, so they use a transport that reads a list.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterable, Iterator
from datetime import UTC
from itertools import groupby, islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Config
from ..errors import backoff_seconds, is_transient
from ..functions.lsn import parse_lsn
from ..schema import CHANGELOG

FORMAT = "changelog"
#: Records of an Arrow batch.
ROWS = 1000
SLOT_QUERY = "SELECT restart_lsn, confirmed_flush_lsn, active FROM pg_replication_slots WHERE slot_name = '{}'"


class Transport(Protocol):
    """Built from the reader's options. It may have cuts(after, upto), positions inside the range at which it is divided among tasks; without, a
    range is one task's."""

    def confirmed(self) -> int: ...

    def latest(self) -> int: ...

    def records(self, after: int, upto: int) -> Iterable[tuple]:
        """Rows of the changelog with after < lsn <= upto."""
        ...

    def acknowledge(self, upto: int) -> None: ...


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of the changelog; a time without zone is local, as Spark has it."""
    schema, columns = to_arrow_schema(CHANGELOG), list(zip(*rows, strict=True))
    at = CHANGELOG.names.index("commit_ts")
    columns[at] = [t and t.astimezone(UTC) for t in columns[at]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Range(InputPartition):
    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        module, _, name = options["transport"].rpartition(":")
        self.transport: Transport = getattr(importlib.import_module(module), name)(dict(options))

        self.most, self.tries = int(options.get("max_positions", 0)), int(options.get("tries", 5))
        self.last: int | None = None

    def initialOffset(self) -> dict:
        return {"lsn": self.transport.confirmed()}

    def latestOffset(self) -> dict:
        """The end of the log, or max_positions behind the last offset, which is the back-pressure."""
        latest = self.transport.latest()
        if self.most:
            since = self.transport.confirmed() if self.last is None else self.last
            latest = min(latest, since + self.most)
        self.last = latest
        return {"lsn": latest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = start["lsn"], end["lsn"]
        if after >= upto:
            return []
        cuts = getattr(self.transport, "cuts", None)
        edges = sorted({after, *(c for c in (cuts(after, upto) if cuts else ()) if after < c < upto), upto})
        return [Range(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Records of the range, as Arrow batches, which Spark takes as they are."""
        records = self.records(partition)
        while rows := list(islice(records, ROWS)):
            yield _arrow(rows)

    def records(self, partition: Range) -> Iterator[tuple]:
        """Records of the range. After an error that may pass, reading goes on behind the last position that was whole."""
        after, tried = partition.after, 0
        while True:
            try:
                for lsn, rows in groupby(self.transport.records(after, partition.upto), key=lambda r: r[0]):
                    whole = list(rows)
                    yield from whole
                    after, tried = lsn, 0
                return
            except Exception as error:
                tried += 1
                if tried >= self.tries or not is_transient(error):
                    raise
                time.sleep(backoff_seconds(tried - 1) / 10)

    def commit(self, end: dict) -> None:
        self.transport.acknowledge(end["lsn"])


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return CHANGELOG

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))


def read_log(spark: SparkSession, transport: str, **options: str) -> DataFrame:
    """The log as a streaming DataFrame. transport: module:class."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format(FORMAT).options(transport=transport, **options).load()


def stream_options(config: Config) -> dict[str, str]:
    """A configuration as the reader's options."""
    return {
        "source": config.source, "slot": config.slot, "publication": config.publication, "protocol_version": str(config.protocol_version),
        "streaming": str(config.streaming).lower(), "connection_timeout": str(config.connection_timeout), "max_positions": "0",
    }


def slot_fields(restart: Column, confirmed: Column, active: Column) -> Column:
    """A slot's texts as struct<restart_lsn, confirmed_flush_lsn, active>."""
    return F.struct(
        parse_lsn(restart).alias("restart_lsn"), parse_lsn(confirmed).alias("confirmed_flush_lsn"), F.coalesce(active.isin("t", "true", "1"), F.lit(False)).alias("active")
    )


def slot_status(spark: SparkSession, url: str, slot: str, **options: str) -> DataFrame:
    """(restart_lsn, confirmed_flush_lsn, active) of a slot, as texts. The driver asks over JDBC, as a slot is one row; executors needn't reach the database.
    options: the connection's properties, and queryTimeout in seconds."""
    from ..config import valid_slot_name
    from ..errors import ConfigError
    from ..sinks.sql import JdbcConnection

    if not valid_slot_name(slot):
        raise ConfigError(f"a slot's name has a-z, 0-9 and _ only, not {slot!r}")
    timeout = int(options.pop("queryTimeout", 10))
    connection = JdbcConnection(spark, url, **options)
    try:
        found = connection.query(SLOT_QUERY.format(slot), timeout)
        connection.rollback()
    finally:
        connection.close()
    return spark.createDataFrame(found, "restart_lsn string, confirmed_flush_lsn string, active string")
