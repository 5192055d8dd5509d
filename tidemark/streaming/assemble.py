"""Transactions from a stream of the log, and their application batch by batch.

Transactions are dealt to a fixed number of groups, which are assembled in parallel. What begins and ends in one batch stays in
memory; the rest waits in Spark's state store, in numbered parts for each transaction, until it commits. Parts are read back one by
one, and a batch that brings more of a group than may be held goes to the store as well, so a transaction of any size needs little
memory. The store is checkpointed: a restart goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..schema import CHANGELOG, DML
from ..sinks.registry import Sink, for_each_batch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDS = ("commit", "stream_commit")
#: Groups that transactions are dealt to; fixed, since checkpoints hold the state by group.
GROUPS = 4096
#: Bytes of a group's changes that are held in memory, of a part in the state store, and of what is handed on at a time; a row counts for ROW more.
HELD, PART, OUT_BYTES, ROW = 32 << 20, 1 << 20, 8 << 20, 200
COLUMNS = ("tx_id", "lsn", "event", "sub_xid", "ts", "row")
OUT = "row string, at bigint, ts string"


class Held:
    """What a batch brings of one transaction. changes: (lsn, sub_xid or "", row); in the store, one without a row drops a sub-transaction."""

    __slots__ = ("changes", "dropped", "begun", "end", "aborted")

    def __init__(self) -> None:
        self.changes: list[tuple[int | None, str, str | None]] = []
        self.dropped: set[str] = set()
        self.begun, self.end, self.aborted = -1, None, False


def _parts(changes: list) -> Iterator[str]:
    """changes as texts of about PART bytes."""
    part, size = [], 0
    for change in changes:
        part.append(change)
        size += ROW + len(change[2] or "")
        if size >= PART:
            yield json.dumps(part, ensure_ascii=False)
            part, size = [], 0
    if part:
        yield json.dumps(part, ensure_ascii=False)


class Assembler(StatefulProcessor):
    """Holds a transaction's changes as JSON; gives them out, with the commit's position and time, once it commits.

    Nothing depends on the order in which a batch's rows come: a begin drops what lies before it, an abort of a
    sub-transaction drops its rows, an abort of the whole drops all.
    """

    def __init__(self, held: int = HELD) -> None:
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a transaction's only part lies in its head; of several, each is an entry of its own
        self.heads = handle.getMapState("heads", "tx_id bigint", "begun bigint, dropped boolean, parts int, part string")
        self.parts = handle.getMapState("parts", "tx_id bigint, n int", "part string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, Held] = {}
        size = 0
        for frame in rows:
            for tx, lsn, event, sub, ts, row in zip(*[frame[c].tolist() for c in COLUMNS], strict=True):
                if (one := held.get(tx)) is None:
                    one = held[tx] = Held()
                if event in DML:
                    one.changes.append((int(lsn), sub, row))
                    size += ROW + len(row)
                    if size >= self.held:
                        self._put_off(held)
                        size = 0
                elif event == "begin":
                    one.begun = max(one.begun, int(lsn))
                elif event in ENDS:
                    one.end = (lsn, ts)
                elif sub:
                    one.dropped.add(sub)
                else:
                    one.aborted = True
        stored = self.heads.exists()
        out, size = [], 0
        for tx, one in held.items():
            head = self.heads.getValue((tx,)) if stored else None
            if one.end is None and not one.aborted:
                self._keep(tx, head, one)
                continue
            if not one.aborted:
                at, ts = int(one.end[0]), one.end[1]
                for row in self._committed(tx, head, one):
                    out.append((row, at, ts))
                    size += ROW + len(row)
                    if size >= OUT_BYTES:
                        yield self._frame(out)
                        out, size = [], 0
            one.changes = []
            self._forget(tx, head)
        if out:
            yield self._frame(out)

    def _frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["row", "at", "ts"])

    def _put_off(self, held: dict[int, Held]) -> None:
        """All changes that are held go to the store; ends and aborts wait until the batch's last row."""
        for tx, one in held.items():
            if one.changes and not one.aborted:
                self._keep(tx, self.heads.getValue((tx,)), one)
            one.changes = []

    def _keep(self, tx: int, head: tuple | None, one: Held) -> None:
        begun, dropped, parts, first = head or (-1, False, 0, None)
        texts = list(_parts(one.changes + [(None, sub, None) for sub in one.dropped]))
        if first is not None and texts:
            self.parts.updateValue((tx, 0), (first,))
            first = None
        if parts == 0 and len(texts) == 1:
            first = texts[0]
        else:
            for n, text in enumerate(texts, parts):
                self.parts.updateValue((tx, n), (text,))
        self.heads.updateValue((tx,), (max(begun, one.begun), dropped or bool(one.dropped), parts + len(texts), first))
        one.changes, one.dropped = [], set()

    def _stored(self, tx: int, head: tuple | None) -> Iterator[list]:
        _, _, parts, first = head or (-1, False, 0, None)
        for n in range(parts):
            yield json.loads(self.parts.getValue((tx, n))[0] if first is None else first)

    def _committed(self, tx: int, head: tuple | None, one: Held) -> Iterator[str]:
        since, dropped = one.begun, set(one.dropped)
        if head is not None:
            since = max(since, head[0])
            if head[1]:
                dropped.update(sub for part in self._stored(tx, head) for _, sub, row in part if row is None)
        for part in chain(self._stored(tx, head), [one.changes]):
            for lsn, sub, row in part:
                if row is not None and lsn >= since and sub not in dropped:
                    yield row

    def _forget(self, tx: int, head: tuple | None) -> None:
        if head is None:
            return
        for n in range(head[2] if head[3] is None else 0):
            self.parts.removeKey((tx, n))
        self.heads.removeKey((tx,))

    def close(self) -> None:
        pass


def use_disk_state(spark: SparkSession) -> None:
    """Maps in the state store need the store that keeps them on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def committed(log: DataFrame, held: int = HELD) -> DataFrame:
    """The changelog's changes once their transaction has committed, with its commit_lsn and commit_ts; the rest is dropped.

    log: rows that carry their transaction's tx_id (controls too). held: bytes of a group's changes in a worker's memory, about.
    """
    use_disk_state(log.sparkSession)
    known = log.where(F.col("event").isin(*DML, *ENDS, "begin", "stream_abort") & F.col("tx_id").isNotNull())
    group = F.pmod(F.xxhash64("tx_id"), F.lit(GROUPS)).cast("int").alias("group")
    # numbers that may be null travel as text: pandas would make doubles of them, which aren't exact
    text = [F.col("lsn").cast("string").alias("lsn"), F.coalesce(F.col("sub_xid").cast("string"), F.lit("")).alias("sub_xid"), F.unix_micros("commit_ts").cast("string").alias("ts")]
    packed = known.select(group, "tx_id", "event", *text, F.to_json(F.struct(*log.columns)).alias("row"))
    out = packed.groupBy("group").transformWithStateInPandas(Assembler(held), OUT, "Append", "None")
    rows = out.select(F.from_json("row", CHANGELOG).alias("r"), "at", F.timestamp_micros(F.col("ts").cast("long")).alias("ts"))
    return rows.select(*[F.col("at").alias(c) if c == "commit_lsn" else F.col("ts").alias(c) if c == "commit_ts" else F.col(f"r.{c}") for c in CHANGELOG.names])


def start(log: DataFrame, sink: Sink, checkpoint: str, boundary: int = 0, hook: Callable[[int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Apply a stream of the log to a sink. once: what is there now, then stop (an orderly shutdown)."""
    changes = committed(log)
    if boundary:
        changes = changes.where(F.col("commit_lsn") > boundary)
    writer = changes.writeStream.foreachBatch(for_each_batch(sink, hook)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
