"""Transactions from an ordered log: owners of rows, commits, aborts, order, and what is already applied.

A log is one order, but no task may hold all of it. State carried along the order (whose chunk is open, which transaction
has begun) is filled in two steps: positions are cut into spans, a span's last state is summed up, the few sums are run
through in order, and each span then starts from the state before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a span is meant to hold, and spans of a log at least and at most: one task sums up the spans.
SPAN_ROWS, FEWEST, MOST = 10_000, 8, 100_000


def span_of(log: DataFrame, order: str) -> tuple[int, int]:
    """(first position, positions in a span) for a log, from its range and its number of rows."""
    low, high, rows = log.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    if low is None:
        return 0, 1
    spans = max(FEWEST, min(MOST, rows // SPAN_ROWS))
    return int(low), max(1, -(-(int(high) - int(low) + 1) // spans))


def _span(order: str, low: int, size: int) -> Column:
    return F.coalesce(F.floor((F.col(order) - low) / F.lit(size)), F.lit(-1)).cast("long")


def carry_forward(log: DataFrame, state: Column, name: str, order: str = "lsn", span: int | None = None, by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """log with the last non-null state at or before each row, along `order` (then tie), within each of `by` (a slot or stream).
    span: positions in a span; by default the log's range tells."""
    by, tie = by or [], tie or []
    low, size = (0, span) if span else span_of(log, order)
    rows = log.withColumn("__state", state).withColumn("__span", _span(order, low, size))
    at = F.struct(order, *tie)
    sums = rows.groupBy(*by, "__span").agg(F.max_by("__state", F.when(F.col("__state").isNotNull(), at)).alias("__last"))
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__span").alias("__s"), F.last("__last", ignorenulls=True).over(earlier).alias("__before"))
    same = [F.col("__span") == F.col("__s"), *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]]
    within = Window.partitionBy(*by, "__span").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(sums, same, "left")
    filled = F.coalesce(F.last("__state", ignorenulls=True).over(within), F.col("__before"))
    return out.withColumn(name, filled).select(*log.columns, name)


def numbered(rows: DataFrame, name: str, order: str, tie: list[str] | None = None) -> DataFrame:
    """rows with their place, from 1, along order (then tie): a span's rows are numbered apart, behind the count of all spans before it."""
    tie = tie or []
    low, size = span_of(rows, order)
    rows = rows.withColumn("__span", _span(order, low, size))
    before = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("__span")) - F.col("count")
    sums = rows.groupBy("__span").count().select(F.col("__span").alias("__s"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__span").orderBy(order, *tie)) + F.col("__before")
    return rows.join(sums, F.col("__span") == F.col("__s")).withColumn(name, place.cast("long")).drop("__span", "__s", "__before")


def in_commit_order(rows: DataFrame, name: str = "place") -> DataFrame:
    """rows(tx_id, commit_lsn, ...) with their place in the order that transactions are applied in."""
    known = rows.where("commit_lsn is not null")
    first = known.count()
    rest = numbered(rows.where("commit_lsn is null"), name, "tx_id").withColumn(name, F.col(name) + first)
    return numbered(known, name, "commit_lsn", ["tx_id"]).unionByName(rest)


def owners(log: DataFrame, order: str = "lsn", span: int | None = None, by: list[str] | None = None) -> DataFrame:
    """log with owner: the transaction that a row belongs to, null for a row outside of any.

    An open normal transaction comes first, else the streamed one whose chunk is open. A begin while one is open replaces
    it. -1 in the carried state means closed.
    """
    normal = F.when(F.col("event") == "begin", F.col("tx_id")).when(F.col("event") == "commit", F.lit(-1))
    chunk = F.when(F.col("event") == "stream_start", F.col("tx_id")).when(F.col("event") == "stream_stop", F.lit(-1))
    out = carry_forward(carry_forward(log, normal.cast("long"), "__normal", order, span, by), chunk.cast("long"), "__chunk", order, span, by)
    owner = F.coalesce(F.nullif("__normal", F.lit(-1)), F.nullif("__chunk", F.lit(-1)))
    return out.withColumn("owner", owner).drop("__normal", "__chunk")


def orphans(log: DataFrame) -> DataFrame:
    """Changes outside of any transaction, which are dropped with a warning; log has owner."""
    from ..schema import only_changes

    return log.where(only_changes() & F.col("owner").isNull())


def without_aborted(changes: DataFrame, aborts: DataFrame) -> DataFrame:
    """changes(tx_id, sub_xid?) without those of aborts(tx_id, sub_xid): an abort without sub_xid takes the transaction."""
    whole = aborts.where("sub_xid is null").select("tx_id").distinct()
    parts = aborts.where("sub_xid is not null").select("tx_id", "sub_xid").distinct()
    out = changes.join(whole, "tx_id", "left_anti")
    return out.join(parts, ["tx_id", "sub_xid"], "left_anti") if "sub_xid" in changes.columns else out


def commit_order() -> list[Column]:
    """Commit position, those without one last, then transaction id."""
    return [F.asc_nulls_last("commit_lsn"), F.asc("tx_id")]


def transactions(changes: DataFrame, order: str = "lsn") -> DataFrame:
    """changes(tx_id, order, op) -> (tx_id, n_events, first_lsn, commit_lsn, ops): ops in order, comma-joined."""
    ops = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "op"))), lambda x: x["op"]), ",")
    return changes.groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min(order).alias("first_lsn"), F.max(order).alias("commit_lsn"), ops.alias("ops")
    )


def not_applied(rows: DataFrame, boundary: int) -> DataFrame:
    """Rows of transactions beyond the boundary, or without a position; all, if the boundary is 0. Reaches the scan as a filter."""
    return rows.where(F.col("commit_lsn").isNull() | (F.col("commit_lsn") > boundary)) if boundary > 0 else rows
