"""Where to go on after a stop: what is on disk against what the slot confirms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOT, SLOT_GONE, QUERY_FAILED, FRESH = "slot", "slot_deleted_fallback", "query_failed_fallback", "fresh"


def resume_decision(disk: Column, slot_state: Column, confirmed: Column) -> Column:
    """struct<start_lsn, dedup_boundary, source>. slot_state: found, absent, or failed.

    A slot that is found says where to start; what is applied is the later of slot and disk. Without a slot, the disk says
    what is applied and the server where to start; without either, all is new.
    """
    found = slot_state == "found"
    source = F.when(found, SLOT).when(disk.isNull(), FRESH).when(slot_state == "absent", SLOT_GONE).otherwise(QUERY_FAILED)
    return F.struct(
        F.when(found, confirmed).alias("start_lsn"),
        F.when(found, F.greatest(F.coalesce(disk, F.lit(0)), F.coalesce(confirmed, F.lit(0)))).otherwise(F.coalesce(disk, F.lit(0))).cast("long").alias("dedup_boundary"),
        source.alias("source"),
    )


def replayed_then_live(pending: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of transactions that were left on disk, then those of the log, as one: turn says which come first. A transaction that is in
    both is taken from the disk, where its progress is kept."""
    fresh = live.join(pending.select("tx_id").distinct(), "tx_id", "left_anti")
    return pending.withColumn("turn", F.lit(0)).unionByName(fresh.withColumn("turn", F.lit(1)))


def skip_applied(statements: DataFrame, applied: int, index: str = "pos") -> DataFrame:
    """Statements from the count applied on."""
    return statements.where(F.col(index) >= applied)


def batches(rows: DataFrame, tx: str, order: str, size: int) -> DataFrame:
    """rows with batch_index and progress: batches of `size` within a transaction, and its rows done after each batch."""
    at = Window.partitionBy(tx).orderBy(order)
    n = F.row_number().over(at)
    last = F.count(F.lit(1)).over(Window.partitionBy(tx))
    batch = F.floor((n - 1) / size).cast("long")
    return rows.withColumn("batch_index", batch).withColumn("progress", F.least((batch + 1) * size, last).cast("long"))


def as_of(left: DataFrame, right: DataFrame, left_at: str, right_at: str, values: list[str], span: int | None = None) -> DataFrame:
    """left with the values of the last right row at or before it.

    Both sides are put in one order and the last right row is carried forward, so no pair of rows is formed and no task
    holds more than a span.
    """
    from .assemble import carry_forward

    l = left.select("*", F.col(left_at).cast("long").alias("__at"), F.lit(1).alias("__side"))
    r = right.select(F.col(right_at).cast("long").alias("__at"), F.lit(0).alias("__side"), F.struct(right_at, *[c for c in values if c != right_at]).alias("__right"))
    both = l.unionByName(r, allowMissingColumns=True)
    out = carry_forward(both, F.col("__right"), "__found", order="__at", span=span, tie=["__side"])
    return out.where("__side = 1").select(*left.columns, *[F.col("__found")[c].alias(c) for c in values])
