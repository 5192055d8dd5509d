"""Counters, gauges and rates over a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def event_total(log: DataFrame) -> DataFrame:
    """(n): all events."""
    return log.agg(F.count(F.lit(1)).alias("n"))


def event_counts(log: DataFrame, event: str = "event", table: str | Column = "table") -> DataFrame:
    """(event, table, n). A truncation of several tables names them all, comma-joined."""
    table = F.col(table) if isinstance(table, str) else table
    return log.groupBy(F.col(event).alias("event"), table.alias("table")).agg(F.count(F.lit(1)).alias("n"))


def truncated_tables(tables: Column) -> Column:
    return F.array_join(tables, ",")


def error_counts(errors: DataFrame, kind: str = "kind", component: str = "component") -> DataFrame:
    return errors.groupBy(kind, component).agg(F.count(F.lit(1)).alias("n"))


def transaction_counts(log: DataFrame, tx: str = "tx_id", is_final: Column | None = None) -> DataFrame:
    """(processed, complete): transactions seen, and those with a final part."""
    final = is_final if is_final is not None else F.lit(True)
    return log.agg(F.count_distinct(tx).alias("processed"), F.count_distinct(F.when(final, F.col(tx))).alias("complete"))


def event_rate(log: DataFrame, at: str = "ts", seconds: int = 60) -> DataFrame:
    """(window_start, per_second) over windows of event time."""
    w = F.window(at, f"{seconds} seconds")
    return log.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), (F.col("n") / seconds).alias("per_second"))


def flush_progress(commits: DataFrame, at: str, by: str) -> DataFrame:
    """The largest position so far in each of `by`, in the order of `at`'s companion column seq; zeros don't count."""
    so_far = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return commits.withColumn("flush_lsn", F.max(F.when(F.col(at) > 0, F.col(at))).over(so_far))


def pending(commits: DataFrame, finals: DataFrame) -> DataFrame:
    """(pending): commits less finalised ones, never below zero."""
    delta = commits.select(F.lit(1).alias("d")).unionAll(finals.select(F.lit(-1).alias("d")))
    return delta.agg(F.greatest(F.lit(0), F.coalesce(F.sum("d"), F.lit(0))).cast("long").alias("pending"))


def latest(gauges: DataFrame, name: str, value: str, at: str) -> DataFrame:
    """(name, value): the last value of each gauge."""
    return gauges.groupBy(name).agg(F.max_by(value, at).alias(value))


#: Upper ends of the buckets of a duration, in seconds. Fixed values.
BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def duration_histogram(rows: DataFrame, value: str, by: list[str], buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(by..., le, n): rows at or below each end, and all of them under +Inf."""
    ends = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.lit(float(b)).alias("end")) for b in buckets], F.struct(F.lit("+Inf").alias("le"), F.lit(float("inf")).alias("end")))
    counts = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate((*buckets, float("inf")))])
    each = F.explode(F.arrays_zip(ends.alias("e"), F.array(*[F.col(f"b{i}") for i in range(len(buckets) + 1)]).alias("n"))).alias("x")
    return counts.select(*by, each).select(*by, F.col("x.e.le").alias("le"), F.col("x.n").alias("n"))


def segment_counts(statements: DataFrame, segment: str = "segment") -> DataFrame:
    return statements.groupBy(segment).agg(F.count(F.lit(1)).alias("n_statements"))


def replication_lag(now: Column, last_commit: Column) -> Column:
    """Seconds behind the source."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(last_commit)) / 1e6)
