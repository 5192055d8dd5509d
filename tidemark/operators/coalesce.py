"""Runs of like changes, cut by rows and bytes, and the statements that write a run at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.dialects import Dialect

#: Part of a packet that a run may fill, and the least room it is given.
PACKET_PART, LEAST_BYTES = 0.8, 1024


def runs(rows: DataFrame, signature: Column, tx: str = "tx_id", order: str = "lsn") -> DataFrame:
    """rows with run: the number of the run of equal signatures within a transaction, from 0."""
    at = Window.partitionBy(tx).orderBy(order)
    changed = F.when(F.lag("__sig").over(at).eqNullSafe(F.col("__sig")), 0).otherwise(1)
    rows = rows.withColumn("__sig", signature).withColumn("__new", changed)
    return rows.withColumn("run", F.sum("__new").over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).drop("__sig", "__new")


def row_capped(rows: DataFrame, cap: int, by: list[str], order: str = "lsn") -> DataFrame:
    """rows with part: pieces of at most `cap` rows of each run; 0 means no cap."""
    if cap <= 0:
        return rows.withColumn("part", F.lit(0).cast("long"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("part", F.floor((n - 1) / cap).cast("long"))


def byte_limit(packet: int) -> int:
    return max(int(packet * PACKET_PART), LEAST_BYTES)


def byte_capped(rows: DataFrame, cost: Column, limit: int, by: list[str], order: str = "lsn", cap: int = 0, opening: Column | None = None) -> DataFrame:
    """rows with piece: filled greedily, a piece is closed when the next row would pass the limit (or the row cap).
    opening: what the row that opens a piece costs besides.

    Greedy filling goes row by row, so it runs over sorted partitions in Arrow batches and keeps one sum, not the rows.
    """
    rows = rows.withColumn("__cost", cost.cast("long")).withColumn("__opening", (F.lit(0) if opening is None else opening).cast("long")).repartition(*by).sortWithinPartitions(*by, order)
    places = [rows.columns.index(c) for c in by]
    where, first = rows.columns.index("__cost"), rows.columns.index("__opening")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, filled, held = None, 0, 0, 0
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in places], strict=True))
            out = []
            for key, c, o in zip(keys, batch.column(where).to_pylist(), batch.column(first).to_pylist(), strict=True):
                if key != now:
                    now, piece, filled, held = key, 0, o, 0
                elif held and (filled + c > limit or (cap and held >= cap)):
                    piece, filled, held = piece + 1, o, 0
                filled, held = filled + c, held + 1
                out.append(piece)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "piece"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("piece", LongType())])).drop("__cost", "__opening")


def capped_runs(rows: DataFrame, signature: str, cost: Column, opening: Column, limit: int, tx: str = "tx_id", order: str = "lsn", cap: int = 0) -> DataFrame:
    """What runs and byte_capped give one after the other, (run, piece), from one pass over each transaction's rows: they move and are sorted once.
    signature: a column of texts, which isn't kept; a row without one is a run of its own."""
    rows = rows.withColumn("__cost", cost.cast("long")).withColumn("__opening", opening.cast("long")).repartition(tx).sortWithinPartitions(tx, order)
    at, sign, where, first = (rows.columns.index(c) for c in (tx, signature, "__cost", "__opening"))
    kept = [i for i, c in enumerate(rows.columns) if c not in (signature, "__cost", "__opening")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, like, number, piece, filled, held = (), None, 0, 0, 0, 0
        for batch in batches:
            numbers, pieces = [], []
            for key, sig, c, o in zip(*[batch.column(i).to_pylist() for i in (at, sign, where, first)], strict=True):
                if (key,) != now:
                    now, like, number, piece, filled, held = (key,), sig, 0, 0, o, 0
                elif sig is None or sig != like:
                    like, number, piece, filled, held = sig, number + 1, 0, o, 0
                elif held and (filled + c > limit or (cap and held >= cap)):
                    piece, filled, held = piece + 1, o, 0
                filled, held = filled + c, held + 1
                numbers.append(number)
                pieces.append(piece)
            columns = [*(batch.column(i) for i in kept), pa.array(numbers, pa.int64()), pa.array(pieces, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in kept), "run", "piece"])

    fields = [rows.schema.fields[i] for i in kept]
    return rows.mapInArrow(run, StructType([*fields, StructField("run", LongType()), StructField("piece", LongType())]))


def bulk_eligible(rows: DataFrame, signature: Column, batch: list[str], threshold: int, op: str = "op") -> DataFrame:
    """(batch..., n, bulk): whether a batch is inserts of one signature, at least `threshold` of them."""
    return rows.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("n"),
        (F.bool_and(F.col(op) == "c") & (F.count_distinct(signature) == 1) & (F.count(F.lit(1)) >= threshold)).alias("bulk"),
    )


def _in_order(x: Column, order: str) -> Column:
    """A group's texts in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), x.alias("x")))), lambda p: p["x"])


def bulk_runs(rows: DataFrame, tx: str = "tx_id", order: str = "lsn") -> DataFrame:
    """rows(tx, order, change: what render.structured gives) -> (tx, run, first, kind, table, columns, n, rows): neighbouring bulk inserts into one table
    and list of columns as one, with the values of all; any other change alone."""
    bulk = F.col("change.kind") == "bulk_insert"
    signature = F.struct(F.when(bulk, F.col("change.table")).alias("t"), F.when(bulk, F.col("change.columns")).alias("c"), F.when(~bulk, F.col(order)).alias("alone"))
    each = runs(rows, signature, tx, order)
    return each.groupBy(tx, "run").agg(
        F.min(order).alias("first"), F.first("change.kind").alias("kind"), F.first("change.table").alias("table"), F.first("change.columns").alias("columns"),
        F.count(F.lit(1)).alias("n"), _in_order(F.col("change.values"), order).alias("rows"),
    )


def multi_row_insert(rows: DataFrame, by: list[str], prefix: Column, tuple_: Column, order: str = "lsn") -> DataFrame:
    """(by..., statement): one INSERT for each piece. prefix: all up to VALUES; tuple_: a row's values in parentheses."""
    return rows.groupBy(*by).agg(F.concat(F.first(prefix), F.lit(" VALUES "), F.array_join(_in_order(tuple_, order), ", "), F.lit(";")).alias("statement"))


def chunked_inserts(rows: DataFrame, by: list[str], prefix: Column, tuple_: Column, order: str = "lsn", max_bytes: int = 4 << 20, max_rows: int = 0) -> DataFrame:
    """(by..., piece, statement): INSERTs of at most max_bytes and max_rows each."""
    rows = rows.withColumn("__tuple", tuple_).withColumn("__prefix", F.concat(prefix, F.lit(" VALUES ")))
    # A row costs its length and a comma; the first has the prefix and the semicolon instead.
    rows = byte_capped(rows, F.octet_length("__tuple") + 2, max_bytes, by, order, max_rows, opening=F.octet_length("__prefix") - 1)
    return rows.groupBy(*by, "piece").agg(F.concat(F.first("__prefix"), F.array_join(_in_order(F.col("__tuple"), order), ", "), F.lit(";")).alias("statement"))


def union_all(rows: DataFrame, by: list[str], names: list[str], values: Column, order: str = "lsn") -> DataFrame:
    """(by..., statement): the body of a derived table for each group, a SELECT for each row; the first names the columns."""
    first = F.array_join(F.zip_with(values, F.array(*[F.lit(n) for n in names]), lambda v, n: F.concat_ws(" AS ", v, n)), ", ")
    parts = _in_order(F.struct(first.alias("first"), F.array_join(values, ", ").alias("plain")), order)
    body = F.transform(parts, lambda x, i: F.when(i == 0, x["first"]).otherwise(x["plain"]))
    return rows.groupBy(*by).agg(F.concat(F.lit("SELECT "), F.array_join(body, " UNION ALL SELECT ")).alias("statement"))


def last_writes(rows: DataFrame, keys: list[str], columns: list[str], order: str = "lsn") -> DataFrame:
    """(keys, columns): the last value of each, so a later update of a row wins over an earlier one."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])


def join_update(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The target after updates, unique by key; keys that the target lacks change nothing. Spark picks the join by size."""
    new = updates.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__n_{c}") for c in columns], F.lit(True).alias("__hit"))
    both = target.join(new, [F.col(k) == F.col(f"__k_{k}") for k in keys], "left")
    return both.select(*[F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def delete_rows(target: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(deleted.select(*keys).distinct(), keys, "left_anti")


def or_delete(d: Dialect, rows: DataFrame, by: list[str], table: Column, predicate: Column, order: str = "lsn") -> DataFrame:
    """(by..., statement): one DELETE for each piece, its predicates joined by OR."""
    parts = _in_order(F.concat(F.lit("("), predicate, F.lit(")")), order)
    return rows.groupBy(*by).agg(F.concat(F.lit("DELETE FROM "), F.first(table), F.lit(" WHERE "), F.array_join(parts, " OR "), F.lit(";")).alias("statement"))


def join_update_sql(d: Dialect, table: str, keys: list[str], columns: list[str], rows: list[list[str]]) -> str:
    """UPDATE by a join with a derived table of literals, each row's keys first; the shape depends on the dialect."""
    q = d.named
    names = [*keys, *columns]
    first = "SELECT " + ", ".join(f"{v} AS {q(n)}" for v, n in zip(rows[0], names, strict=True))
    body = " UNION ALL ".join([first, *["SELECT " + ", ".join(r) for r in rows[1:]]])
    on = " AND ".join(f"t.{q(k)} = v.{q(k)}" for k in keys)
    if d.name == "mysql":
        return f"UPDATE {table} AS t JOIN ({body}) AS v ON {on} SET " + ", ".join(f"t.{q(c)} = v.{q(c)}" for c in columns) + ";"
    sets = ", ".join(f"{q(c)} = v.{q(c)}" for c in columns)
    if d.name == "sqlserver":
        return f"UPDATE t SET {sets} FROM {table} AS t INNER JOIN ({body}) AS v ON {on};"
    return f"UPDATE {table} AS t SET {sets} FROM ({body}) AS v WHERE {on};"
