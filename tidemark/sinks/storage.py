"""How transactions wait on disk: one interface, plain text or gzip members."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..sources.spool import explode_statements, unpack
from .spool import finished, pack, segments


class TransactionStorage(Protocol):
    """statements: (tx_id, pos, statement)."""

    def write(self, statements: DataFrame, path: str) -> None: ...

    def read(self, spark: SparkSession, path: str, start: int = 0) -> DataFrame: ...


class PlainStorage:
    """Lines of text, a folder for each transaction and segment, read from their beginning."""

    def write(self, statements: DataFrame, path: str) -> None:
        rows = segments(statements, ["tx_id"], "pos")
        rows = rows.repartition("tx_id", "segment").sortWithinPartitions("tx_id", "segment", "pos")
        rows.select("tx_id", "segment", finished(F.col("statement")).alias("value")).write.partitionBy("tx_id", "segment").text(path)

    def read(self, spark: SparkSession, path: str, start: int = 0) -> DataFrame:
        files = spark.read.schema("value string, tx_id long, segment long").text(path, wholetext=True)
        rows = explode_statements(files.select("tx_id", "segment", "value"))
        counts = rows.groupBy(F.col("tx_id").alias("t2"), F.col("segment").alias("s2")).count()
        before = rows.select("tx_id", "segment").distinct().join(counts, (F.col("tx_id") == F.col("t2")) & (F.col("s2") < F.col("segment")), "left")
        before = before.groupBy(F.col("tx_id").alias("t3"), F.col("segment").alias("s3")).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("before"))
        rows = rows.join(before, (F.col("tx_id") == F.col("t3")) & (F.col("segment") == F.col("s3")))
        return rows.select("tx_id", (F.col("pos") + F.col("before")).alias("pos"), "statement").where(F.col("pos") >= start)


class PackedStorage:
    """Gzip members as rows of Parquet, whose statistics let a reader skip those before its place."""

    def write(self, statements: DataFrame, path: str) -> None:
        pack(statements, ["tx_id"], "pos").write.parquet(path)

    def read(self, spark: SparkSession, path: str, start: int = 0) -> DataFrame:
        return unpack(spark.read.parquet(path), ["tx_id"], start)


STORAGES: dict[str, type] = {"plain": PlainStorage, "gzip": PackedStorage}


def storage(kind: str) -> TransactionStorage:
    if kind not in STORAGES:
        raise ConfigError(f"no such storage: {kind}")
    return STORAGES[kind]()
