"""Spool files: statements or events in segments, plain or compressed, with an index, and the position that is applied."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..errors import DataError
from ..operators.coalesce import byte_capped

#: Statements between two sync points. Fixed value.
SYNC_EVERY = 1000
POSITION = "position.json"
#: Bytes of a segment. Fixed value.
SEGMENT_BYTES = 64 << 20


def finished(statement) -> object:
    """Trimmed, with one semicolon behind."""
    return F.concat(F.regexp_replace(F.trim(statement), r"(\s*;)*$", ""), F.lit(";"))


def write_statements(statements: DataFrame, path: str, column: str = "statement", compress: bool = False, rows_per_segment: int = 0) -> None:
    """One statement to a line. Segments hold rows_per_segment statements at most (0: as partitions come)."""
    out = statements.select(finished(F.col(column)).alias("value"))
    if compress and out.isEmpty():
        raise DataError("no statements to write")
    writer = out.write.option("compression", "gzip" if compress else "none")
    if rows_per_segment:
        writer = writer.option("maxRecordsPerFile", rows_per_segment)
    writer.text(path)


def segments(statements: DataFrame, by: list[str], order: str, column: str = "statement", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """statements with segment: filled in order, one is closed when the next line would pass segment_bytes."""
    return byte_capped(statements, F.octet_length(finished(F.col(column))) + 1, segment_bytes, by, order).withColumnRenamed("piece", "segment")


def pack(statements: DataFrame, by: list[str], order: str, column: str = "statement", every: int = SYNC_EVERY, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(by..., segment, statement_index, n, byte_offset, data): each transaction's statements as gzip members of at most `every`. Members set one behind
    the other are a gzip file; byte_offset is a member's place in its segment's. A task holds one member."""
    rows = segments(statements.select(*by, order, finished(F.col(column)).alias("__line")), by, order, "__line", segment_bytes)
    rows = rows.repartition(*by).sortWithinPartitions(*by, order).select(*by, "segment", "__line")
    fields = [*[rows.schema[c] for c in by], *[StructField(n, LongType()) for n in ("segment", "statement_index", "n", "byte_offset")], StructField("data", BinaryType())]
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, index, offset = None, [], 0, 0

        def member() -> pa.RecordBatch:
            data = gzip.compress("".join(lines).encode(), mtime=0)
            values = [*now, index, len(lines), offset, data]
            return pa.RecordBatch.from_arrays([pa.array([v], f) for v, f in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for *key, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if lines and (key != now or len(lines) == every):
                    out = member()
                    yield out
                    index, offset = index + len(lines), offset + len(out.column(width + 4)[0].as_py())
                    lines = []
                if key != now:
                    index = index if now is not None and key[:width] == now[:width] else 0
                    now, offset = key, 0
                lines.append(line + "\n")
        if lines:
            yield member()

    from pyspark.sql.pandas.types import to_arrow_type

    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    return rows.mapInArrow(run, StructType(fields))


def index_json(members: DataFrame, by: list[str]) -> DataFrame:
    """(by..., index): where the members of each transaction begin, as JSON."""
    points = F.array_sort(F.collect_list(F.struct("statement_index", "segment", "byte_offset")))
    return members.groupBy(*by).agg(F.to_json(F.struct(F.sum("n").alias("total_statements"), points.alias("offsets"))).alias("index"))


def write_events(log: DataFrame, path: str, compress: bool = False) -> None:
    """Lines of JSON, null fields left out; no rows are fine."""
    log.write.option("compression", "gzip" if compress else "none").json(path)


def sync_points(statements: DataFrame, by: list[str], order: str, column: str = "statement", every: int = SYNC_EVERY) -> DataFrame:
    """(by..., statement_index, byte_offset): where each `every`-th statement begins in the uncompressed text."""
    at = Window.partitionBy(*by).orderBy(order)
    size = F.octet_length(finished(F.col(column))) + 1
    rows = statements.withColumn("statement_index", (F.row_number().over(at) - 1).cast("long"))
    rows = rows.withColumn("byte_offset", F.sum(size).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    return rows.where(F.col("statement_index") % every == 0).select(*by, "statement_index", "byte_offset")


def save_position(spark: SparkSession, path: str, flush_lsn: int, last_tx: int | None = None, pending: int = 0) -> None:
    """Write beside, then rename over the old file: a reader sees the old state or the new, and a crash leaves one of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{POSITION}")
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}/.{POSITION}.new")
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    beside, target = fs.makeQualified(beside), fs.makeQualified(target)
    state = {"version": 1, "last_updated": datetime.now(UTC).isoformat(), "flush_lsn": flush_lsn, "last_tx": last_tx, "pending": pending}
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    names = jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(names, "Options$Rename"), 1)
    how[0] = getattr(names, "Options$Rename").OVERWRITE
    names.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, how)
