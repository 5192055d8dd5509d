"""Spooled transactions as DataFrames: statements in .sql or .sql.gz files, events as lines of JSON, and their state."""

from __future__ import annotations

import gzip
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.sqltext import explode_statements
from ..operators.assemble import commit_order
from ..schema import CHANGELOG


def read_statements(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(file, pos, statement) of each file, from statement `start` on. Compressed files, of one member or several, too."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return explode_statements(files).where(F.col("pos") >= start)


def unpack(members: DataFrame, by: list[str], start: int = 0) -> DataFrame:
    """(by..., pos, statement) of members that pack made, from statement `start` of each transaction on. Members that end before it aren't read."""
    @F.pandas_udf(StringType())
    def text(data: pd.Series) -> pd.Series:
        return data.map(lambda x: gzip.decompress(x).decode())

    needed = members.where(F.col("statement_index") + F.col("n") > start)
    texts = needed.select(*by, "statement_index", text("data").alias("value"))
    rows = explode_statements(texts).withColumn("pos", F.col("statement_index") + F.col("pos")).drop("statement_index")
    return rows.where(F.col("pos") >= start)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The changelog in lines of JSON. Blank lines are passed over; a broken line is an error."""
    return spark.read.schema(CHANGELOG).option("mode", "FAILFAST").json(path)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """As read_events, for files as they come; the trigger's limit is the back-pressure."""
    return spark.readStream.schema(CHANGELOG).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """Transactions on disk in the order they are to be applied: (tx_id, commit_lsn, commit_ts, segments, applied)."""
    kind = "tx_id long, commit_lsn long, commit_ts timestamp, segments array<struct<path:string,statement_count:long>>, applied long"
    return spark.read.schema(kind).json(path).orderBy(*commit_order())


def read_open(spark: SparkSession, path: str) -> DataFrame:
    """Transactions that haven't committed, in the order their files were made: (tx_id, file, made)."""
    rows = spark.read.schema("tx_id long").json(path)
    return rows.select("tx_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("made")).orderBy("made", "tx_id")


def sync_point(points: DataFrame, targets: DataFrame, span: int | None = None) -> DataFrame:
    """targets(target) with the largest (statement_index, byte_offset) at or before each; index 0 where there is none."""
    from ..operators.resume import as_of

    found = as_of(targets, points, "target", "statement_index", ["statement_index", "byte_offset"], span)
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("statement_index", "byte_offset")})


def load_position(spark: SparkSession, path: str) -> dict | None:
    """The state that save_position wrote; None where there is no file, or it is empty or broken. Other failures are raised: to start
    afresh because a store can't be reached would apply everything again."""
    from ..sinks.spool import POSITION

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{POSITION}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        state = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()
    return state if isinstance(state, dict) and isinstance(state.get("flush_lsn"), int) else None
