"""The changelog: one row for each event of a log, as batch or stream alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

#: A column's value: kind is null, text or binary.
VALUE = StructType([StructField("name", StringType()), StructField("kind", StringType()), StructField("bytes", BinaryType())])
IMAGE = ArrayType(VALUE)
IMAGE_DDL = "array<struct<name:string,kind:string,bytes:binary>>"

CHANGELOG = StructType(
    [
        StructField("lsn", LongType()),
        StructField("seq", IntegerType()),
        StructField("tx_id", LongType()),
        StructField("sub_xid", LongType()),
        StructField("commit_lsn", LongType()),
        StructField("commit_ts", TimestampType()),
        StructField("event", StringType()),
        StructField("schema", StringType()),
        StructField("table", StringType()),
        StructField("relation_oid", LongType()),
        StructField("replica_identity", StringType()),
        StructField("key_columns", ArrayType(StringType())),
        StructField("before", IMAGE),
        StructField("after", IMAGE),
        StructField("tables", ArrayType(StringType())),
    ]
)
DML = ("c", "u", "d", "t")
CONTROL = ("begin", "commit", "stream_start", "stream_stop", "stream_commit", "stream_abort")
IDENTITIES = ("default", "index", "full", "nothing")


def value(name: str | Column, content: Column, kind: str = "text") -> Column:
    """One value of an image; null content is of kind null."""
    name = F.lit(name) if isinstance(name, str) else name
    body = content.cast("binary") if kind == "binary" else content.cast("string").cast("binary")
    return F.struct(name.alias("name"), F.when(content.isNull(), "null").otherwise(kind).alias("kind"), body.alias("bytes"))


def image(**columns: Column) -> Column:
    """An image of text values, in the order given."""
    return F.array(*[value(n, c) for n, c in columns.items()]).cast(IMAGE_DDL)


def get(row: Column, name: str | Column) -> Column:
    """The value of that name in an image, or null if the image lacks it (which differs from a value of kind null)."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.get(F.filter(row, lambda v: v["name"] == name), F.lit(0))


def only_changes(column: str = "event") -> Column:
    """Rows that change data, as opposed to control rows and metadata."""
    return F.col(column).isin(*DML)
