"""The net effect of a batch: what its changes leave of each row, as few changes of the changelog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IMAGE_DDL, get

#: Rows are dealt to so many groups by their key; a group's changes are written as statements apart. Fixed value.
GROUPS = 32


def _keys_of(row: str) -> Column:
    """The values of the key columns in an image, null if it lacks one or one is null."""
    found = F.transform("key_columns", lambda k: get(F.col(row), k))
    return F.when(F.forall(found, lambda v: v.isNotNull() & (v["kind"] != "null")), found)


def can_fold(rows: DataFrame) -> bool:
    """Whether every change is of one row that a key finds, by the same columns throughout its table, and none gives a row another key or cuts a table."""
    before, after, event = _keys_of("before"), _keys_of("after"), F.col("event")
    stays = F.col("before").isNull() | F.coalesce(before == after, F.lit(False))
    plain = F.when(event == "c", after.isNotNull()).when(event == "u", after.isNotNull() & stays).when(event == "d", before.isNotNull()).otherwise(False)
    plain = F.coalesce(plain & F.col("replica_identity").isin("default", "index") & (F.size("key_columns") > 0), F.lit(False))
    tables = rows.groupBy("schema", "table").agg(F.bool_and(plain).alias("plain"), F.min("key_columns").alias("a"), F.max("key_columns").alias("z"))
    return tables.where(~(F.col("plain") & (F.col("a") == F.col("z")))).isEmpty()


def net_changes(rows: DataFrame, at: Column) -> DataFrame:
    """Changes that can_fold, ordered by at -> (tx, at, event, schema, table, ...): at most a deletion and a create, or one update, of each row.

    Behind its last create a row is that create's image with the later values of columns; it is deleted first if the batch deleted it. Behind
    its last deletion updates do nothing. Without either, all updates are one. A column's last value counts if it isn't older than the create.
    """
    key = F.when(F.col("event") == "d", _keys_of("before")).otherwise(_keys_of("after"))
    by = ["schema", "table", "key_columns", "key"]
    edge = F.when(F.col("event").isin("c", "d"), F.struct(F.col("o"), F.col("event").alias("e")))
    # By column and then by row, so that no task holds the changes of a row.
    each = rows.select(*by[:3], key.alias("key"), at.alias("o"), "event", F.posexplode_outer(F.when(F.col("event") != "d", F.col("after"))).alias("i", "v"))
    columns = each.groupBy(*by, F.col("v.name").alias("name")).agg(
        F.max("o").alias("o"), F.max_by(F.struct("i", "v"), "o").alias("x"), F.max(edge).alias("edge"), F.bool_or(F.col("event") == "d").alias("gone")
    )
    value = F.when(F.col("name").isNotNull(), F.struct(F.col("x.i").alias("i"), F.col("name"), F.col("o"), F.col("x.v").alias("v")))
    whole = columns.groupBy(*by).agg(F.max("edge").alias("edge"), F.bool_or("gone").alias("gone"), F.array_sort(F.collect_list(value)).alias("values"))
    new = F.transform(F.filter("values", lambda x: F.col("edge").isNull() | (x["o"] >= F.col("edge.o"))), lambda x: x["v"]).cast(IMAGE_DDL)
    kept = F.col("key").cast(IMAGE_DDL)
    none = F.lit(None).cast(IMAGE_DDL)
    one = lambda n, event, before, after: F.struct(F.lit(n).alias("n"), F.lit(event).alias("event"), before.alias("before"), after.alias("after"))
    delete, create, update = one(0, "d", kept, none), one(2, "c", none, F.col("new")), one(1, "u", kept, F.col("new"))
    last = F.col("edge.e")
    made = F.when(last.isNull(), F.array(update)).when(last == "d", F.array(delete)).when(F.col("gone"), F.array(delete, create)).otherwise(F.array(create))
    out = whole.withColumn("new", new).select(*by, F.explode(made).alias("m"))
    names = F.transform("m.after", lambda v: v["name"])
    return out.select(
        F.struct(F.lit(None).cast("long").alias("commit_lsn"), F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("tx_id")).alias("tx"),
        F.struct(F.col("m.n"), F.col("schema"), F.col("table"), names.alias("names"), F.col("key")).alias("at"),
        F.col("m.event").alias("event"), "schema", "table", F.lit("default").alias("replica_identity"), "key_columns", F.col("m.before").alias("before"), F.col("m.after").alias("after"),
        F.lit(None).cast("array<string>").alias("tables"),
    )
