"""Change events as keyed messages: topic, key and value of each, in the schema-and-payload form of connectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import get
from .mapping import map_schema, table_spec

CONNECTOR, VERSION = "tidemark", "1"
#: Tables whose learned keys are broadcast, and tasks that a table's rows are dealt to where there are more.
MOST_TABLES, SALTS = 20_000, 64
#: The source block's fields: name, type, optional. Fixed values.
SOURCE_FIELDS = (
    ("version", "string", False), ("connector", "string", False), ("name", "string", False), ("ts_ms", "int64", False), ("db", "string", False),
    ("schema", "string", True), ("table", "string", False), ("txId", "int64", True), ("lsn", "int64", True),
)


def json_value(v: Column) -> Column:
    """A value as a JSON string or null: text as it is, bytes and broken text in base64."""
    text = v["bytes"].cast("string")
    return F.when((v["kind"] == "null") | v["bytes"].isNull(), F.lit(None).cast("string")).when((v["kind"] == "text") & F.is_valid_utf8(text), text).otherwise(F.base64(v["bytes"]))


def _string(x: Column) -> Column:
    """A JSON string literal, or null."""
    written = F.to_json(F.struct(x.alias("x")))
    return F.when(x.isNull(), F.lit("null")).otherwise(F.substring(written, F.lit(6), F.length(written) - 6))


def row_json(row: Column) -> Column:
    """An image as a JSON object in its own order; null for no image."""
    parts = F.transform(row, lambda v: F.concat(_string(v["name"]), F.lit(":"), _string(json_value(v))))
    return F.when(row.isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def field_schema(row: Column) -> Column:
    """array<struct<type, optional, field>> of an image."""
    kind = lambda v: F.when(v["kind"] == "binary", "bytes").otherwise("string")
    return F.transform(row, lambda v: F.struct(kind(v).alias("type"), F.lit(True).alias("optional"), v["name"].alias("field")))


def topic(prefix: str, schema: Column, table: Column, suffix: str = "") -> Column:
    """prefix.schema.table, or with .Key or .Envelope behind."""
    parts = [F.lit(prefix), schema, table, *([F.lit(suffix)] if suffix else [])]
    return F.concat_ws(".", *parts)


def learned_keys(log: DataFrame, configured: Mapping[str, Sequence[str]] | None = None, order: str = "lsn", by: Sequence[str] = ("schema", "table")) -> DataFrame:
    """log with effective_keys: configured ones; else an update's or delete's own; else, for a create, those of the table's
    first update or delete so far.

    Learning needs only each table's first row with keys, so it is an aggregate and a join, not a window over the table. What is learned is
    fetched, so that it can be broadcast: a log has few tables, and by a shuffle all rows of a table would meet in one task. Beyond the bound, a
    table's rows are dealt to SALTS tasks.
    """
    own = F.col("event").isin("u", "d") & (F.size(F.coalesce("key_columns", F.array().cast("array<string>"))) > 0)
    first = log.where(own).groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(order).alias("__since"), F.min_by("key_columns", order).alias("__keys"))
    same, known = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], first.limit(MOST_TABLES + 1).collect()
    if len(known) <= MOST_TABLES:
        out = log.join(F.broadcast(log.sparkSession.createDataFrame(known, first.schema)), same, "left")
    else:
        dealt = first.withColumn("__n", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        out = log.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int")).join(dealt, [*same, F.col("__salt") == F.col("__n")], "left")
    found = F.when(own, F.col("key_columns")).when((F.col("event") == "c") & (F.col("__since") <= F.col(order)), F.col("__keys"))
    if configured:
        pairs = [x for t, cols in sorted(configured.items()) for x in (F.lit(t), F.array(*[F.lit(c) for c in cols]))]
        found = F.coalesce(F.element_at(F.create_map(*pairs), F.concat_ws(".", *by)), found)
    return out.withColumn("effective_keys", found).select(*log.columns, "effective_keys")


def message_key(name: Column, keys: Column, row: Column) -> Column:
    """The key as JSON: the key columns that the row has, null if there is none."""
    there = F.filter(keys, lambda k: get(row, k).isNotNull())
    fields = F.transform(there, lambda k: F.struct(F.lit("string").alias("type"), F.lit(False).alias("optional"), k.alias("field")))
    schema = F.to_json(F.struct(F.lit("struct").alias("type"), fields.alias("fields"), F.lit(False).alias("optional"), name.alias("name")))
    payload = row_json(F.transform(there, lambda k: get(row, k)))
    return F.when(F.size(there) > 0, F.concat(F.lit('{"schema":'), schema, F.lit(',"payload":'), payload, F.lit("}")))


def envelope(log: DataFrame, prefix: str, db: str, mappings: Mapping[str, str] | None = None, keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(topic, key, value, lsn, seq): one message for each changed row, and one without a key for each truncated table."""
    rows = log.where(F.col("event").isin("c", "u", "d", "t"))
    spec = table_spec(F.col("__t"))
    truncated = rows.where(F.col("event") == "t").withColumn("__t", F.explode("tables")).withColumn("schema", spec["schema"]).withColumn("table", spec["table"]).drop("__t")
    rows = learned_keys(rows.where(F.col("event") != "t").unionByName(truncated), keys)
    schema, table = map_schema(F.col("schema"), mappings or {}), F.col("table")
    before = F.when(F.col("event") == "c", None).otherwise(F.col("before"))
    after = F.when(F.col("event") == "d", None).otherwise(F.col("after"))
    ts = F.unix_millis("commit_ts")
    source = F.to_json(
        F.struct(
            F.lit(VERSION).alias("version"), F.lit(CONNECTOR).alias("connector"), F.lit(prefix).alias("name"), ts.alias("ts_ms"), F.lit(db).alias("db"),
            schema.alias("schema"), table.alias("table"), F.col("tx_id").alias("txId"), F.col("commit_lsn").alias("lsn"),
        ),
        {"ignoreNullFields": "false"},
    )
    # Images and field lists are made once, behind a projection; the two parts of the schema share one list.
    fields = F.coalesce(field_schema(after), field_schema(before), F.array().cast("array<struct<type:string,optional:boolean,field:string>>"))
    rows = rows.withColumns({"__fields": F.to_json(fields), "__before": row_json(before), "__after": row_json(after)})
    part = lambda name: F.concat(F.lit('{"type":"struct","fields":'), F.col("__fields"), F.lit(f',"optional":true,"field":"{name}"}}'))
    fixed = "[" + ",".join(f'{{"type":"{t}","optional":{str(o).lower()},"field":"{n}"}}' for n, t, o in SOURCE_FIELDS) + "]"
    shape = F.concat(
        F.lit('{"type":"struct","fields":['), part("before"), F.lit(","), part("after"),
        F.lit(f',{{"type":"struct","fields":{fixed},"optional":false,"field":"source"}},{{"type":"string","optional":false,"field":"op"}},{{"type":"int64","optional":true,"field":"ts_ms"}}],"optional":false,"name":'),
        _string(topic(prefix, schema, table, "Envelope")), F.lit("}"),
    )
    payload = F.concat(
        F.lit('{"before":'), F.col("__before"), F.lit(',"after":'), F.col("__after"), F.lit(',"source":'), source, F.lit(',"op":"'), F.col("event"),
        F.lit('","ts_ms":'), F.coalesce(ts.cast("string"), F.lit("null")), F.lit("}"),
    )
    return rows.select(
        topic(prefix, schema, table).alias("topic"),
        F.when(F.col("event") != "t", message_key(topic(prefix, schema, table, "Key"), F.col("effective_keys"), F.coalesce(before, after))).alias("key"),
        F.concat(F.lit('{"schema":'), shape, F.lit(',"payload":'), payload, F.lit("}")).alias("value"),
        "lsn",
        "seq",
    )
