"""Literals of SQL text as typed values, tab-separated text, and hexadecimal forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inside_quotes(x: Column) -> Column:
    """What stands between single quotes at both ends, else null."""
    return F.when((F.length(x) >= 2) & x.startswith("'") & x.endswith("'"), F.substring(x, F.lit(2), F.length(x) - 2))


def decode_hex(x: Column) -> Column:
    """X'..' or 0x.. with an even number of digits as binary, else null."""
    digits = F.coalesce(F.nullif(F.regexp_extract(x, "^[Xx]'((?:[0-9A-Fa-f]{2})+)'$", 1), F.lit("")), F.nullif(F.regexp_extract(x, "^0[xX]((?:[0-9A-Fa-f]{2})+)$", 1), F.lit("")))
    return F.unhex(digits)


def typed_literal(x: Column) -> Column:
    """struct<kind, text, i, d, b>: null, string, binary, bit, int, float, or string as it stands, tried in that order."""
    x = F.trim(x)
    quoted = F.replace(inside_quotes(x), F.lit("''"), F.lit("'"))
    low = F.lower(x)
    i = F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint"))
    d = F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double"))
    kind = (
        F.when(low == "null", "null").when(quoted.isNotNull(), "string").when(decode_hex(x).isNotNull(), "binary")
        .when(low.isin("true", "false"), "bit").when(i.isNotNull(), "int").when(d.isNotNull(), "float").otherwise("string")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "string", F.coalesce(quoted, x)).alias("text"),
        F.when(kind == "int", i).when(kind == "bit", (low == "true").cast("bigint")).alias("i"),
        F.when(kind == "float", d).alias("d"),
        F.when(kind == "binary", decode_hex(x)).alias("b"),
    )


#: What stands for characters in tab-separated text.
TSV_ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r", "\0": "\\0"}


def tsv_field(v: Column) -> Column:
    """A struct<kind, bytes> as a field for bulk loads: \\N for null, 1 and 0 for true and false, escapes elsewhere."""
    x = v["bytes"].cast("string")
    out = x
    for sign, written in TSV_ESCAPES.items():
        out = F.replace(out, F.lit(sign), F.lit(written))
    low = F.lower(x)
    return F.when((v["kind"] == "null") | x.isNull(), F.lit("\\N")).when(low == "true", F.lit("1")).when(low == "false", F.lit("0")).otherwise(out)


def tsv_line(row: Column) -> Column:
    return F.array_join(F.transform(row, tsv_field), "\t")
