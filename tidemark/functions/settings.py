"""Settings as text, read as column expressions; the plain forms are in config."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import mask


def slot_name_fits(name: Column) -> Column:
    return F.coalesce(name.rlike("^[a-z0-9_]+$"), F.lit(False))


@F.pandas_udf(StringType())
def masked(connection: pd.Series) -> pd.Series:
    """Connection strings with their passwords hidden."""
    return connection.map(lambda x: None if x is None else mask(x))


def _pairs(text: Column, between: str, inside: str) -> Column:
    """array<struct<a, b>> of a:b, trimmed; parts that are blank are left out."""
    parts = F.filter(F.transform(F.split(text, between), lambda x: F.trim(x)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.when(F.locate(inside, p) > 0, F.substring(p, F.lit(1), F.locate(inside, p) - 1)).otherwise(p)).alias("a"),
            F.trim(F.when(F.locate(inside, p) > 0, F.substring(p, F.locate(inside, p) + 1, F.length(p)))).alias("b"),
        ),
    )


def schema_mappings(text: Column) -> Column:
    """a:b,c:d as a map; an error where a side is missing."""
    pairs = _pairs(text, ",", ":")
    bad = F.exists(pairs, lambda p: (p["a"] == "") | F.coalesce(p["b"] == "", F.lit(True)))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a mapping of schemas: "), text))).otherwise(F.map_from_entries(pairs))


def key_columns(text: Column) -> Column:
    """schema.table:column,column;... as a map of lists; entries without columns are left out."""
    listed = F.transform(_pairs(text, ";", ":"), lambda p: F.struct(p["a"].alias("a"), F.filter(F.transform(F.split(F.coalesce(p["b"], F.lit("")), ","), lambda x: F.trim(x)), lambda c: c != "").alias("b")))
    return F.map_from_entries(F.filter(listed, lambda p: (p["a"] != "") & (F.size(p["b"]) > 0)))


def boolean(text: Column) -> Column:
    """true, 1, yes, on and their opposites; null for anything else."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)


def whole_number(text: Column) -> Column:
    """A number without sign or with plus; null for anything else."""
    x = F.trim(text)
    return F.when(x.rlike("^[+]?[0-9]+$"), x.try_cast("bigint"))
