"""Schema and table names, and changes of columns on the way to a sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SCHEMA = "public"


def map_schema(schema: Column, mappings: Mapping[str, str]) -> Column:
    """The mapped schema; unmapped ones pass, null is the default schema (mapped too)."""
    schema = F.coalesce(schema, F.lit(DEFAULT_SCHEMA))
    if not mappings:
        return schema
    pairs = [F.lit(x) for pair in sorted(mappings.items()) for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), schema), schema)


def table_spec(spec: Column, mappings: Mapping[str, str] | None = None) -> Column:
    """struct<schema, table>: split at the dot if there is exactly one, else the default schema and the whole."""
    parts = F.split(spec, r"\.")
    one = F.size(parts) == 2
    return F.struct(
        map_schema(F.when(one, parts[0]).otherwise(DEFAULT_SCHEMA), mappings or {}).alias("schema"), F.when(one, parts[1]).otherwise(spec).alias("table")
    )


@dataclass(frozen=True)
class Transformation:
    """kind: identity, uppercase, lowercase, function, static or null. argument: a function of a column, or the value."""

    source: str
    target: str
    kind: str = "identity"
    argument: object = None

    def apply(self, x: Column) -> Column:
        made: dict[str, Callable[[], Column]] = {
            "identity": lambda: x,
            "uppercase": lambda: F.upper(x),
            "lowercase": lambda: F.lower(x),
            "function": lambda: self.argument(x),
            "static": lambda: F.lit(self.argument),
            "null": lambda: F.lit(None).cast("string"),
        }
        if self.kind not in made:
            raise ValueError(f"no such transformation: {self.kind}")
        return made[self.kind]()


@dataclass(frozen=True)
class TableMapping:
    """How a table's rows change on their way: names, columns left out, and transformations; off if not enabled."""

    schema: str | None = None
    table: str | None = None
    columns: Mapping[str, str] = field(default_factory=dict)
    excluded: Sequence[str] = ()
    transformations: Sequence[Transformation] = ()
    enabled: bool = True

    def apply(self, rows: DataFrame) -> DataFrame:
        if not self.enabled:
            return rows.where(F.lit(False))
        made = {t.source: t for t in self.transformations}
        out = []
        for c in rows.columns:
            if c in self.excluded:
                continue
            t = made.get(c)
            out.append(t.apply(F.col(c)).alias(t.target) if t else F.col(c).alias(self.columns.get(c, c)))
        return rows.select(*out)


def from_origin(origin: Column, wanted: str | Sequence[str] | None) -> Column:
    """Rows to keep: wanted `any` keeps all, `none` those without an origin, else those of that origin or of any in the list."""
    if wanted is None or wanted == "any":
        return F.lit(True)
    if wanted == "none":
        return origin.isNull()
    return F.coalesce(origin.isin(*([wanted] if isinstance(wanted, str) else wanted)), F.lit(False))
