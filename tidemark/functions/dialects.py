"""SQL dialects as column expressions: identifiers, values, table names and truncation.

A dialect is a set of functions from columns to columns, so whole tables of statements are rendered inside Spark.
Values follow one of two modes: `compat` writes the texts t and f as 1 and 0 whatever their column, `typed` leaves them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubled(x: Column, sign: str) -> Column:
    return F.replace(x, F.lit(sign), F.lit(sign * 2))


def _quoted(open_: str, close: str) -> Callable[[Column], Column]:
    return lambda x: F.concat(F.lit(open_), _doubled(x, close), F.lit(close))


def _hex(before: str, after: str) -> Callable[[Column], Column]:
    return lambda b: F.concat(F.lit(before), F.lower(F.hex(b)), F.lit(after))


@dataclass(frozen=True)
class Dialect:
    name: str
    quote: Callable[[Column], Column]
    hex_literal: Callable[[Column], Column]
    with_schema: bool = True
    double_backslash: bool = False
    truncate: str | None = "TRUNCATE TABLE "
    compat_booleans: bool = True
    signs: tuple[str, str] = ('"', '"')

    def named(self, name: str) -> str:
        """A quoted identifier as text."""
        return self.signs[0] + name.replace(self.signs[1], self.signs[1] * 2) + self.signs[1]

    def qualify(self, schema: Column, table: Column) -> Column:
        return F.concat_ws(".", self.quote(schema), self.quote(table)) if self.with_schema else self.quote(table)

    def text(self, x: Column) -> Column:
        """A text literal."""
        if self.double_backslash:
            x = _doubled(x, "\\")
        return F.concat(F.lit("'"), _doubled(x, "'"), F.lit("'"))

    def value(self, v: Column) -> Column:
        """A literal for a struct<kind, bytes>."""
        x = v["bytes"].cast("string")
        out = F.when((v["kind"] == "null") | v["bytes"].isNull(), F.lit("NULL"))
        if self.compat_booleans:
            out = out.when((v["kind"] == "text") & (x == "t"), F.lit("1")).when((v["kind"] == "text") & (x == "f"), F.lit("0"))
        return out.when((v["kind"] == "binary") | ~F.is_valid_utf8(x), self.hex_literal(v["bytes"])).otherwise(self.text(x))

    def truncate_table(self, schema: Column, table: Column) -> Column:
        """The statement without its end, or null where the dialect has none."""
        return F.concat(F.lit(self.truncate), self.qualify(schema, table), F.lit(";")) if self.truncate else F.lit(None).cast("string")

    def typed(self) -> Dialect:
        return replace(self, compat_booleans=False)


ANSI = Dialect("ansi", _quoted('"', '"'), _hex("X'", "'"))
MYSQL = Dialect("mysql", _quoted("`", "`"), _hex("X'", "'"), double_backslash=True, signs=("`", "`"))
SQLSERVER = Dialect("sqlserver", _quoted("[", "]"), _hex("0x", ""), signs=("[", "]"))
SQLITE = Dialect("sqlite", _quoted('"', '"'), _hex("X'", "'"), with_schema=False, truncate="DELETE FROM ")
KAFKA = Dialect("kafka", _quoted('"', '"'), _hex("X'", "'"), with_schema=False, truncate=None)

_known = {d.name: d for d in (ANSI, MYSQL, SQLSERVER, SQLITE, KAFKA)}


def register_dialect(dialect: Dialect) -> None:
    _known[dialect.name] = dialect


def dialect(name: str | None) -> Dialect:
    """The dialect of that name; ANSI where none is named or known."""
    return _known.get((name or "ansi").lower(), ANSI)
