"""Statements of SQL text, read into their parts and written again as few: rows of one INSERT, one UPDATE, one DELETE.

Statements of a transaction form runs: neighbours of one kind on one table, with one list of columns. A run is cut where the
rows or the bytes of a packet are full. A piece of a run becomes one statement. Updates of one row in a piece are folded into the last
of them, since a join or a CASE would take one of them at random or the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import sqltext
from ..functions.dialects import Dialect
from .coalesce import byte_limit, capped_runs

_TEXTS = ArrayType(StringType())
#: What a statement is read into. head: all up to VALUES, or the table; body: the values in parentheses; clause: behind WHERE; keys: columns
#: that the clause compares for equality, null if it does anything else; moves: what the clause reads is set to another value, so that the next
#: statement may find other rows.
PARTS = StructType(
    [
        StructField("kind", StringType()), StructField("head", StringType()), StructField("body", StringType()), StructField("columns", _TEXTS), StructField("values", _TEXTS),
        StructField("clause", StringType()), StructField("keys", _TEXTS), StructField("key_values", _TEXTS), StructField("moves", BooleanType()), StructField("n_statements", LongType()),
    ]
)


#: The plainest shapes, which are read without scanning: quoted names, values without a quote in them, clauses that join equalities.
_NAME = r"""(?:"[^"]+"|`[^`]+`|\[[^\]]+\])"""
_TABLE, _EQUAL = rf"{_NAME}(?:\.{_NAME})?", rf"{_NAME} = (?:'[^']*'|-?\d+)"
_SET = rf"{_NAME} = (?:'[^']*'|-?\d+|NULL)"
_WHERE = rf"WHERE ({_EQUAL}(?: AND {_EQUAL})*);?"
_DELETE, _UPDATE = re.compile(rf"DELETE FROM ({_TABLE}) {_WHERE}"), re.compile(rf"UPDATE ({_TABLE}) SET ({_SET}(?:, {_SET})*) {_WHERE}")
_PAIR = re.compile(rf"({_NAME}) = ('[^']*'|-?\d+|NULL)")


def _plain_parts(text: str) -> dict | None:
    """statement_parts of a deletion or an update of the plainest shape, else None."""
    if (found := _DELETE.fullmatch(text)) is not None:
        made = {"kind": "delete", "head": found[1], "columns": None, "values": None, "clause": found[2]}
        new: dict[str, str] = {}
    elif (found := _UPDATE.fullmatch(text)) is not None:
        new = dict(_PAIR.findall(found[2]))
        made = {"kind": "update", "head": found[1], "columns": list(new), "values": list(new.values()), "clause": found[3]}
    else:
        return None
    where = _PAIR.findall(made["clause"])
    return made | {"body": None, "keys": [c for c, _ in where], "key_values": [v for _, v in where], "moves": any(new.get(c, v) != v for c, v in where), "n_statements": 1}


def statement_parts(text: str) -> dict:
    """The parts of one statement; kind other where it isn't one of the shapes that the renderer writes."""
    if (plain := _plain_parts(text)) is not None:
        return plain
    none = dict.fromkeys(PARTS.names) | {"moves": False, "n_statements": sqltext.count_statements(text)}
    if (found := sqltext.insert_parts(text)) is not None:
        head, values = found
        return none | {"kind": "insert", "head": head, "body": "(" + ", ".join(values) + ")", "columns": sqltext.insert_target(head)[1], "values": values}
    if (found := sqltext.update_parts(text)) is not None:
        table, pairs, clause = found
        where = sqltext.where_pairs(clause)
        new = dict(pairs)
        made = none | {"kind": "update", "head": table, "columns": list(new), "values": list(new.values()), "clause": clause}
        if where:
            return made | {"keys": [c for c, _ in where], "key_values": [v for _, v in where], "moves": any(new.get(c, v) != v for c, v in where)}
        return made | {"moves": any(c in clause for c in new)}
    if (found := sqltext.delete_parts(text)) is not None:
        where = sqltext.where_pairs(found[1]) or None
        return none | {"kind": "delete", "head": found[0], "clause": found[1]} | ({"keys": [c for c, _ in where], "key_values": [v for _, v in where]} if where else {})
    return none | {"kind": "other"}


def parsed(rows: DataFrame, column: str = "statement") -> DataFrame:
    """rows with the parts of each statement."""
    where, kinds = rows.columns.index(column), [to_arrow_type(f.dataType) for f in PARTS.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statement_parts(t or "") for t in batch.column(where).to_pylist()]
            more = [pa.array([f[n] for f in found], k) for n, k in zip(PARTS.names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *PARTS.names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *PARTS.fields]))


def added_cost(rows_kind: Column | None = None) -> Column:
    """Bytes that a statement adds to the one it is put into."""
    where, values = F.octet_length("clause"), F.aggregate("values", F.lit(0), lambda s, v: s + F.octet_length(v))
    many = F.size("columns")
    update = many * (F.lit(12) + where + F.floor(values / F.greatest(many, F.lit(1)))) + 6 + where
    kind = F.col("kind") if rows_kind is None else rows_kind
    return F.when(kind == "insert", 2 + F.octet_length("body")).when(kind == "update", update).when(kind == "delete", where + 6).otherwise(0).cast("long")


def opening_cost(column: str = "statement") -> Column:
    """What the statement that opens a piece takes beside what it adds: its own length, an INSERT with VALUES and blanks."""
    whole = F.when(F.col("kind") == "insert", F.octet_length("head") + 9 + F.octet_length("body")).otherwise(F.octet_length(column))
    return (whole - added_cost()).cast("long")


def pieces(
    rows: DataFrame, packet: int = 64 << 20, max_rows: int = 0, tx: str = "tx_id", order: str = "lsn", column: str = "statement", keep: list[str] | None = None
) -> DataFrame:
    """rows(tx, order, statement) with their parts, run and piece; keep: the columns wanted beside tx, order, run and piece, if not all."""
    rows = parsed(rows, column)
    alone = (F.col("kind") == "other") | F.col("moves")
    # As JSON, in which different values are different texts; null stands alone.
    signature = F.when(~alone, F.to_json(F.struct("kind", "head", F.when(F.col("kind") == "update", F.col("columns")).alias("c"), F.when(F.col("kind") == "update", F.col("keys")).alias("k"))))
    wanted = rows.columns if keep is None else [c for c in rows.columns if c in (tx, order, *keep)]
    costs = {"__added": added_cost(), "__opens": opening_cost(column)}
    rows = rows.select(*wanted, signature.alias("__sig"), *[c.alias(n) for n, c in costs.items()])
    return capped_runs(rows, "__sig", F.col("__added"), F.col("__opens"), byte_limit(packet), tx, order, max_rows).drop(*costs)


def _by_join(d: Dialect, keys: Column, sets: Column, head: Column, body: Column) -> Column:
    """UPDATE by a join with a derived table of the new values."""
    on = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("t."), k, F.lit(" = v."), k)), " AND ")
    target = "" if d.name == "sqlite" else "t."
    made = F.array_join(F.transform(sets, lambda c: F.concat(F.lit(target), c, F.lit(" = v."), c)), ", ")
    if d.name == "mysql":
        return F.concat(F.lit("UPDATE "), head, F.lit(" AS t JOIN ("), body, F.lit(") AS v ON "), on, F.lit(" SET "), made, F.lit(";"))
    if d.name == "sqlserver":
        return F.concat(F.lit("UPDATE t SET "), made, F.lit(" FROM "), head, F.lit(" AS t INNER JOIN ("), body, F.lit(") AS v ON "), on, F.lit(";"))
    return F.concat(F.lit("UPDATE "), head, F.lit(" AS t SET "), made, F.lit(" FROM ("), body, F.lit(") AS v WHERE "), on, F.lit(";"))


#: Dialects that can update by a join; others get CASE.
JOINING = ("mysql", "sqlserver", "sqlite")


def _by_case(rows: Column, columns: Column, head: Column) -> Column:
    """UPDATE that chooses each row's values by its clause; the last comes first, as the first that fits is taken."""
    last_first = F.reverse(rows)

    def one(c: Column, i: Column) -> Column:
        whens = F.array_join(F.transform(last_first, lambda r: F.concat(F.lit(" WHEN "), r["clause"], F.lit(" THEN "), F.get(r["values"], i))), "")
        return F.concat(c, F.lit(" = CASE"), whens, F.lit(" ELSE "), c, F.lit(" END"))

    return F.concat(F.lit("UPDATE "), head, F.lit(" SET "), F.array_join(F.transform(columns, one), ", "), F.lit(" WHERE "), _any(rows), F.lit(";"))


def _any(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("("), r["clause"], F.lit(")"))), " OR ")


def coalesced(
    rows: DataFrame, d: Dialect, packet: int = 64 << 20, max_rows: int = 0, tx: str = "tx_id", order: str = "lsn", column: str = "statement"
) -> DataFrame:
    """rows(tx, order, statement) -> (tx, run, piece, first (order), kind, n, statement): n statements written as one."""
    cut = pieces(rows, packet, max_rows, tx, order, column)
    # The last update of a clause stands for all; at the place of the last, among clauses that differ.
    later = Window.partitionBy(tx, "run", "piece", "clause").orderBy(F.desc(order))
    cut = cut.withColumn("last", (F.col("kind") != "update") | (F.row_number().over(later) == 1))
    row = F.struct(F.col(order).alias("o"), F.col(column).alias("text"), "body", "columns", "values", "clause", "keys", "key_values")
    every = F.array_sort(F.collect_list(F.when(F.col("last"), row)))
    made = cut.groupBy(tx, "run", "piece", "kind", "head").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), every.alias("rows"))
    c, first = F.col, F.col("rows")[0]
    rest = lambda r: F.filter(r["values"], lambda _, i: ~F.array_contains(r["keys"], F.get(first["columns"], i)))
    sets = F.array_except(first["columns"], first["keys"])
    value_rows = F.transform("rows", lambda r: F.concat(r["key_values"], rest(r)))
    names = F.concat(first["keys"], sets)
    selects = F.transform(value_rows, lambda v, i: F.concat(F.lit("SELECT "), F.array_join(F.when(i == 0, F.zip_with(v, names, lambda x, n: F.concat_ws(" AS ", x, n))).otherwise(v), ", ")))
    joinable = F.lit(d.name in JOINING) & first["keys"].isNotNull() & (F.size(sets) > 0)
    own = F.concat(F.regexp_replace(F.trim(first["text"]), r"(\s*;)*$", ""), F.lit(";"))
    text = (
        F.when(F.size("rows") == 1, own)
        .when(c("kind") == "insert", F.concat(c("head"), F.lit(" VALUES "), F.array_join(F.transform("rows", lambda r: r["body"]), ", "), F.lit(";")))
        .when(c("kind") == "delete", F.concat(F.lit("DELETE FROM "), c("head"), F.lit(" WHERE "), _any(c("rows")), F.lit(";")))
        .when((c("kind") == "update") & joinable, _by_join(d, first["keys"], sets, c("head"), F.array_join(selects, " UNION ALL ")))
        .when(c("kind") == "update", _by_case(c("rows"), first["columns"], c("head")))
        .otherwise(own)
    )
    return made.select(tx, "run", "piece", "first", "kind", "n", text.alias("statement"))
