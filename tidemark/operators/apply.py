"""Replay of committed row changes into final table state, as joins and aggregates.

One aggregate per key finds the last deletion, the last creation behind it, and the last values; so a replay is one
shuffle of the log and, with a base table, one join. An update never makes a row: it is lost on a key that isn't alive.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

WRITES = ("c", "u")


def _writes() -> Column:
    return F.col("op").isin(*WRITES)


def replay(log: DataFrame, keys: list[str], order: list[str], columns: list[str], barrier: Column | None = None) -> DataFrame:
    """log(keys, order columns, op, after struct of full images) -> the live rows: keys, columns, last_lsn.

    barrier: an order struct; what came before it (a truncation) is gone.
    """
    at = F.struct(*order)
    if barrier is not None:
        log = log.where(at > barrier)
    marks = log.groupBy(*keys).agg(
        F.max(F.when(F.col("op") == "d", at)).alias("last_d"),
        F.max(F.when(F.col("op") == "c", at)).alias("last_c"),
        F.max(F.when(_writes(), at)).alias("last_at"),
        F.max_by("after", F.when(_writes(), at)).alias("image"),
    )
    alive = F.col("last_c").isNotNull() & (F.col("last_d").isNull() | (F.col("last_c") > F.col("last_d")))
    return marks.where(alive).select(*keys, *[F.col("image")[c].alias(c) for c in columns], F.col("last_at")[order[-1]].alias("last_lsn"))


def replay_onto(base: DataFrame, log: DataFrame, keys: list[str], order: list[str], columns: list[str], present: dict[str, Column] | None = None, null_safe: bool = False) -> DataFrame:
    """The base table after the log: keys and columns.

    log has one column for each of `columns`. present says, for each column, whether a row's image has it; a column that an
    image lacks keeps its value. A row lives if a creation follows its last deletion, or if there is neither and the base
    has it. null_safe joins keys as equal where both are null (full row identity); plain keys never match on null.

    The log is folded twice over the same partitioning: once for the last deletion and creation, once for each column's
    last value at or after the row's start.
    """
    at = F.struct(*order)
    present = present or {}
    marks = log.groupBy(*keys).agg(
        F.max(F.when(F.col("op") == "d", at)).alias("last_d"),
        # Everything in order, so the start of the present life is found in one pass: the last creation behind the last deletion.
        F.max(F.when(F.col("op") == "c", at)).alias("last_c"),
        *[
            F.max(F.when(_writes() & present.get(c, F.lit(True)), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(f"last_{c}")
            for c in columns
        ],
    )
    created = F.col("last_c").isNotNull() & (F.col("last_d").isNull() | (F.col("last_c") > F.col("last_d")))
    k = {c: f"__k_{c}" for c in keys}
    b = base.select(*[F.col(c).alias(k[c]) for c in keys], *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(True).alias("__in"))
    same = [F.col(c).eqNullSafe(F.col(k[c])) if null_safe else F.col(c) == F.col(k[c]) for c in keys]
    both = marks.join(b, same, "full_outer")
    in_base = F.coalesce(F.col("__in"), F.lit(False))
    alive = F.coalesce(created, F.lit(False)) | (F.col("last_d").isNull() & in_base)
    out = []
    for c in columns:
        last, start = F.col(f"last_{c}"), F.col("last_c")
        fresh = F.coalesce(created, F.lit(False))
        from_log = last.isNotNull() & (~fresh | (last["at"] >= start))
        out.append(F.when(from_log, last["v"]).when(~fresh, F.col(f"__b_{c}")).alias(c))
    return both.where(alive).select(*[F.coalesce(c, k[c]).alias(c) for c in keys], *out)


def truncations(log: DataFrame) -> DataFrame:
    """(schema, table, lsn): the last truncation of each table; a truncation of several tables counts for each."""
    from .mapping import table_spec

    spec = table_spec(F.col("t"))
    return log.where(F.col("event") == "t").select(F.explode("tables").alias("t"), "lsn").groupBy(spec["schema"].alias("schema"), spec["table"].alias("table")).agg(F.max("lsn").alias("lsn"))


def split_key_changes(log: DataFrame, keys: list[str], old: str = "old_") -> DataFrame:
    """log(op, keys, old_<key>...) with every update that changes its key as a deletion of the old and a creation of the new.

    part orders the two at one position. It holds where the old row is alive and the image is full, as it is when keys change
    under default identity; a row that isn't alive must not be updated in the first place.
    """
    differs = [F.col(f"{old}{k}").isNotNull() & ~F.col(f"{old}{k}").eqNullSafe(F.col(k)) for k in keys]
    moved = (F.col("op") == "u") & reduce(or_, differs)
    both = F.array(F.struct(F.lit("d").alias("o"), F.lit(0).alias("p")), F.struct(F.lit("c").alias("o"), F.lit(1).alias("p")))
    rows = log.withColumn("__x", F.explode(F.when(moved, both).otherwise(F.array(F.struct(F.col("op").alias("o"), F.lit(0).alias("p"))))))
    named = {k: F.when((F.col("__x.o") == "d") & moved, F.col(f"{old}{k}")).otherwise(F.col(k)) for k in keys}
    return rows.withColumns(named | {"op": F.col("__x.o"), "part": F.col("__x.p")}).drop("__x", *[f"{old}{k}" for k in keys])


def replay_rows(base: DataFrame, log: DataFrame, columns: list[str], order: list[str], by: list[str]) -> DataFrame:
    """The base after the log for a table without a key, where whole rows identify and equal rows stand together.

    log(op, order, columns, old_<column>...): a create adds a row, an update turns every row equal to its old image into the
    new one, a deletion takes every equal row. Such changes depend on each other through their values, so they run one after
    the other inside each group of `by`: columns of the table that no update changes (a tenant, a day). Groups must be small
    enough for a task; with by=[] the whole table is one group.
    """
    held = base.groupBy(*columns).count().select(*columns, F.col("count").alias("__n"))
    rows = log.select("op", *order, *columns, *[f"old_{c}" for c in columns])
    both = rows.unionByName(held, allowMissingColumns=True)
    group = [F.coalesce(F.col(c), F.col(f"old_{c}")).alias(f"__g{i}") for i, c in enumerate(by)] or [F.lit(0).alias("__g0")]
    schema = base.select(*columns).schema

    names = [*columns, "__n"]
    kinds = StructType([*schema.fields, StructField("__n", LongType())])

    def run(table: pa.Table) -> pa.Table:
        def images(prefix: str, where: pa.Table) -> list[tuple]:
            return list(zip(*[where.column(f"{prefix}{c}").to_pylist() for c in columns], strict=True))

        def same(row: tuple) -> tuple:  # not-a-numbers are equal, as in a table
            return tuple("nan" if isinstance(v, float) and v != v else json.dumps(v, default=str) if isinstance(v, (list, dict)) else (type(v), v) for v in row)

        start = pc.is_valid(table.column("__n"))
        held = table.filter(start)
        counts = {same(row): [row, n] for row, n in zip(images("", held), held.column("__n").to_pylist(), strict=True)}
        moves = table.filter(pc.invert(start)).sort_by([(c, "ascending") for c in order])
        for op, new, old in zip(moves.column("op").to_pylist(), images("", moves), images("old_", moves), strict=True):
            if op == "c":
                counts.setdefault(same(new), [new, 0])[1] += 1
            elif (gone := counts.pop(same(old), None)) is not None and op == "u":
                counts.setdefault(same(new), [new, 0])[1] += gone[1]
        left = [(*row, n) for row, n in counts.values()]
        kept = list(zip(*left, strict=True)) or [()] * len(names)
        return pa.table([pa.array(v, type=t.type) for v, t in zip(kept, arrow, strict=True)], names=names)

    arrow = to_arrow_schema(kinds)
    out = both.groupBy(*group).applyInArrow(run, kinds)
    # Equal rows come as a count and are told apart here, so a task holds each once.
    return out.where("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*columns)
