"""Queries over SQL text and settings: splitting, parsing, statements written as few, names and values of settings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .. import config, errors
from ..functions import settings, sqltext
from ..functions.dialects import ANSI, MYSQL, SQLITE, SQLSERVER, Dialect, dialect, register_dialect
from ..operators import coalesce, mapping, render, resume, statements
from ..schema import image
from ..sinks import jdbc, kafka
from ..sources import wal
from .queries import order_changes
from .registry import query, read

K = "CAST(o_orderkey AS VARCHAR)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string"))


def _text(template: str, **columns: Column) -> Column:
    """A template with {name} for columns."""
    out: list[Column] = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        if part:
            out.append(columns[part] if i % 2 else F.lit(part))
    return F.concat(*out)


# ---------------------------------------------------------------- splitting and parsing
@query(
    "split_statements",
    """WITH t AS (SELECT o_orderkey, ['INSERT ''a;b''''' || o_orderkey || '''', 'UPDATE `x;y`' || chr(10) || ' SET "c;d" = ' || o_custkey, 'DELETE [p;q] WHERE "i""j;" = 1'] AS parts FROM orders)
SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS statement FROM t, unnest(range(1, 4)) AS u(i)""",
)
def split_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text(" INSERT 'a;b''{k}' ;;\n UPDATE `x;y`\n SET \"c;d\" = {c};DELETE [p;q] WHERE \"i\"\"j;\" = 1 ; \n;", k=F.col("k"), c=F.col("o_custkey").cast("string"))
    return sqltext.explode_statements(_orders(spark, sf_dir).select("o_orderkey", text.alias("value")))


@query("count_statements", "SELECT o_orderkey, CAST(2 + o_orderkey % 3 AS BIGINT) AS n FROM orders")
def count_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements are counted without being cut out of their text."""
    rows = _orders(spark, sf_dir)
    more = F.repeat(F.lit(";\n 'x;''y'"), (F.col("o_orderkey") % 3).cast("int"))
    texts = rows.select("o_orderkey", F.concat(F.lit("a 'b;c' ;; [d;e]"), more, F.lit("; ;")).alias("statement"))
    return statements.parsed(texts).select("o_orderkey", F.col("n_statements").alias("n"))


PARTS_SQL = f"""WITH s AS (SELECT o_orderkey, o_orderkey % 4 AS n, {K} AS k, o_orderstatus AS s, o_orderpriority AS p, o_custkey AS c FROM orders)
SELECT o_orderkey, ['insert', 'update', 'delete', 'other'][n + 1] AS kind,
  CASE n WHEN 0 THEN 'INSERT INTO "shop"."orders" ("id", "no,te")' WHEN 3 THEN NULL ELSE '"shop"."orders"' END AS head,
  CASE n WHEN 0 THEN '"id"|"no,te"' WHEN 1 THEN '"note"|"state"' END AS columns,
  CASE n WHEN 0 THEN '''' || k || '''|''it''''s VALUES (' || p || ')''' WHEN 1 THEN '''a = b WHERE, ' || p || '''|f(1, ' || c || ')' END AS "values",
  CASE n WHEN 1 THEN '"id" = ''' || k || ''' AND "c" = ''' || s || ' AND x''' WHEN 2 THEN '"id" = ''' || k || '''' END AS clause,
  CASE n WHEN 1 THEN '"id"|"c"' WHEN 2 THEN '"id"' END AS keys,
  CASE n WHEN 1 THEN '''' || k || '''|''' || s || ' AND x''' WHEN 2 THEN '''' || k || '''' END AS key_values FROM s"""


@query("statement_parts", PARTS_SQL)
def statement_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of statements, and what they are made of; words and signs inside quotes don't count."""
    n, parts = F.col("o_orderkey") % 4, {"k": F.col("k"), "s": F.col("o_orderstatus"), "p": F.col("o_orderpriority"), "c": F.col("o_custkey").cast("string")}
    text = (
        F.when(n == 0, _text("insert into \"shop\".\"orders\" (\"id\", \"no,te\") values ('{k}', 'it''s VALUES ({p})');", **parts))
        .when(n == 1, _text('UPDATE "shop"."orders" SET "note" = \'a = b WHERE, {p}\', "state" = f(1, {c}) WHERE "id" = \'{k}\' AND "c" = \'{s} AND x\' ;', **parts))
        .when(n == 2, _text(" Delete From \"shop\".\"orders\" Where \"id\" = '{k}';", **parts))
        .otherwise(F.lit('TRUNCATE TABLE "shop"."orders";'))
    )
    found = statements.parsed(_orders(spark, sf_dir).select("o_orderkey", text.alias("statement")))
    joined = {c: F.array_join(c, "|") for c in ("columns", "values", "keys", "key_values")}
    head = F.regexp_replace("head", "^insert into", "INSERT INTO")
    return found.withColumns(joined).select("o_orderkey", "kind", head.alias("head"), "columns", "values", "clause", "keys", "key_values")


@query("keyword_search", "SELECT o_orderkey, CAST(28 + length(o_orderpriority) AS INTEGER) AS at FROM orders")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a keyword stands outside of quotes."""
    @F.pandas_udf(IntegerType())
    def at(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sqltext.find_keyword(t, "WHERE"))

    text = _text("UPDATE t SET a = 'x WHERE {p}' where nowhere = 1", p=F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", at(text).alias("at"))


@query(
    "where_equalities",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN o_orderkey % 6 = 0 THEN '''' || {K} || '''' END AS first FROM orders",
)
def where_equalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only equalities joined by AND are taken apart."""
    n, k = F.col("o_orderkey") % 6, F.col("k")
    clause = (
        F.when(n == 0, _text("\"a\" = '{k}' AND \"b\" = 'x OR y'", k=k)).when(n == 1, _text("\"a\" = '{k}' OR \"b\" = 1", k=k)).when(n == 2, _text("(\"a\" = '{k}')", k=k))
        .when(n == 3, F.lit('"a" IS NULL')).when(n == 4, _text("\"a\" > '{k}'", k=k)).otherwise(F.lit('"a" = NULL'))
    )
    texts = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("DELETE FROM t WHERE "), clause).alias("statement"))
    found = statements.parsed(texts)
    return found.select("o_orderkey", F.when(F.col("keys").isNull(), 0).otherwise(F.size("keys")).alias("n"), F.get("key_values", F.lit(0)).alias("first"))


@query("homogeneous_batches", "SELECT o_custkey, count(*) AS n, count(*) > 0 AND (o_custkey % 3 <> 0 OR count(*) = 1) AS alike FROM orders GROUP BY o_custkey")
def homogeneous_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of INSERTs with one beginning and as many values each; of every third customer, the last has one value more."""
    from pyspark.sql.window import Window

    rows = _orders(spark, sf_dir)
    last = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))) == 1
    odd = last & (F.col("o_custkey") % 3 == 0)
    text = F.concat(F.lit("INSERT INTO t (a, b) VALUES ('"), F.col("k"), F.lit("', 'x, y'"), F.when(odd, ", 3").otherwise(""), F.lit(");"))
    found = statements.parsed(rows.select("o_custkey", text.alias("statement")))
    shape = F.struct("head", F.size("values").alias("n"))
    return found.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (F.bool_and(F.col("kind") == "insert") & (F.count_distinct(shape) == 1)).alias("alike"))


# ---------------------------------------------------------------- statements written as few
@query(
    "coalesce_inserts",
    """WITH r AS (SELECT c_nationkey AS tx, c_custkey AS k, c_name AS n, floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 7) AS piece FROM customer)
SELECT tx, CAST(piece AS BIGINT) AS piece, count(*) AS n, 'INSERT INTO "c" ("id", "name") VALUES ' || string_agg('(''' || k || ''', ''' || n || ''')', ', ' ORDER BY k) || ';' AS statement FROM r GROUP BY tx, piece""",
)
def coalesce_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("INSERT INTO \"c\" (\"id\", \"name\") VALUES ('{k}', '{n}');", k=F.col("c_custkey").cast("string"), n=F.col("c_name"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tx"), F.col("c_custkey").alias("pos"), text.alias("statement"))
    return statements.coalesced(rows, ANSI, max_rows=7, tx="tx", order="pos").select("tx", "piece", "n", "statement")


def _update_rows(spark: SparkSession, sf_dir: str, d: Dialect, by_null: bool = False) -> DataFrame:
    """Each customer's orders update three rows again and again; the last update of a row wins."""
    q, key = d.named, (F.col("o_orderkey") % 3).cast("string")
    more, own = (f" AND {q('p')} IS NULL", "") if by_null else ("", f"{q('id')} = '{{i}}', ")
    text = _text(f"UPDATE {q('o')} SET {own}{q('state')} = '{{s}}', {q('at')} = '{{k}}' WHERE {q('id')} = '{{i}}'{more};", i=key, s=F.col("o_orderstatus"), k=F.col("k"))
    return _orders(spark, sf_dir).select(F.col("o_custkey").alias("tx"), F.col("o_orderkey").alias("pos"), text.alias("statement"))


LAST = f"""r AS (SELECT o_custkey AS tx, o_orderkey AS pos, {K} AS k, o_orderkey % 3 AS i, o_orderstatus AS s, count(*) OVER (PARTITION BY o_custkey) AS n,
  row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey DESC) AS back FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY pos) AS place, count(*) OVER (PARTITION BY tx) AS many FROM r WHERE back = 1)"""


def _joined(name: str, d: Dialect, open_: str, close: str, before: str, behind: str, target: str) -> None:
    """An UPDATE by a join in one dialect; before and behind stand around the derived table."""
    q = lambda x: f"{open_}{x}{close}"
    sets = f"{target}{q('state')} = v.{q('state')}, {target}{q('at')} = v.{q('at')}"
    sql = f"""WITH {LAST}
SELECT tx, any_value(n) AS n, CASE WHEN any_value(many) = 1 THEN string_agg('UPDATE {q("o")} SET {q("id")} = ''' || i || ''', {q("state")} = ''' || s || ''', {q("at")} = ''' || k || ''' WHERE {q("id")} = ''' || i || ''';', '')
  ELSE '{before.format(sets=sets)}(SELECT ' || string_agg(CASE WHEN place = 1 THEN '''' || i || ''' AS {q("id")}, ''' || s || ''' AS {q("state")}, ''' || k || ''' AS {q("at")}' ELSE '''' || i || ''', ''' || s || ''', ''' || k || '''' END, ' UNION ALL SELECT ' ORDER BY place)
    || '{behind.format(sets=sets, on=f"t.{q('id')} = v.{q('id')}")};' END AS statement FROM l GROUP BY tx"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return statements.coalesced(_update_rows(spark, sf_dir, d), d, tx="tx", order="pos").select("tx", "n", "statement")


_joined("coalesce_updates", MYSQL, "`", "`", "UPDATE `o` AS t JOIN ", ") AS v ON {on} SET {sets}", "t.")
_joined("coalesce_updates_sqlserver", SQLSERVER, "[", "]", "UPDATE t SET {sets} FROM [o] AS t INNER JOIN ", ") AS v ON {on}", "t.")
_joined("coalesce_updates_sqlite", SQLITE, '"', '"', 'UPDATE "o" AS t SET {sets} FROM ', ") AS v WHERE {on}", "")


@query(
    "coalesce_updates_by_case",
    f"""WITH {LAST}, w AS (SELECT *, '"id" = ''' || i || ''' AND "p" IS NULL' AS c FROM l)
SELECT tx, any_value(n) AS n, CASE WHEN any_value(many) = 1 THEN string_agg('UPDATE "o" SET "state" = ''' || s || ''', "at" = ''' || k || ''' WHERE ' || c || ';', '')
  ELSE 'UPDATE "o" SET "state" = CASE' || string_agg(' WHEN ' || c || ' THEN ''' || s || '''', '' ORDER BY place DESC)
    || ' ELSE "state" END, "at" = CASE' || string_agg(' WHEN ' || c || ' THEN ''' || k || '''', '' ORDER BY place DESC) || ' ELSE "at" END WHERE ' || string_agg('(' || c || ')', ' OR ' ORDER BY place) || ';' END AS statement FROM w GROUP BY tx""",
)
def coalesce_updates_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a clause does more than compare keys, each value is chosen by a CASE."""
    return statements.coalesced(_update_rows(spark, sf_dir, ANSI, by_null=True), ANSI, tx="tx", order="pos").select("tx", "n", "statement")


@query(
    "coalesce_deletes",
    """WITH s AS (SELECT s_nationkey AS tx, s_suppkey AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT tx, any_value(n) AS n, 'DELETE FROM [s] WHERE ' || string_agg(CASE WHEN n = 1 THEN '[id] = ''' || k || '''' ELSE '([id] = ''' || k || ''')' END, ' OR ' ORDER BY k) || ';' AS statement FROM s GROUP BY tx""",
)
def coalesce_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("DELETE FROM [s] WHERE [id] = '{k}';", k=F.col("s_suppkey").cast("string"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tx"), F.col("s_suppkey").alias("pos"), text.alias("statement"))
    return statements.coalesced(rows, SQLSERVER, tx="tx", order="pos").select("tx", "n", "statement")


def _greedy(cost: str, opening: str, limit: int) -> str:
    """SQL that fills pieces row by row; x has tx, pos and what cost needs."""
    return f"""n AS (SELECT tx, pos, {cost} AS cost, {opening} AS opening, row_number() OVER (PARTITION BY tx ORDER BY pos) AS i FROM x),
g AS (SELECT tx, pos, i, opening + cost AS filled, CAST(0 AS BIGINT) AS piece FROM n WHERE i = 1
      UNION ALL SELECT n.tx, n.pos, n.i, CASE WHEN g.filled + n.cost > {limit} THEN n.opening + n.cost ELSE g.filled + n.cost END, CASE WHEN g.filled + n.cost > {limit} THEN g.piece + 1 ELSE g.piece END
      FROM g JOIN n ON n.tx = g.tx AND n.i = g.i + 1)
SELECT tx, pos, piece FROM g"""


UPDATE_COST = "2 * (12 + length(clause) + ((length(a) + length(b)) // 2)) + 6 + length(clause)"


@query(
    "byte_cap_updates",
    f"""WITH RECURSIVE x AS (SELECT o_custkey % 50 AS tx, o_orderkey AS pos, '"id" = ''' || {K} || '''' AS clause, '''' || o_orderpriority || '''' AS a, '''' || o_custkey || '''' AS b FROM orders),
{_greedy(UPDATE_COST, f"length('UPDATE ' || '\"o\"' || ' SET \"p\" = ' || a || ', \"c\" = ' || b || ' WHERE ' || clause || ';') - ({UPDATE_COST})", 1600)}""",
)
def byte_cap_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates put into one statement as long as four fifths of a packet of 2,000 bytes hold them."""
    text = _text("UPDATE \"o\" SET \"p\" = '{p}', \"c\" = '{c}' WHERE \"id\" = '{k}';", p=F.col("o_orderpriority"), c=F.col("o_custkey").cast("string"), k=F.col("k"))
    rows = _orders(spark, sf_dir).select((F.col("o_custkey") % 50).alias("tx"), F.col("o_orderkey").alias("pos"), text.alias("statement"))
    return statements.pieces(rows, packet=2000, tx="tx", order="pos", keep=[]).select("tx", "pos", "piece")


@query(
    "byte_cap_deletes",
    f"""WITH RECURSIVE x AS (SELECT o_custkey % 50 AS tx, o_orderkey AS pos, '"id" = ''' || {K} || '''' AS clause FROM orders),
{_greedy("length(clause) + 6", "length('DELETE FROM \"o\" WHERE ' || clause || ';') - (length(clause) + 6)", 1024)}""",
)
def byte_cap_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for deletions; a small packet still leaves 1,024 bytes."""
    text = _text("DELETE FROM \"o\" WHERE \"id\" = '{k}';", k=F.col("k"))
    rows = _orders(spark, sf_dir).select((F.col("o_custkey") % 50).alias("tx"), F.col("o_orderkey").alias("pos"), text.alias("statement"))
    return statements.pieces(rows, packet=500, tx="tx", order="pos", keep=[]).select("tx", "pos", "piece")


@query(
    "chunked_inserts",
    """WITH RECURSIVE x AS (SELECT c_nationkey AS tx, c_custkey AS pos, '(''' || c_custkey || ''', ''' || c_name || ''')' AS t FROM customer),
n AS (SELECT tx, pos, t, length(t) + 2 AS cost, row_number() OVER (PARTITION BY tx ORDER BY pos) AS i FROM x),
g AS (SELECT tx, pos, i, t, 32 + cost AS filled, 1 AS held, CAST(0 AS BIGINT) AS piece FROM n WHERE i = 1
      UNION ALL SELECT n.tx, n.pos, n.i, n.t, CASE WHEN g.filled + n.cost > 300 OR g.held >= 9 THEN 32 + n.cost ELSE g.filled + n.cost END, CASE WHEN g.filled + n.cost > 300 OR g.held >= 9 THEN 1 ELSE g.held + 1 END,
        CASE WHEN g.filled + n.cost > 300 OR g.held >= 9 THEN g.piece + 1 ELSE g.piece END FROM g JOIN n ON n.tx = g.tx AND n.i = g.i + 1)
SELECT tx, piece, 'INSERT INTO "c" ("i", "n") VALUES ' || string_agg(t, ', ' ORDER BY pos) || ';' AS statement FROM g GROUP BY tx, piece""",
)
def chunked_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERTs of at most 300 bytes and nine rows."""
    rows = read(spark, sf_dir, "customer").withColumn("tx", F.col("c_nationkey"))
    values = F.concat(F.lit("("), ANSI.text(F.col("c_custkey").cast("string")), F.lit(", "), ANSI.text(F.col("c_name")), F.lit(")"))
    return coalesce.chunked_inserts(rows, ["tx"], F.lit('INSERT INTO "c" ("i", "n")'), values, "c_custkey", 300, 9)


@query("bulk_load_lines", "SELECT c_custkey, c_custkey || chr(9) || CASE WHEN c_custkey % 5 = 0 THEN '\\N' ELSE replace(c_name, chr(9), '\\t') END AS value FROM customer")
def bulk_load_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the file that a bulk load reads."""
    row = image(id=F.col("c_custkey"), name=F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_name")))
    rows = read(spark, sf_dir, "customer").select("c_custkey", row.alias("after"))
    from ..functions.literals import tsv_line

    return rows.select("c_custkey", tsv_line(F.col("after")).alias("value"))


@query("bulk_load_statement", """SELECT 'LOAD DATA LOCAL INFILE ''a.tsv'' INTO TABLE `s`.`t` FIELDS TERMINATED BY ''\\t'' LINES TERMINATED BY ''\\n'' (`i``d`, `n`)' AS statement""")
def bulk_load_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jdbc.load_statement(f"{MYSQL.named('s')}.{MYSQL.named('t')}", [MYSQL.named("i`d"), MYSQL.named("n")], "a.tsv")
    return spark.createDataFrame([(made,)], "statement string")


@query(
    "structured_render",
    f"""SELECT o_orderkey AS lsn, CASE WHEN o_orderkey % 10 < 4 THEN 'bulk_insert' ELSE 'sql' END AS kind, CASE WHEN o_orderkey % 10 < 4 THEN '`main`.`orders`' END AS "table",
  CASE WHEN o_orderkey % 10 < 4 THEN '`id`,`status`,`priority`' END AS columns, CASE WHEN o_orderkey % 10 < 4 THEN '''' || {K} || '''|''' || o_orderstatus || '''|''' || o_orderpriority || '''' END AS "values",
  CASE WHEN o_orderkey % 10 >= 4 THEN CASE WHEN o_orderkey % 10 < 7 THEN 'UPDATE' WHEN o_orderkey % 10 < 9 THEN 'DELETE' ELSE 'TRUNCATE' END END AS verb FROM orders""",
)
def structured_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creates as table, columns and values for sinks that load in bulk; the rest as SQL."""
    out = order_changes(spark, sf_dir).select("lsn", render.structured(MYSQL, {"public": "main"}, bulk=True).alias("c"))
    return out.select("lsn", "c.kind", "c.table", F.array_join("c.columns", ",").alias("columns"), F.array_join("c.values", "|").alias("values"), F.split("c.sql", " ")[0].alias("verb"))


@query(
    "bulk_runs",
    f"""WITH r AS (SELECT o_custkey % 100 AS tx, o_orderkey AS lsn, o_orderkey % 10 < 4 AS bulk, {K} AS k FROM orders),
f AS (SELECT *, CASE WHEN bulk AND coalesce(lag(bulk) OVER w, false) THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY tx ORDER BY lsn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY tx ORDER BY lsn) - 1 AS run FROM f)
SELECT tx, CAST(run AS BIGINT) AS run, min(lsn) AS first, CASE WHEN bool_or(bulk) THEN 'bulk_insert' ELSE 'sql' END AS kind, count(*) AS n,
  CASE WHEN bool_or(bulk) THEN string_agg('''' || k || '''', ',' ORDER BY lsn) ELSE '' END AS ids FROM g GROUP BY tx, run""",
)
def bulk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring bulk inserts of a transaction as one."""
    rows = order_changes(spark, sf_dir).select("lsn", render.structured(MYSQL, bulk=True).alias("change"))
    rows = rows.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lsn"), (F.col("o_custkey") % 100).alias("tx")), "lsn")
    found = coalesce.bulk_runs(rows, "tx")
    ids = F.array_join(F.transform("rows", lambda v: F.coalesce(F.get(v, F.lit(0)), F.lit(""))), ",")
    return found.select("tx", F.col("run").cast("long").alias("run"), "first", "kind", "n", F.when(F.col("kind") == "bulk_insert", ids).otherwise("").alias("ids"))


@query(
    "join_update_composite",
    """WITH u AS (SELECT l_orderkey, l_linestatus, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL)
SELECT o_orderkey, o_orderstatus, CASE WHEN u.l_orderkey IS NOT NULL THEN u.p ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN u ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus""",
)
def join_update_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values joined on two key columns."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), F.col("l_extendedprice").alias("o_totalprice"))
    new = coalesce.last_writes(lines, ["o_orderkey", "o_orderstatus"], ["o_totalprice"], "o_totalprice")
    target = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return coalesce.join_update(target, new, ["o_orderkey", "o_orderstatus"], ["o_totalprice"])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "identity_problems",
    f"""WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS n FROM orders)
SELECT o_orderkey, CASE n WHEN 0 THEN NULL WHEN 1 THEN {_quoted(render.NO_KEYS)} WHEN 2 THEN {_quoted(render.LACKS_KEY + "zz")} WHEN 3 THEN {_quoted(render.NO_OLD)} WHEN 4 THEN {_quoted(render.NOTHING)} END AS problem FROM r""",
)
def identity_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row can't be found again, by identity."""
    n, row = F.col("o_orderkey") % 6, image(id=F.col("o_orderkey"))
    none = F.lit(None).cast(row_type())
    identity = F.when(n <= 2, "default").when(n == 4, "nothing").otherwise("full")
    keys = F.when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array(F.lit("id"), F.lit("zz"))).otherwise(F.array(F.lit("id")))
    before = F.when(n == 3, none).otherwise(row)
    return read(spark, sf_dir, "orders").select("o_orderkey", render.key_problem(identity, keys, before, row).alias("problem"))


def row_type() -> str:
    from ..schema import IMAGE_DDL

    return IMAGE_DDL


@query(
    "custom_dialect",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unhex(''' || lower(hex(encode(source))) || ''')' ELSE '''' || replace(source, '''', '''''') || '''' END AS literal, '"db"."' || lang || '"' AS "table" FROM documents""",
)
def custom_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dialect that a user brings: another form of bytes, found by its name."""
    register_dialect(Dialect("columnar", ANSI.quote, lambda b: F.concat(F.lit("unhex('"), F.lower(F.hex(b)), F.lit("')")), compat_booleans=False))
    d = dialect("columnar")
    v = F.struct(F.when(F.col("doc_id") % 3 == 0, "binary").otherwise("text").alias("kind"), F.col("source").cast("binary").alias("bytes"))
    return read(spark, sf_dir, "documents").select("doc_id", d.value(v).alias("literal"), d.qualify(F.lit("db"), F.col("lang")).alias("table"))


# ---------------------------------------------------------------- settings
@query("slot_names", "SELECT p_partkey, regexp_full_match(p_name, '[a-z0-9_]+') AS spaced, regexp_full_match(lower(replace(p_name, ' ', '_')), '[a-z0-9_]+') AS fits FROM part")
def slot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return read(spark, sf_dir, "part").select("p_partkey", settings.slot_name_fits(F.col("p_name")).alias("spaced"), settings.slot_name_fits(name).alias("fits"))


@query(
    "masked_connections",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'postgresql://u' || c_custkey || ':********@h:5432/d?x=1' WHEN 1 THEN 'Server=h;Pwd=********;Database=' || c_name ELSE 'Password=********;User=u;Note="a;Pwd=b"' END AS masked FROM customer""",
)
def masked_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k, name = F.col("c_custkey") % 3, F.col("c_custkey").cast("string"), F.col("c_name")
    text = (
        F.when(n == 0, _text("postgresql://u{k}:s3{n}@h:5432/d?x=1", k=k, n=F.md5(name))).when(n == 1, _text("Server=h;Pwd={p};Database={n}", p=F.md5(k), n=name))
        .otherwise(_text("Password='{n};x';User=u;Note=\"a;Pwd=b\"", n=name))
    )
    return read(spark, sf_dir, "customer").select("c_custkey", settings.masked(text).alias("masked"))


@query("schema_maps", "SELECT c_custkey, 's' || c_nationkey AS first, 't' || c_custkey AS second, 2 AS n FROM customer")
def schema_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text(" a : s{n} ,b:t{k},, ", n=F.col("c_nationkey").cast("string"), k=F.col("c_custkey").cast("string"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", settings.schema_mappings(text).alias("m"))
    return rows.select("c_custkey", F.col("m")["a"].alias("first"), F.col("m")["b"].alias("second"), F.size("m").alias("n"))


@query("key_column_maps", "SELECT c_custkey, 'id,n' || c_nationkey AS first, 'k' || c_custkey AS second, 2 AS n FROM customer")
def key_column_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("s.t: id , n{n} ; u.v:k{k};none:; ", n=F.col("c_nationkey").cast("string"), k=F.col("c_custkey").cast("string"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", settings.key_columns(text).alias("m"))
    return rows.select("c_custkey", F.array_join(F.col("m")["s.t"], ",").alias("first"), F.array_join(F.col("m")["u.v"], ",").alias("second"), F.size("m").alias("n"))


@query(
    "setting_values",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey END AS number FROM customer""",
)
def setting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    flag = F.when(n % 5 == 0, " Yes").when(n % 5 == 1, "OFF").when(n % 5 == 2, "1 ").when(n % 5 == 3, "false").otherwise("maybe")
    number = F.when(n % 4 == 0, k).when(n % 4 == 1, F.concat(F.lit("+"), k)).when(n % 4 == 2, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(F.concat(F.lit("-"), k))
    return read(spark, sf_dir, "customer").select("c_custkey", settings.boolean(flag).alias("flag"), settings.whole_number(number).alias("number"))


CASES = (
    ({}, None), ({"source": ""}, "source"), ({"destination": ""}, "destination"), ({"slot": "Bad Slot"}, "slot"), ({"publication": ""}, "publication"), ({"protocol_version": 5}, "protocols 1"),
    ({"protocol_version": 1}, "streamed"), ({"two_phase": True}, "two phases"), ({"two_phase": True, "protocol_version": 3}, None), ({"buffer_size": 0}, "buffer"),
)


@query("config_problems", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {w is not None})" for i, (_, w) in enumerate(CASES)) + ") AS t(case_id, refused)")
def config_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that are refused before anything runs."""

    def refused(given: dict, word: str | None) -> bool:
        try:
            config.Config(**({"source": "s", "destination": "d"} | given)).validate()
        except errors.ConfigError as error:
            return word is not None and word in str(error)
        return False

    return spark.createDataFrame([(i, refused(*case)) for i, case in enumerate(CASES)], "case_id int, refused boolean")


ENVIRONMENT = {
    "CDC_SOURCE_CONNECTION_STRING": "postgresql://s", "CDC_DEST_URI": "d", "CDC_DEST_TYPE": "Oracle", "CDC_STREAMING": "on", "CDC_BUFFER_SIZE": "10", "CDC_CHANNEL_CAPACITY": "20",
    "CDC_BULK_INSERT_THRESHOLD": "7", "CDC_TRANSACTION_SEGMENT_SIZE_MB": "2", "CDC_SCHEMA_MAPPING": "a:b",
}


@query(
    "config_from_environment",
    """SELECT * FROM (VALUES ('destination_type', 'mysql'), ('protocol_version', '2'), ('streaming', 'True'), ('buffer_size', '20'), ('bulk_threshold', '7'), ('segment_bytes', '2097152'), ('schema_mappings', '{''a'': ''b''}')) AS t(name, value)""",
)
def config_from_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = config.load_config(ENVIRONMENT)
    names = ("destination_type", "protocol_version", "streaming", "buffer_size", "bulk_threshold", "segment_bytes", "schema_mappings")
    return spark.createDataFrame([(n, str(getattr(made, n))) for n in names], "name string, value string")


@query(
    "stream_options",
    """SELECT * FROM (VALUES ('source', 'postgresql://s'), ('slot', 'cdc_slot'), ('publication', 'cdc_pub'), ('protocol_version', '2'), ('streaming', 'true'), ('connection_timeout', '30'), ('max_positions', '0')) AS t(name, value)""",
)
def stream_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration as options of the log's reader."""
    return spark.createDataFrame(sorted(wal.stream_options(config.load_config(ENVIRONMENT)).items()), "name string, value string")


@query(
    "kafka_settings",
    """SELECT * FROM (VALUES ('kafka.bootstrap.servers', 'h:1'), ('kafka.security.protocol', 'SASL_SSL'), ('kafka.compression.type', 'lz4'), ('kafka.batch.size', '16384'), ('kafka.linger.ms', '5'), ('kafka.acks', '1'),
  ('kafka.max.request.size', '1048576'), ('kafka.retries', '3'), ('kafka.delivery.timeout.ms', '30000'), ('kafka.retry.backoff.ms', '200'), ('kafka.metadata.max.age.ms', '5000'), ('kafka.request.timeout.ms', '29995'),
  ('kafka.sasl.mechanism', 'PLAIN'), ('kafka.sasl.jaas.config', 'org.apache.kafka.common.security.plain.PlainLoginModule required username="u" password="p\\"q";')) AS t(name, value)""",
)
def kafka_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The producer's settings, from the environment where it has them."""
    env = {"CDC_KAFKA_SECURITY_PROTOCOL": "sasl_ssl", "CDC_KAFKA_ACKS": "1", "CDC_KAFKA_SASL_MECHANISM": "PLAIN", "CDC_KAFKA_SASL_USERNAME": "u", "CDC_KAFKA_SASL_PASSWORD": 'p"q'}
    return spark.createDataFrame(sorted(kafka.settings("h:1", env).items()), "name string, value string")


@query("error_kinds", "SELECT * FROM (VALUES ('lost', true), ('timeout', true), ('config', false), ('data', false), ('unsupported', false), ('cancelled', false)) AS t(kind, transient)")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which errors may pass."""
    made = {"lost": errors.ConnectionLost(), "timeout": TimeoutError(), "config": errors.ConfigError(), "data": errors.DataError(), "unsupported": errors.UnsupportedError(), "cancelled": errors.Cancelled()}
    return spark.createDataFrame([(k, errors.is_transient(e)) for k, e in made.items()], "kind string, transient boolean")


# ---------------------------------------------------------------- rows
@query("only_changes", "SELECT event_id FROM events WHERE event_id % 7 < 4")
def only_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control rows and metadata are left out."""
    from ..schema import only_changes as changes_only

    kinds = F.array(*[F.lit(k) for k in ("c", "u", "d", "t", "begin", "relation", "stream_stop")])
    return read(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("event")).where(changes_only()).select("event_id")


@query("event_total", "SELECT count(*) AS n FROM events")
def event_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import event_total as total

    return total(read(spark, sf_dir, "events"))


@query(
    "replayed_then_live",
    """SELECT tx_id, lsn, turn FROM (SELECT floor(event_id / 10)::BIGINT AS tx_id, event_id AS lsn, CASE WHEN floor(event_id / 10) % 4 = 0 THEN 0 ELSE 1 END AS turn FROM events)""",
)
def replayed_then_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth transaction was left on disk, and the log sends half of those again."""
    log = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).cast("long").alias("tx_id"), F.col("event_id").alias("lsn"))
    pending, live = log.where("tx_id % 4 = 0"), log.where("tx_id % 4 <> 0 or tx_id % 8 = 0")
    return resume.replayed_then_live(pending, live).select("tx_id", "lsn", "turn")


@query("origins", "SELECT event_id, coalesce(event_type IN ('click', 'view'), false) AS listed, event_id % 3 = 0 AS without FROM events")
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins by a list, and rows without one."""
    origin = F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", mapping.from_origin(F.col("event_type"), ["click", "view"]).alias("listed"), mapping.from_origin(origin, "none").alias("without"))
