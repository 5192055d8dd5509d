"""Dialects, statements and literals."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import dialects as D
from tidemark.functions.literals import decode_hex, tsv_field, typed_literal
from tidemark.functions.lsn import format_lsn, parse_lsn
from tidemark.operators import coalesce, render
from tidemark.schema import IMAGE_DDL, value


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("d", "want"), [
    (D.ANSI, ['"users"', '"back`tick"', '"bra]cket"', '"double""quote"']),
    (D.MYSQL, ["`users`", "`back``tick`", "`bra]cket`", '`double"quote`']),
    (D.SQLSERVER, ["[users]", "[back`tick]", "[bra]]cket]", '[double"quote]']),
    (D.SQLITE, ['"users"', '"back`tick"', '"bra]cket"', '"double""quote"']),
])
def test_identifiers(spark, d, want):
    names = ["users", "back`tick", "bra]cket", 'double"quote']
    assert [one(spark, d.quote(F.lit(n))) for n in names] == want


VALUES = [("null", None), ("text", b"t"), ("text", b"f"), ("text", b"42"), ("text", b"o'reilly"), ("text", b"back\\slash"), ("binary", b"\x00\xff\xab"), ("text", b"\xff\xfe"), ("text", b"true")]


@pytest.mark.parametrize(("d", "want"), [
    (D.ANSI, ["NULL", "1", "0", "'42'", "'o''reilly'", "'back\\slash'", "X'00ffab'", "X'fffe'", "'true'"]),
    (D.MYSQL, ["NULL", "1", "0", "'42'", "'o''reilly'", "'back\\\\slash'", "X'00ffab'", "X'fffe'", "'true'"]),
    (D.SQLSERVER, ["NULL", "1", "0", "'42'", "'o''reilly'", "'back\\slash'", "0x00ffab", "0xfffe", "'true'"]),
    (D.ANSI.typed(), ["NULL", "'t'", "'f'", "'42'", "'o''reilly'", "'back\\slash'", "X'00ffab'", "X'fffe'", "'true'"]),
])
def test_values(spark, d, want):
    rows = spark.createDataFrame(VALUES, "kind string, bytes binary").select(d.value(F.struct("kind", "bytes")).alias("x"))
    assert [r.x for r in rows.collect()] == want


def test_dialect_lookup_and_own_dialect(spark):
    assert D.dialect(None) is D.ANSI and D.dialect("no such") is D.ANSI and D.dialect("MySQL") is D.MYSQL
    D.register_dialect(D.Dialect("house", D.MYSQL.quote, lambda b: F.concat(F.lit("unhex('"), F.hex(b), F.lit("')"))))
    assert one(spark, D.dialect("house").value(F.struct(F.lit("binary").alias("kind"), F.lit(b"\x01").alias("bytes")))) == "unhex('01')"


ROW = "array(struct('id' name, 'text' kind, cast('1' as binary) bytes), struct('n' name, 'null' kind, cast(null as binary) bytes))"


def statement(spark, d, event, identity="default", keys=("id",), before=ROW, after=ROW, tables=("public.users", "a.b.c")):
    e = lambda x: F.expr(x).cast(IMAGE_DDL) if x else F.lit(None).cast(IMAGE_DDL)
    row = spark.range(1).select(
        F.lit(event).alias("event"), F.lit("public").alias("schema"), F.lit("users").alias("table"), F.lit(identity).alias("replica_identity"),
        F.array(*[F.lit(k) for k in keys]).cast("array<string>").alias("key_columns"), e(before).alias("before"), e(after).alias("after"), F.array(*[F.lit(t) for t in tables]).alias("tables"),
    )
    return row.select(render.change_sql(d, {"public": "main"})).first()[0]


def test_statements(spark):
    assert statement(spark, D.MYSQL, "c") == "INSERT INTO `main`.`users` (`id`, `n`) VALUES ('1', NULL);"
    assert statement(spark, D.SQLITE, "u") == """UPDATE "users" SET "id" = '1', "n" = NULL WHERE "id" = '1';"""
    assert statement(spark, D.SQLSERVER, "d", "full") == "DELETE FROM [main].[users] WHERE [id] = '1' AND [n] IS NULL;"
    assert statement(spark, D.ANSI, "t") == 'TRUNCATE TABLE "main"."users";\nTRUNCATE TABLE "main"."a.b.c";'
    assert statement(spark, D.SQLITE, "t") == 'DELETE FROM "users";\nDELETE FROM "a.b.c";'
    assert statement(spark, D.KAFKA, "t") == ""
    assert statement(spark, D.ANSI, "begin") is None
    assert statement(spark, D.ANSI, "u", keys=("n",), before=None) .endswith('WHERE "n" = NULL;')


@pytest.mark.parametrize(("settings", "what"), [
    ({"keys": ()}, render.NO_KEYS), ({"keys": ("zz",)}, render.LACKS_KEY + "zz"),
    ({"identity": "nothing"}, render.NOTHING), ({"identity": "full", "before": None}, render.NO_OLD),
])
def test_rows_that_cannot_be_found(spark, settings, what):
    with pytest.raises(PySparkException, match=what):
        statement(spark, D.ANSI, "u", **settings)


def test_positions(spark):
    assert one(spark, parse_lsn(F.lit("16/B374D848"))) == 0x16B374D848
    assert one(spark, format_lsn(F.lit(0x16B374D848))) == "16/B374D848"
    assert one(spark, parse_lsn(F.lit(None).cast("string"))) is None
    for bad in ("16B374D848", "80000000/0", "x/y", ""):
        with pytest.raises(PySparkException):
            one(spark, parse_lsn(F.lit(bad)))


def test_literals(spark):
    kinds = [("NULL", "null"), (" null ", "null"), ("'it''s'", "string"), ("0xDEAD", "binary"), ("0xABC", "string"), ("TRUE", "bit"), ("-5", "int"), ("9223372036854775808", "float"), ("1e3", "float"), ("abc", "string"), ("''", "string")]
    rows = spark.createDataFrame(kinds, "x string, want string").select("want", typed_literal(F.col("x")).alias("v")).collect()
    assert [r.v.kind for r in rows] == [r.want for r in rows]
    assert rows[2].v.text == "it's" and rows[3].v.b == b"\xde\xad" and rows[10].v.text == ""
    assert one(spark, decode_hex(F.lit("X'00fF'"))) == b"\x00\xff"
    fields = spark.createDataFrame([("text", b"a\tb\\\n"), ("null", None), ("text", b"True")], "kind string, bytes binary").select(tsv_field(F.struct("kind", "bytes")).alias("x"))
    assert [r.x for r in fields.collect()] == ["a\\tb\\\\\\n", "\\N", "1"]


def test_chunked_inserts(spark):
    rows = spark.createDataFrame([(1, i, f"({i})") for i in range(10)], "g int, lsn int, t string")
    made = lambda **s: [r.statement for r in coalesce.chunked_inserts(rows, ["g"], F.lit("INSERT INTO t (a)"), F.col("t"), **s).orderBy("piece").collect()]
    assert made() == ["INSERT INTO t (a) VALUES " + ", ".join(f"({i})" for i in range(10)) + ";"]
    assert [s.count("(") - 1 for s in made(max_rows=4)] == [4, 4, 2]
    assert all(len(s) <= 40 for s in made(max_bytes=40)) and len(made(max_bytes=40)) == 4


def test_join_update_shapes():
    rows = [["1", "'a'"], ["2", "'b'"]]
    body = lambda q: f"SELECT 1 AS {q[0]}id{q[1]}, 'a' AS {q[0]}v{q[1]} UNION ALL SELECT 2, 'b'"
    assert coalesce.join_update_sql(D.MYSQL, "`t`", ["id"], ["v"], rows) == f"UPDATE `t` AS t JOIN ({body('``')}) AS v ON t.`id` = v.`id` SET t.`v` = v.`v`;"
    assert coalesce.join_update_sql(D.SQLITE, "t", ["id"], ["v"], rows) == f'UPDATE t AS t SET "v" = v."v" FROM ({body(chr(34) * 2)}) AS v WHERE t."id" = v."id";'
    assert coalesce.join_update_sql(D.SQLSERVER, "t", ["id"], ["v"], rows).startswith("UPDATE t SET [v] = v.[v] FROM t AS t INNER JOIN (")
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE t (id INTEGER, v TEXT); INSERT INTO t VALUES (1, 'x'), (2, 'y'), (3, 'z');" + coalesce.join_update_sql(D.SQLITE, "t", ["id"], ["v"], rows))
    assert db.execute("SELECT v FROM t ORDER BY id").fetchall() == [("a",), ("b",), ("z",)]


def test_byte_limit():
    assert coalesce.byte_limit(100) == 1024 and coalesce.byte_limit(10_000) == 8000


def test_value_of_null(spark):
    row = one(spark, value("a", F.lit(None).cast("string")))
    assert (row.kind, row.bytes) == ("null", None)


def test_chunked_inserts_fill_the_limit(spark):
    """A statement of exactly max_bytes, semicolon included, is whole; one byte less cuts it."""
    rows = spark.createDataFrame([(1, i, f"({i})") for i in range(3)], "g int, lsn int, t string")
    whole = "INSERT INTO t (a) VALUES (0), (1), (2);"
    made = lambda n: [r.statement for r in coalesce.chunked_inserts(rows, ["g"], F.lit("INSERT INTO t (a)"), F.col("t"), max_bytes=n).orderBy("piece").collect()]
    assert made(len(whole)) == [whole]
    assert made(len(whole) - 1) == ["INSERT INTO t (a) VALUES (0), (1);", "INSERT INTO t (a) VALUES (2);"]
