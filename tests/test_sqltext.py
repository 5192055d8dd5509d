"""Splitting and reading SQL text."""

from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions import sqltext as S


def test_splitting():
    assert S.split_statements("a; b ;;\n c") == ["a", "b", "c"]
    assert S.split_statements("x 'a;b'; y \"c;\"\"d\"; z `e;` ; [f;]]g") == ["x 'a;b'", 'y "c;""d"', "z `e;`", "[f;]]g"]
    assert S.split_statements("a 'it''s; \n ok'; b") == ["a 'it''s; \n ok'", "b"]
    assert S.split_statements("") == [] and S.split_statements(" ; ;") == []
    assert S.split_statements("open 'never; closed") == ["open 'never; closed"]


@given(st.lists(st.text(alphabet="ab ';\"\n", min_size=1, max_size=8), max_size=6))
def test_quoted_parts_come_back(parts):
    statements = ["INSERT '" + p.replace("'", "''") + "'" for p in parts]
    assert S.split_statements(";\n".join(statements) + ";") == statements


def test_keywords():
    assert S.find_keyword("UPDATE t SET a = 'x WHERE y' where b = 1", "WHERE") == 29
    assert S.find_keyword("somewhere", "where") == -1
    assert S.find_keyword("[WHERE] `WHERE`", "where") == -1


def test_parts():
    assert S.insert_parts("INSERT INTO t (a, b) VALUES ('x, y', fn(1, 2));") == ("INSERT INTO t (a, b)", ["'x, y'", "fn(1, 2)"])
    assert S.insert_parts("INSERT INTO t VALUES (1), (2)") is None
    assert S.update_parts("UPDATE `t` SET a = 'x = 1, y', b = NULL WHERE id = 5;") == ("`t`", [("a", "'x = 1, y'"), ("b", "NULL")], "id = 5")
    assert S.delete_parts("DELETE FROM t WHERE a = 1 AND b = 2;") == ("t", "a = 1 AND b = 2")
    assert S.where_pairs("a = 1 AND b = 'x AND y'") == [("a", "1"), ("b", "'x AND y'")]
    for no in ("a = 1 OR b = 2", "(a = 1)", "a > 1", "a IS NULL", "a = NULL"):
        assert S.where_pairs(no) is None
    assert [S.classify(x) for x in (" insert x", "UPDATE", "Delete from", "TRUNCATE", "")] == ["insert", "update", "delete", "other", "other"]


def test_homogeneous():
    rows = ["INSERT INTO t (a) VALUES (1);", "INSERT INTO t (a) VALUES (2);"]
    assert S.is_homogeneous(rows)
    assert not S.is_homogeneous([*rows, "INSERT INTO u (a) VALUES (1)"]) and not S.is_homogeneous([]) and not S.is_homogeneous([*rows, "DELETE FROM t"])


def test_frame(spark):
    files = spark.createDataFrame([("f", "a;b 'x;'"), ("g", None)], "file string, value string")
    assert sorted(tuple(r) for r in S.explode_statements(files).collect()) == [("f", 0, "a"), ("f", 1, "b 'x;'")]


def test_pieces_move_the_rows_once(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.coalesce import byte_capped, byte_limit, runs
    from tidemark.operators.statements import added_cost, opening_cost, parsed, pieces

    kinds = ["DELETE FROM \"o\" WHERE \"id\" = '{}';", "UPDATE \"o\" SET \"p\" = 'x' WHERE \"id\" = '{}';", "UPDATE \"o\" SET \"id\" = 'x' WHERE \"id\" = '{}';", "INSERT INTO o (a) VALUES ('{}')", "COMMIT"]
    rows = spark.createDataFrame([(tx, n, kinds[n // 40 % 5].format(n)) for tx in (None, 1, 2) for n in range(300)], "tx int, pos long, statement string")
    made = pieces(rows, packet=1500, max_rows=25, tx="tx", order="pos", keep=[])
    assert made.columns == ["tx", "pos", "run", "piece"] and made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    alone = F.when((F.col("kind") == "other") | F.col("moves"), F.col("pos"))
    signature = F.struct("kind", "head", F.when(F.col("kind") == "update", F.col("columns")).alias("c"), F.when(F.col("kind") == "update", F.col("keys")).alias("k"), alone.alias("alone"))
    slow = byte_capped(runs(parsed(rows), signature, "tx", "pos"), added_cost(), byte_limit(1500), ["tx", "run"], "pos", 25, opening=opening_cost())
    assert sorted(made.collect(), key=repr) == sorted(slow.select("tx", "pos", "run", "piece").collect(), key=repr)
    assert pieces(rows, tx="tx", order="pos").columns == [*slow.drop("run", "piece").columns, "run", "piece"]


def test_plain_statements_are_read_like_others():
    from tidemark.operators.statements import _plain_parts, statement_parts

    for plain, other in (("DELETE FROM [a b] WHERE [id] = 'x;y' AND `n` = -1;", "DELETE  FROM [a b] WHERE [id] = 'x;y' AND `n` = -1;"), ('UPDATE "s"."o" SET "p" = NULL, "id" = 2 WHERE "id" = 1', 'UPDATE  "s"."o" SET "p" = NULL, "id" = 2 WHERE "id" = 1')):
        assert _plain_parts(other) is None and _plain_parts(plain) == statement_parts(other) and statement_parts(plain)["keys"]
    for odd in ("DELETE FROM \"o\" WHERE \"id\" = 'it''s'", 'DELETE FROM "o" WHERE "id" = NULL', 'DELETE FROM "o" WHERE "id" = 1 OR "id" = 2', 'DELETE FROM "a""b" WHERE "id" = 1'):
        assert _plain_parts(odd) is None


def test_texts_reach_workers_in_pieces(spark):
    long = ["x" * n + "ä€𝄞;y'" for n in range(S.PIECE - 12, S.PIECE + 2)]
    texts = [";".join(f"'{t.replace(chr(39), chr(39) * 2)}'" for t in long), "a;" * (S.STATEMENTS + 5), "", None, " ; ", "z" * S.PIECE, "b" * (S.PIECE - 1) + ";"]
    files = spark.createDataFrame(list(enumerate(texts)), "file int, value string").coalesce(1)
    made = S.explode_statements(files)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Generate")  # what a worker gets is cut already
    assert made.columns == ["file", "pos", "statement"] and sorted(tuple(r) for r in made.collect()) == [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(S.split_statements(t or ""))]
