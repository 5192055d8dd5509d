"""Named queries over the driver's tables, each with the SQL that DuckDB runs for comparison.

The tables hold no change log, so one is read out of `events`: ten events make a transaction, sign-up creates a user's row,
error deletes it, all else updates it. Names, texts and prices of the other tables serve the scalar operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..functions.dialects import ANSI, MYSQL, SQLITE, SQLSERVER, Dialect
from ..functions.literals import tsv_line, typed_literal
from ..functions.lsn import format_lsn, parse_lsn
from ..operators import apply, assemble, coalesce, envelope, mapping, metrics, render, resume
from ..schema import image
from .registry import ORACLE_SQL, QUERIES, query, read  # noqa: F401

CL = """cl AS (SELECT event_id AS lsn, CAST(floor(event_id / 10) AS BIGINT) AS tx_id, user_id AS k, value, ts, event_type,
  CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op FROM events)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    tx = F.floor(F.col("event_id") / 10).cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("lsn"), tx.alias("tx_id"), F.col("user_id").alias("k"), "value", "ts", "event_type", op.alias("op")
    )


# ---------------------------------------------------------------- replay
LIFE = """b AS (SELECT k, max(CASE WHEN op = 'd' THEN lsn END) AS d FROM cl GROUP BY k),
c AS (SELECT cl.k, max(cl.lsn) AS c FROM cl JOIN b ON cl.k = b.k WHERE cl.op = 'c' AND (b.d IS NULL OR cl.lsn > b.d) GROUP BY cl.k)"""


@query(
    "replay_final_state",
    f"""WITH {CL}, {LIFE}
SELECT cl.k, arg_max(cl.value, cl.lsn) AS value, max(cl.lsn) AS last_lsn
FROM cl JOIN c ON cl.k = c.k WHERE cl.lsn >= c.c AND cl.op IN ('c', 'u') GROUP BY cl.k""",
)
def replay_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changes(spark, sf_dir).select("k", "lsn", "op", F.struct("value").alias("after"))
    return apply.replay(log, ["k"], ["lsn"], ["value"])


@query(
    "replay_truncate_barrier",
    f"""WITH all_changes AS (SELECT * FROM (WITH {CL} SELECT * FROM cl)),
t AS (SELECT max(lsn) AS at FROM all_changes WHERE lsn % 3001 = 0 AND lsn > 0),
cl AS (SELECT a.* FROM all_changes a, t WHERE t.at IS NULL OR a.lsn > t.at), {LIFE}
SELECT cl.k, arg_max(cl.value, cl.lsn) AS value, max(cl.lsn) AS last_lsn
FROM cl JOIN c ON cl.k = c.k WHERE cl.lsn >= c.c AND cl.op IN ('c', 'u') GROUP BY cl.k""",
)
def replay_truncate_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 3001st position truncates the table; the last one of the log, a scalar, bounds the scan."""
    log = changes(spark, sf_dir)
    cuts = log.where("lsn % 3001 = 0 and lsn > 0").select("lsn", F.lit("t").alias("event"), F.array(F.lit("public.users")).alias("tables"))
    last = apply.truncations(cuts).where("table = 'users'").agg(F.max("lsn")).first()[0]
    log = log.select("k", "lsn", "op", F.struct("value").alias("after"))
    return apply.replay(log, ["k"], ["lsn"], ["value"], barrier=None if last is None else F.struct(F.lit(last).alias("lsn")))


@query(
    "replay_onto_base",
    f"""WITH {CL}, {LIFE},
w AS (SELECT b.k, b.d, c.c, u.v, u.at FROM b LEFT JOIN c ON b.k = c.k
      LEFT JOIN (SELECT k, arg_max(value, lsn) AS v, max(lsn) AS at FROM cl WHERE op IN ('c', 'u') GROUP BY k) u ON b.k = u.k)
SELECT coalesce(w.k, c_custkey) AS k,
       CASE WHEN w.at IS NOT NULL AND (w.c IS NULL OR w.at >= w.c) THEN w.v WHEN w.c IS NULL THEN c_acctbal END AS value
FROM w FULL OUTER JOIN customer ON w.k = c_custkey
WHERE w.c IS NOT NULL OR (w.d IS NULL AND c_custkey IS NOT NULL)""",
)
def replay_onto_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    return apply.replay_onto(base, changes(spark, sf_dir).select("k", "lsn", "op", "value"), ["k"], ["lsn"], ["value"])


@query(
    "replay_partial_columns",
    f"""WITH {CL}, {LIFE},
v AS (SELECT cl.k, arg_max(value, lsn) AS value, max(lsn) AS at FROM cl LEFT JOIN c ON cl.k = c.k WHERE op IN ('c', 'u') AND lsn % 3 <> 0 AND (c.c IS NULL OR lsn >= c.c) GROUP BY cl.k),
e AS (SELECT cl.k, arg_max(event_type, lsn) AS event_type, max(lsn) AS at FROM cl LEFT JOIN c ON cl.k = c.k WHERE op IN ('c', 'u') AND lsn % 2 = 0 AND (c.c IS NULL OR lsn >= c.c) GROUP BY cl.k)
SELECT coalesce(b.k, c_custkey) AS k,
       CASE WHEN v.at IS NOT NULL THEN v.value WHEN c.c IS NULL THEN c_acctbal END AS value,
       CASE WHEN e.at IS NOT NULL THEN e.event_type WHEN c.c IS NULL THEN c_mktsegment END AS event_type
FROM b LEFT JOIN c ON b.k = c.k LEFT JOIN v ON b.k = v.k LEFT JOIN e ON b.k = e.k FULL OUTER JOIN customer ON b.k = c_custkey
WHERE c.c IS NOT NULL OR (b.d IS NULL AND c_custkey IS NOT NULL)""",
)
def replay_partial_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the images lack the value, half lack the type; what is lacking stays as it was."""
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("event_type"))
    log = changes(spark, sf_dir).select("k", "lsn", "op", "value", "event_type")
    there = {"value": F.col("lsn") % 3 != 0, "event_type": F.col("lsn") % 2 == 0}
    return apply.replay_onto(base, log, ["k"], ["lsn"], ["value", "event_type"], present=there)


@query(
    "replay_key_change",
    f"""WITH e AS (SELECT *, CASE WHEN op = 'u' AND lsn % 50 = 0 THEN 1 ELSE 0 END AS moved FROM (WITH {CL} SELECT * FROM cl)),
cl AS (SELECT lsn * 2 AS lsn, k, CASE WHEN moved = 1 THEN 'd' ELSE op END AS op, value FROM e UNION ALL SELECT lsn * 2 + 1, k + 100000, 'c', value FROM e WHERE moved = 1), {LIFE}
SELECT cl.k, arg_max(cl.value, cl.lsn) AS value FROM cl JOIN c ON cl.k = c.k WHERE cl.lsn >= c.c AND cl.op IN ('c', 'u') GROUP BY cl.k""",
)
def replay_key_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth position's update gives its row another key."""
    moved = (F.col("op") == "u") & (F.col("lsn") % 50 == 0)
    log = changes(spark, sf_dir).withColumn("old_k", F.when(F.col("op") == "u", F.col("k"))).withColumn("k", F.when(moved, F.col("k") + 100000).otherwise(F.col("k")))
    log = apply.split_key_changes(log, ["k"]).select("k", "lsn", "part", "op", F.struct("value").alias("after"))
    return apply.replay(log, ["k"], ["lsn", "part"], ["value"]).select("k", "value")


@query(
    "join_update",
    f"""WITH {CL}, n AS (SELECT k, arg_max(value, lsn) AS v FROM cl WHERE op = 'u' GROUP BY k)
SELECT c_custkey, CASE WHEN n.k IS NOT NULL THEN v ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN n ON c_custkey = n.k""",
)
def join_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = coalesce.last_writes(changes(spark, sf_dir).where("op = 'u'"), ["k"], ["value"])
    new = new.select(F.col("k").alias("c_custkey"), F.col("value").alias("c_acctbal"))
    return coalesce.join_update(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), new, ["c_custkey"], ["c_acctbal"])


@query("delete_rows", f"WITH {CL} SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT k FROM cl WHERE op = 'd')")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = changes(spark, sf_dir).where("op = 'd'").select(F.col("k").alias("c_custkey"))
    return coalesce.delete_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


# ---------------------------------------------------------------- transactions
@query(
    "tx_assembly",
    f"WITH {CL} SELECT tx_id, count(*) AS n_events, min(lsn) AS first_lsn, max(lsn) AS commit_lsn, string_agg(op, ',' ORDER BY lsn) AS ops FROM cl GROUP BY tx_id",
)
def tx_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.transactions(changes(spark, sf_dir))


@query(
    "tx_abort_filter",
    f"""WITH {CL}, s AS (SELECT *, lsn % 3 AS sub_xid FROM cl)
SELECT lsn, tx_id, op FROM s WHERE tx_id % 7 <> 0 AND NOT (tx_id % 5 = 0 AND sub_xid = 2)""",
)
def tx_abort_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh transaction aborts; of every fifth, one sub-transaction does."""
    log = changes(spark, sf_dir).withColumn("sub_xid", F.col("lsn") % 3)
    ids = log.select("tx_id").distinct()
    none = F.lit(None).cast("long")
    aborts = ids.where("tx_id % 7 = 0").withColumn("sub_xid", none).unionByName(ids.where("tx_id % 5 = 0").withColumn("sub_xid", F.lit(2).cast("long")))
    return assemble.without_aborted(log, aborts).select("lsn", "tx_id", "op")


CONTROLS = """l AS (SELECT event_id AS lsn, user_id AS tx_id,
  CASE WHEN event_id % 40 = 0 THEN 'begin' WHEN event_id % 40 = 15 THEN 'commit' WHEN event_type = 'signup' THEN 'stream_start' WHEN event_type = 'error' THEN 'stream_stop' ELSE 'u' END AS event
  FROM events)"""
OWNED = f"""{CONTROLS}, n AS (SELECT *,
  last_value(CASE event WHEN 'begin' THEN tx_id WHEN 'commit' THEN -1 END IGNORE NULLS) OVER w AS normal,
  last_value(CASE event WHEN 'stream_start' THEN tx_id WHEN 'stream_stop' THEN -1 END IGNORE NULLS) OVER w AS chunk
  FROM l WINDOW w AS (ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT lsn, event, coalesce(nullif(normal, -1), nullif(chunk, -1)) AS owner FROM n)"""


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal transactions over part of the log, streamed chunks over the rest."""
    n, kind = F.col("event_id") % 40, F.col("event_type")
    event = F.when(n == 0, "begin").when(n == 15, "commit").when(kind == "signup", "stream_start").when(kind == "error", "stream_stop").otherwise("u")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.col("user_id").alias("tx_id"), event.alias("event"))


@query("stream_owner", f"WITH {OWNED} SELECT lsn, event, owner FROM o")
def stream_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.owners(controls(spark, sf_dir)).select("lsn", "event", "owner")


@query("orphan_events", f"WITH {OWNED} SELECT lsn FROM o WHERE event = 'u' AND owner IS NULL")
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.orphans(assemble.owners(controls(spark, sf_dir))).select("lsn")


TX = f"{CL}, tx AS (SELECT tx_id, count(*) AS n_events, CASE WHEN tx_id % 11 = 0 THEN NULL ELSE max(lsn) + (tx_id % 3) * 25 END AS commit_lsn FROM cl GROUP BY tx_id)"


def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that commit out of the order they began in; every eleventh has no position."""
    at = F.when(F.col("tx_id") % 11 == 0, None).otherwise(F.max("lsn") + (F.col("tx_id") % 3) * 25)
    return changes(spark, sf_dir).groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_events"), at.alias("commit_lsn"))


@query("commit_order", f"WITH {TX} SELECT tx_id, commit_lsn, CAST(row_number() OVER (ORDER BY commit_lsn NULLS LAST, tx_id) AS BIGINT) AS place FROM tx")
def commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.in_commit_order(committed(spark, sf_dir)).select("tx_id", "commit_lsn", "place")


@query("dedup_boundary", f"WITH {TX} SELECT tx_id, n_events, commit_lsn FROM tx WHERE commit_lsn > 500 OR commit_lsn IS NULL")
def dedup_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.not_applied(committed(spark, sf_dir), 500).select("tx_id", "n_events", "commit_lsn")


@query(
    "resume_decision",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS disk,
  CASE o_orderkey % 3 WHEN 0 THEN 'found' WHEN 1 THEN 'absent' ELSE 'failed' END AS state, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 1000 END AS confirmed FROM orders)
SELECT o_orderkey, CASE WHEN state = 'found' THEN confirmed END AS start_lsn,
  CAST(CASE WHEN state = 'found' THEN greatest(coalesce(disk, 0), coalesce(confirmed, 0)) ELSE coalesce(disk, 0) END AS BIGINT) AS dedup_boundary,
  CASE WHEN state = 'found' THEN 'slot' WHEN disk IS NULL THEN 'fresh' WHEN state = 'absent' THEN 'slot_deleted_fallback' ELSE 'query_failed_fallback' END AS source FROM s""",
)
def resume_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = F.when(key % 3 == 0, "found").when(key % 3 == 1, "absent").otherwise("failed")
    disk, confirmed = F.when(key % 5 == 0, None).otherwise(F.col("o_custkey")), F.when(key % 6 == 0, None).otherwise(key % 1000)
    return read(spark, sf_dir, "orders").select("o_orderkey", resume.resume_decision(disk, state, confirmed).alias("r")).select("o_orderkey", "r.*")


@query(
    "batch_index",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, event_id, CAST(floor((n - 1) / 25) AS BIGINT) AS batch_index, CAST(least((floor((n - 1) / 25) + 1) * 25, c) AS BIGINT) AS progress FROM r""",
)
def batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.batches(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 25)


@query(
    "as_of_sync_point",
    """SELECT e.event_id, p.event_id AS sync_id, p.value AS sync_value
FROM events e ASOF LEFT JOIN (SELECT event_id, value FROM events WHERE event_id % 1000 = 17) p ON e.event_id >= p.event_id""",
)
def as_of_sync_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    points = events.where("event_id % 1000 = 17").select(F.col("event_id").alias("sync_id"), F.col("value").alias("sync_value"))
    return resume.as_of(events.select("event_id"), points, "event_id", "sync_id", ["sync_id", "sync_value"])


@query("resume_skip", f"WITH {CL}, n AS (SELECT tx_id, lsn, row_number() OVER (PARTITION BY tx_id ORDER BY lsn) - 1 AS pos FROM cl) SELECT tx_id, lsn FROM n WHERE pos >= 4")
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction goes on behind its fourth statement."""
    rows = resume.batches(changes(spark, sf_dir).select("tx_id", "lsn"), "tx_id", "lsn", 1)
    return resume.skip_applied(rows, 4, "batch_index").select("tx_id", "lsn")


@query(
    "slot_fields",
    """SELECT o_orderkey, o_orderkey * 65536 AS restart_lsn, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS confirmed_flush_lsn, o_orderkey % 4 IN (0, 1, 2) AS active FROM orders""",
)
def slot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.wal import slot_fields as fields

    n = F.col("o_orderkey") % 4
    active = F.when(n == 0, "t").when(n == 1, "true").when(n == 2, "1").otherwise("f")
    restart, confirmed = format_lsn(F.col("o_orderkey") * 65536), F.when(n == 0, None).otherwise(format_lsn(F.col("o_custkey")))
    return read(spark, sf_dir, "orders").select("o_orderkey", fields(restart, confirmed, active).alias("s")).select("o_orderkey", "s.*")


@query("retry_backoff", "SELECT o_orderkey, least(pow(2, o_orderkey % 8), 30.0) AS seconds FROM orders")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", errors.backoff(F.col("o_orderkey") % 8).alias("seconds"))


# ---------------------------------------------------------------- names and columns
@query(
    "schema_mapping",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'sales' WHEN o_orderkey % 4 = 2 THEN 'public' ELSE o_orderstatus END AS s FROM orders)
SELECT o_orderkey, CASE coalesce(s, 'public') WHEN 'sales' THEN 'crm' WHEN 'public' THEN 'main' ELSE s END AS mapped FROM s""",
)
def schema_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 4
    schema = F.when(n == 0, None).when(n == 1, "sales").when(n == 2, "public").otherwise(F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").select("o_orderkey", mapping.map_schema(schema, {"sales": "crm", "public": "main"}).alias("mapped"))


@query(
    "table_spec_split",
    """WITH s AS (SELECT p_partkey, replace(p_name, ' ', '.') AS spec FROM part)
SELECT p_partkey, CASE WHEN len(string_split(spec, '.')) = 2 THEN string_split(spec, '.')[1] ELSE 'public' END AS "schema",
       CASE WHEN len(string_split(spec, '.')) = 2 THEN string_split(spec, '.')[2] ELSE spec END AS "table" FROM s""",
)
def table_spec_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", mapping.table_spec(F.replace(F.col("p_name"), F.lit(" "), F.lit("."))).alias("s"))
    return parts.select("p_partkey", "s.schema", "s.table")


@query("column_transforms", "SELECT c_custkey AS id, upper(c_name) AS name, lower(c_mktsegment) AS segment, 'new' AS state, CAST(NULL AS VARCHAR) AS secret, c_acctbal * 2 AS balance FROM customer")
def column_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mapping.Transformation
    m = mapping.TableMapping(
        columns={"c_custkey": "id"},
        excluded=["c_nationkey"],
        transformations=[
            t("c_name", "name", "uppercase"), t("c_mktsegment", "segment", "lowercase"), t("state", "state", "static", "new"),
            t("secret", "secret", "null"), t("c_acctbal", "balance", "function", lambda x: x * 2),
        ],
    )
    rows = read(spark, sf_dir, "customer").withColumn("state", F.lit("old")).withColumn("secret", F.col("c_name"))
    return m.apply(rows)


@query("origin_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def origin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(mapping.from_origin(F.col("event_type"), "click")).select("event_id", "event_type")


# ---------------------------------------------------------------- runs and batches
@query(
    "run_grouping",
    f"""WITH {CL}, g AS (SELECT *, CASE WHEN op IS NOT DISTINCT FROM lag(op) OVER (PARTITION BY k ORDER BY lsn) AND lag(lsn) OVER (PARTITION BY k ORDER BY lsn) IS NOT NULL THEN 0 ELSE 1 END AS f FROM cl)
SELECT k, lsn, op, CAST(sum(f) OVER (PARTITION BY k ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS run FROM g""",
)
def run_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalesce.runs(changes(spark, sf_dir).select("k", "lsn", "op"), F.col("op"), tx="k").select("k", "lsn", "op", F.col("run").cast("long").alias("run"))


@query("insert_row_cap", f"WITH {CL} SELECT k, lsn, CAST(floor((row_number() OVER (PARTITION BY k ORDER BY lsn) - 1) / 7) AS BIGINT) AS part FROM cl WHERE op = 'c'")
def insert_row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalesce.row_capped(changes(spark, sf_dir).where("op = 'c'").select("k", "lsn"), 7, ["k"])


@query(
    "byte_cap_runs",
    """WITH RECURSIVE n AS (SELECT user_id, event_id, length(props) + 2 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT user_id, event_id, i, cost AS filled, CAST(0 AS BIGINT) AS piece FROM n WHERE i = 1
      UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN g.filled + n.cost > 300 THEN n.cost ELSE g.filled + n.cost END, CASE WHEN g.filled + n.cost > 300 THEN g.piece + 1 ELSE g.piece END
      FROM g JOIN n ON n.user_id = g.user_id AND n.i = g.i + 1)
SELECT user_id, event_id, piece FROM g""",
)
def byte_cap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "props")
    return coalesce.byte_capped(events, F.length("props") + 2, 300, ["user_id"], "event_id").select("user_id", "event_id", "piece")


@query(
    "bulk_eligible_batches",
    f"""WITH {CL}, m AS (SELECT tx_id, CASE WHEN tx_id % 3 = 0 THEN 'c' ELSE op END AS op, CASE WHEN tx_id % 6 = 0 THEN 'one' ELSE event_type END AS shape FROM cl)
SELECT tx_id, count(*) AS n, bool_and(op = 'c') AND count(DISTINCT shape) = 1 AND count(*) >= 2 AS bulk FROM m GROUP BY tx_id""",
)
def bulk_eligible_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole transactions: every third creates rows only, every sixth of one shape."""
    op = F.when(F.col("tx_id") % 3 == 0, "c").otherwise(F.col("op"))
    shape = F.when(F.col("tx_id") % 6 == 0, "one").otherwise(F.col("event_type"))
    return coalesce.bulk_eligible(changes(spark, sf_dir).withColumn("op", op), shape, ["tx_id"], 2)


@query(
    "multi_row_insert",
    """SELECT c_nationkey, 'INSERT INTO "customer" ("id", "name") VALUES ' || string_agg('(''' || c_custkey || ''', ''' || replace(c_name, '''', '''''') || ''')', ', ' ORDER BY c_custkey) || ';' AS statement FROM customer GROUP BY c_nationkey""",
)
def multi_row_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    tuple_ = F.concat(F.lit("("), ANSI.text(F.col("c_custkey").cast("string")), F.lit(", "), ANSI.text(F.col("c_name")), F.lit(")"))
    return coalesce.multi_row_insert(rows, ["c_nationkey"], F.lit('INSERT INTO "customer" ("id", "name")'), tuple_, "c_custkey")


@query(
    "or_delete",
    """SELECT s_nationkey, 'DELETE FROM "supplier" WHERE ' || string_agg('("s_suppkey" = ''' || s_suppkey || ''')', ' OR ' ORDER BY s_suppkey) || ';' AS statement FROM supplier GROUP BY s_nationkey""",
)
def or_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicate = F.concat(F.lit('"s_suppkey" = '), ANSI.text(F.col("s_suppkey").cast("string")))
    return coalesce.or_delete(ANSI, read(spark, sf_dir, "supplier"), ["s_nationkey"], F.lit('"supplier"'), predicate, "s_suppkey")


@query(
    "union_all_rows",
    """SELECT c_nationkey, 'SELECT ' || string_agg(CASE WHEN n = 1 THEN '''' || c_custkey || ''' AS "id", ''' || c_name || ''' AS "name"' ELSE '''' || c_custkey || ''', ''' || c_name || '''' END, ' UNION ALL SELECT ' ORDER BY n) AS body
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) GROUP BY c_nationkey""",
)
def union_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table that a join with new values is written with."""
    values = F.array(ANSI.text(F.col("c_custkey").cast("string")), ANSI.text(F.col("c_name")))
    return coalesce.union_all(read(spark, sf_dir, "customer"), ["c_nationkey"], [ANSI.named("id"), ANSI.named("name")], values, "c_custkey").withColumnRenamed("statement", "body")


# ---------------------------------------------------------------- metrics
@query(
    "event_counts",
    """WITH l AS (SELECT CASE WHEN event_id % 100 = 0 THEN 't' ELSE 'u' END AS event, CASE WHEN event_id % 100 = 0 THEN 'public.a,public.' || event_type ELSE event_type END AS "table" FROM events)
SELECT event, "table", count(*) AS n FROM l GROUP BY ALL""",
)
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_id") % 100 == 0
    tables = F.array(F.lit("public.a"), F.concat(F.lit("public."), F.col("event_type")))
    log = read(spark, sf_dir, "events").select(F.when(t, "t").otherwise("u").alias("event"), F.when(t, metrics.truncated_tables(tables)).otherwise(F.col("event_type")).alias("table"))
    return metrics.event_counts(log)


@query("error_counts", "SELECT event_type AS kind, user_id % 4 AS component, count(*) AS n FROM events GROUP BY ALL")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_counts(read(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("component")))


@query("tx_counts", f"WITH {CL} SELECT count(DISTINCT tx_id) AS processed, count(DISTINCT CASE WHEN op = 'd' THEN tx_id END) AS complete FROM cl")
def tx_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.transaction_counts(changes(spark, sf_dir), is_final=F.col("op") == "d")


@query("event_rate_60s", "SELECT time_bucket(INTERVAL 60 seconds, ts) AS window_start, count(*) / 60.0::DOUBLE AS per_second FROM events GROUP BY 1")
def event_rate_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_rate(read(spark, sf_dir, "events"))


@query(
    "flush_lsn_progress",
    """SELECT user_id, event_id AS seq, max(CASE WHEN l > 0 THEN l END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flush_lsn
FROM (SELECT user_id, event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id - (event_id % 4) * 30 END AS l FROM events)""",
)
def flush_lsn_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.col("event_id") - (F.col("event_id") % 4) * 30)
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), at.alias("l"))
    return metrics.flush_progress(rows, "l", "user_id").select("user_id", "seq", "flush_lsn")


@query("pending_counter", f"WITH {TX} SELECT CAST(greatest(0, count(*) - count(CASE WHEN commit_lsn <= 500 THEN 1 END)) AS BIGINT) AS pending FROM tx")
def pending_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = committed(spark, sf_dir)
    return metrics.pending(tx, tx.where("commit_lsn <= 500"))


@query("latest_gauges", "SELECT event_type, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def latest_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(read(spark, sf_dir, "events"), "event_type", "value", "event_id")


@query(
    "duration_histogram",
    """WITH e(le, top) AS (VALUES ('1.0', 1.0::DOUBLE), ('10.0', 10.0), ('50.0', 50.0), ('100.0', 100.0), ('+Inf', 'Infinity'::DOUBLE))
SELECT event_type, le, count(CASE WHEN value <= top THEN 1 END) AS n FROM events CROSS JOIN e GROUP BY event_type, le""",
)
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.duration_histogram(read(spark, sf_dir, "events"), "value", ["event_type"], (1.0, 10.0, 50.0, 100.0))


@query("segment_counts", "SELECT CAST(floor(event_id / 500) AS BIGINT) AS segment, count(*) AS n_statements FROM events GROUP BY 1")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.segment_counts(read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("segment")))


# ---------------------------------------------------------------- scalars
@query(
    "lsn_roundtrip",
    """SELECT o_orderkey, o_orderkey * 123456789 + o_custkey AS lsn, printf('%X/%X', (o_orderkey * 123456789 + o_custkey) >> 32, (o_orderkey * 123456789 + o_custkey) & 4294967295) AS text FROM orders""",
)
def lsn_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", format_lsn(F.col("o_orderkey") * 123456789 + F.col("o_custkey")).alias("text"))
    return rows.select("o_orderkey", parse_lsn(F.col("text")).alias("lsn"), "text")


TEXT_IN_SQL = "replace(replace(text, ' the ', ' \"the\" '), ' de ', ' `d''e]\\ ')"


def odd_text() -> Column:
    """Texts of documents with every sign that a dialect escapes."""
    return F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(' "the" ')), F.lit(" de "), F.lit(" `d'e]\\ "))


def _quoting(name: str, d: Dialect, open_: str, close: str) -> None:
    sql = f"""SELECT doc_id, '{open_}' || replace({TEXT_IN_SQL}, '{close}', '{close * 2}') || '{close}' AS quoted,
  '{open_}' || replace(source, '{close}', '{close * 2}') || '{close}.{open_}' || replace(lang, '{close}', '{close * 2}') || '{close}' AS qualified FROM documents"""

    @query(f"quote_identifier_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "documents").select("doc_id", d.quote(odd_text()).alias("quoted"), d.qualify(F.col("source"), F.col("lang")).alias("qualified"))


for _name, _d, _a, _b in (("ansi", ANSI, '"', '"'), ("mysql", MYSQL, "`", "`"), ("sqlserver", SQLSERVER, "[", "]")):
    _quoting(_name, _d, _a, _b)


def _values(name: str, d: Dialect) -> None:
    x = "replace(x, '\\', '\\\\')" if d.double_backslash else "x"
    hex_ = "'0x' || lower(hex(encode(x)))" if name == "sqlserver" else "'X''' || lower(hex(encode(x))) || ''''"
    sql = f"""WITH v AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 't' WHEN 2 THEN 'f' ELSE {TEXT_IN_SQL} END AS x, doc_id % 7 = 3 AS b FROM documents)
SELECT doc_id, CASE WHEN x IS NULL THEN 'NULL' WHEN b THEN {hex_} WHEN x = 't' THEN '1' WHEN x = 'f' THEN '0' ELSE '''' || replace({x}, '''', '''''') || '''' END AS literal FROM v"""

    @query(f"render_value_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.col("doc_id") % 7
        x = F.when(n == 0, None).when(n == 1, "t").when(n == 2, "f").otherwise(odd_text())
        kind = F.when(n == 0, "null").when(n == 3, "binary").otherwise("text")
        v = F.struct(kind.alias("kind"), x.cast("binary").alias("bytes"))
        return read(spark, sf_dir, "documents").select("doc_id", d.value(v).alias("literal"))


for _name, _d in (("ansi", ANSI), ("mysql", MYSQL), ("sqlserver", SQLSERVER)):
    _values(_name, _d)


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as rows of the changelog: creates, updates and deletes by turns, a truncation now and then."""
    n = F.col("o_orderkey") % 10
    event = F.when(n < 4, "c").when(n < 7, "u").when(n < 9, "d").otherwise("t")
    row = image(id=F.col("o_orderkey"), status=F.col("o_orderstatus"), priority=F.when(n == 5, None).otherwise(F.col("o_orderpriority")))
    old = image(id=F.col("o_orderkey"), status=F.col("o_orderstatus"), priority=F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderpriority")))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("lsn"), F.lit(0).alias("seq"), (F.col("o_orderkey") % 1000).alias("tx_id"), F.lit(None).cast("long").alias("sub_xid"),
        F.col("o_orderkey").alias("commit_lsn"), F.col("o_orderdate").cast("timestamp").alias("commit_ts"), event.alias("event"), F.lit("public").alias("schema"), F.lit("orders").alias("table"),
        F.lit(None).cast("long").alias("relation_oid"), F.when(F.col("o_orderkey") % 2 == 0, "default").otherwise("full").alias("replica_identity"),
        F.array(F.lit("id")).alias("key_columns"), F.when(event.isin("u", "d"), old).alias("before"), F.when(event.isin("c", "u"), row).alias("after"),
        F.when(event == "t", F.array(F.lit("public.orders"), F.lit("a.b.c"))).alias("tables"),
    )


def _dml(name: str, d: Dialect, open_: str, close: str) -> None:
    q = lambda x: f"{open_}{x}{close}"
    table = lambda s, t: q(t) if name == "sqlite" else f"{q(s)}.{q(t)}"
    cut = "DELETE FROM " if name == "sqlite" else "TRUNCATE TABLE "
    lit = lambda x: f"CASE WHEN {x} IS NULL THEN 'NULL' ELSE '''' || {x} || '''' END"
    same = lambda c, x: f"CASE WHEN {x} IS NULL THEN '{q(c)} IS NULL' ELSE '{q(c)} = ''' || {x} || '''' END"
    where = f"CASE WHEN k % 2 = 0 THEN '{q('id')} = ''' || k || '''' ELSE '{q('id')} = ''' || k || ''' AND {q('status')} = ''' || s || ''' AND ' || {same('priority', 'o')} END"
    sql = f"""WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 10 = 5 THEN NULL ELSE o_orderpriority END AS p,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o, o_orderkey % 10 AS n FROM orders)
SELECT k AS lsn, CASE WHEN n < 4 THEN 'INSERT INTO {table("main", "orders")} ({q("id")}, {q("status")}, {q("priority")}) VALUES (''' || k || ''', ''' || s || ''', ' || {lit("p")} || ');'
  WHEN n < 7 THEN 'UPDATE {table("main", "orders")} SET {q("id")} = ''' || k || ''', {q("status")} = ''' || s || ''', {q("priority")} = ' || {lit("p")} || ' WHERE ' || {where} || ';'
  WHEN n < 9 THEN 'DELETE FROM {table("main", "orders")} WHERE ' || {where} || ';'
  ELSE '{cut}{table("main", "orders")};' || chr(10) || '{cut}{table("main", "a.b.c")};' END AS statement FROM r"""

    @query(f"render_dml_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return order_changes(spark, sf_dir).select("lsn", render.change_sql(d, {"public": "main"}).alias("statement"))


for _name, _d, _a, _b in (("ansi", ANSI, '"', '"'), ("mysql", MYSQL, "`", "`"), ("sqlite", SQLITE, '"', '"'), ("sqlserver", SQLSERVER, "[", "]")):
    _dml(_name, _d, _a, _b)


@query(
    "row_json",
    """SELECT o_orderkey, '{"id":"' || o_orderkey || '","status":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || ',"raw":"' || to_base64(encode(o_orderpriority)) || '"}' AS json,
  'app.main.orders.Key' AS key_name FROM orders""",
)
def row_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schema import IMAGE_DDL, value

    row = F.array(
        value("id", F.col("o_orderkey")), value("status", F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderstatus"))), value("raw", F.col("o_orderpriority"), "binary")
    ).cast(IMAGE_DDL)
    name = envelope.topic("app", mapping.map_schema(F.lit("public"), {"public": "main"}), F.lit("orders"), "Key")
    return read(spark, sf_dir, "orders").select("o_orderkey", envelope.row_json(row).alias("json"), name.alias("key_name"))


@query("key_predicate_default", "SELECT o_orderkey, '\"id\" = ''' || o_orderkey || ''' AND \"status\" = ''' || o_orderstatus || '''' AS predicate FROM orders")
def key_predicate_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = image(id=F.col("o_orderkey"), status=F.col("o_orderstatus"))
    keys = F.array(F.lit("id"), F.lit("status"))
    none = F.lit(None).cast(row_type())
    return read(spark, sf_dir, "orders").select("o_orderkey", render.key_predicate(ANSI, F.lit("default"), keys, none, row).alias("predicate"))


def row_type() -> str:
    from ..schema import IMAGE_DDL

    return IMAGE_DDL


@query(
    "key_predicate_full",
    "SELECT o_orderkey, '`id` = ''' || o_orderkey || ''' AND ' || CASE WHEN o_orderkey % 3 = 0 THEN '`status` IS NULL' ELSE '`status` = ''' || o_orderstatus || '''' END AS predicate FROM orders",
)
def key_predicate_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = image(id=F.col("o_orderkey"), status=F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderstatus")))
    return read(spark, sf_dir, "orders").select("o_orderkey", render.key_predicate(MYSQL, F.lit("full"), F.array().cast("array<string>"), row, row).alias("predicate"))


@query(
    "tsv_encode",
    r"""SELECT doc_id, doc_id || chr(9) || CASE doc_id % 5 WHEN 0 THEN '\N' WHEN 1 THEN '1' ELSE replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') END AS line FROM documents""",
)
def tsv_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 5
    row = image(id=F.col("doc_id"), text=F.when(n == 0, None).when(n == 1, "True").otherwise(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", tsv_line(row).alias("line"))


@query(
    "typed_literals",
    """WITH l AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN ' null ' WHEN 1 THEN '''it''''s ' || o_orderstatus || '''' WHEN 2 THEN '0xDEADbeef' WHEN 3 THEN 'TRUE' WHEN 4 THEN o_custkey::VARCHAR
  WHEN 5 THEN '-' || o_orderkey || '.5' WHEN 6 THEN 'X''00ff''' ELSE o_orderpriority END AS x FROM orders)
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'null' WHEN 1 THEN 'string' WHEN 2 THEN 'binary' WHEN 3 THEN 'bit' WHEN 4 THEN 'int' WHEN 5 THEN 'float' WHEN 6 THEN 'binary' ELSE 'string' END AS kind,
  CASE o_orderkey % 8 WHEN 1 THEN 'it''s ' || right(left(x, length(x) - 1), length(x) - 8) WHEN 7 THEN trim(x) END AS text,
  CASE o_orderkey % 8 WHEN 3 THEN 1 WHEN 4 THEN x::BIGINT END AS i, CASE o_orderkey % 8 WHEN 5 THEN x::DOUBLE END AS d,
  CASE o_orderkey % 8 WHEN 2 THEN 'DEADBEEF' WHEN 6 THEN '00FF' END AS b FROM l""",
)
def typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("o_orderkey") % 8, F.col
    x = (
        F.when(n == 0, " null ").when(n == 1, F.concat(F.lit("'it''s "), c("o_orderstatus"), F.lit("'"))).when(n == 2, "0xDEADbeef").when(n == 3, "TRUE")
        .when(n == 4, c("o_custkey").cast("string")).when(n == 5, F.concat(F.lit("-"), c("o_orderkey").cast("string"), F.lit(".5"))).when(n == 6, "X'00ff'").otherwise(c("o_orderpriority"))
    )
    rows = read(spark, sf_dir, "orders").select("o_orderkey", typed_literal(x).alias("v"))
    return rows.select("o_orderkey", "v.kind", "v.text", "v.i", "v.d", F.hex("v.b").alias("b"))


# ---------------------------------------------------------------- envelopes
@query(
    "key_cache",
    """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'c' WHEN event_id % 3 = 1 THEN 'u' ELSE 'd' END AS op, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'k' || (event_id % 2) END AS own FROM events),
f AS (SELECT event_type, min(event_id) AS since, arg_min(own, event_id) AS keys FROM e WHERE op <> 'c' AND own IS NOT NULL GROUP BY event_type)
SELECT event_id, CASE WHEN e.event_type = 'view' THEN 'vid' WHEN op <> 'c' THEN own WHEN since <= event_id THEN keys END AS effective_keys FROM e LEFT JOIN f USING (event_type)""",
)
def key_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    own = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("k"), (F.col("event_id") % 2).cast("string"))))
    log = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("lsn"), F.lit("public").alias("schema"), F.col("event_type").alias("table"),
        F.when(n == 0, "c").when(n == 1, "u").otherwise("d").alias("event"), own.alias("key_columns"),
    )
    found = envelope.learned_keys(log, {"public.view": ["vid"]})
    return found.select(F.col("lsn").alias("event_id"), F.nullif(F.array_join("effective_keys", ","), F.lit("")).alias("effective_keys"))


@query(
    "envelope_fields",
    """WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderdate AS ts, CASE WHEN o_orderkey % 10 = 5 THEN NULL ELSE o_orderpriority END AS p,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o, o_orderkey % 10 AS n FROM orders),
m AS (SELECT k, unnest(CASE WHEN n = 9 THEN ['orders', 'a.b.c'] ELSE ['orders'] END) AS t, s, p, o, n, ts FROM r), f AS (SELECT min(k) AS since FROM r WHERE n BETWEEN 4 AND 8)
SELECT k AS lsn, 'app.main.' || t AS topic, CASE WHEN n < 4 AND k >= f.since OR n BETWEEN 4 AND 8 THEN k::VARCHAR END AS key_id,
  CASE WHEN n < 4 THEN 'c' WHEN n < 7 THEN 'u' WHEN n < 9 THEN 'd' ELSE 't' END AS op,
  CASE WHEN n BETWEEN 4 AND 8 THEN k::VARCHAR END AS before_id, CASE WHEN n BETWEEN 4 AND 8 THEN o END AS before_priority,
  CASE WHEN n < 7 THEN s END AS after_status, CASE WHEN n < 7 THEN p END AS after_priority, 'main' AS source_schema, t AS source_table, (k % 1000)::VARCHAR AS tx, k::VARCHAR AS source_lsn,
  epoch_ms(ts)::VARCHAR AS ts_ms, 'app.main.' || t || '.Envelope' AS envelope_name, CASE WHEN n < 9 THEN 3 ELSE 0 END AS n_fields
FROM m, f""",
)
def envelope_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a log, read back: each is parsed once, for the fields that are looked at."""
    out = envelope.envelope(order_changes(spark, sf_dir), "app", "shop", {"public": "main"})
    row = "struct<id:string,status:string,priority:string>"
    source = "struct<schema:string,table:string,txId:string,lsn:string>"
    message = f"struct<payload:struct<op:string,before:{row},after:{row},source:{source},ts_ms:string>,schema:struct<name:string,fields:array<struct<fields:array<struct<field:string>>>>>>"
    read_back = out.select("lsn", "topic", F.from_json("key", "struct<payload:struct<id:string>>").alias("k"), F.from_json("value", message).alias("m"))
    return read_back.select(
        "lsn", "topic", F.col("k.payload.id").alias("key_id"), F.col("m.payload.op").alias("op"), F.col("m.payload.before.id").alias("before_id"),
        F.col("m.payload.before.priority").alias("before_priority"), F.col("m.payload.after.status").alias("after_status"), F.col("m.payload.after.priority").alias("after_priority"),
        F.col("m.payload.source.schema").alias("source_schema"), F.col("m.payload.source.table").alias("source_table"), F.col("m.payload.source.txId").alias("tx"),
        F.col("m.payload.source.lsn").alias("source_lsn"), F.col("m.payload.ts_ms").alias("ts_ms"), F.col("m.schema.name").alias("envelope_name"),
        F.size(F.col("m.schema.fields")[0]["fields"]).alias("n_fields"),
    )


@query("statement_split")
def statement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of texts put together from rendered changes, split again: each comes back. (Checked by a round trip.)"""
    from ..functions.sqltext import explode_statements

    rows = order_changes(spark, sf_dir).select("tx_id", "lsn", render.change_sql(MYSQL).alias("sql"))
    files = rows.groupBy("tx_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lsn", "sql"))), lambda x: x["sql"]), "\n").alias("value"))
    return explode_statements(files)
