"""Chat formatting (operator 5): tool calls linked to their results, in DataFrame and SQL functions only.

A turn whose text is a JSON object may carry tool_calls, a list of {id, name, arguments} (name and arguments may also
stand under `function`), and content; a turn of role `tool` carries tool_call_id and content. Calls and results meet in a
hash join by conversation and identifier, each side first reduced to one row for an identifier. Messages are put in
topological order: a result comes right behind the message that calls it, by the call's place there, wherever it stood.
Results call nothing, so that graph is one step deep and its order a key of four numbers; no task needs a conversation
whole. Arguments are checked against the tools' schemas. Each message becomes one line of canonical JSON: names in order of code
points, no blanks, absent parts left out.

The table is read twice: once for the messages that call or answer, which are cut off and linked among themselves, and once for all the rest.

Defined cases: null text reads as empty; texts of any length are read whole; text that isn't a JSON object of the kind above is content as it stands; a call
or result without an identifier links with nothing; arguments that aren't JSON are written as a string; of calls (results) that repeat an identifier the first by turn and
place links, later ones are reported as repeated; a result without a call stays at its turn and is reported as
orphan; a call without a result is reported as unanswered; null turns come first; a row that repeats a conversation and
turn is a message of its own; empty tables give empty results; other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named, table

CALL = "struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>"
BODY = f"struct<content:string,tool_calls:array<{CALL}>,tool_call_id:string>"
#: JSON types of a schema -> types of a variant that fit.
FITS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
MAX_PARAMETERS = 100_000

Schemas = dict[str, dict[str, tuple[str, bool]]]  # tool -> parameter -> (JSON type, required)


def _schema_map(schemas: Schemas) -> Column:
    """The schemas as one literal: tool -> array<struct<p, fits, needed>>."""
    if sum(map(len, schemas.values())) > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} parameters")
    kind = "map<string,array<struct<p:string,fits:array<string>,needed:boolean>>>"
    pairs = []
    for tool, parameters in sorted(schemas.items()):
        rows = [F.struct(F.lit(p).alias("p"), F.array(*[F.lit(x) for x in FITS[t]]).alias("fits"), F.lit(needed).alias("needed")) for p, (t, needed) in sorted(parameters.items())]
        pairs += [F.lit(tool), F.array(*rows).cast("array<struct<p:string,fits:array<string>,needed:boolean>>")]
    return F.create_map(*pairs).cast(kind) if pairs else F.create_map().cast(kind)


def _problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, in order: [] if nothing."""
    known = F.element_at(_schema_map(schemas), name)
    values = F.from_json(arguments, "map<string,variant>")
    types = F.transform_values(values, lambda _, v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    given = F.map_keys(types)
    missing = F.transform(F.filter(known, lambda s: s["needed"] & ~F.array_contains(given, s["p"])), lambda s: F.concat(F.lit("missing:"), s["p"]))
    wrong = F.filter(known, lambda s: F.array_contains(given, s["p"]) & ~F.array_contains(s["fits"], F.element_at(types, s["p"])))
    unknown = F.array_except(given, F.transform(known, lambda s: s["p"]))
    return (
        F.when(name.isNull() | known.isNull(), F.array(F.lit("tool")))
        .when(values.isNull(), F.array(F.lit("arguments")))
        .otherwise(F.array_sort(F.concat(missing, F.transform(wrong, lambda s: F.concat(F.lit("type:"), s["p"])), F.transform(unknown, lambda p: F.concat(F.lit("unknown:"), p)))))
    )


def format_chats(turns: DataFrame, schemas: Schemas, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: conv_id, turn, role, order_turn, order_kind, order_call, order_result, message (canonical
    JSON), n_calls, linked_turn (of a result's call), problems (array)."""
    text = F.coalesce(named(text_col), F.lit(""))
    looks = text.rlike(r"^\s*\{[\s\S]*\}\s*$")
    body = F.from_json(F.when(looks, text), BODY)
    rows = turns.select(named(conv_col).alias("conv"), named(turn_col).cast("long").alias("turn"), named(role_col).alias("role"), text.alias("raw"), body.alias("body"))
    calls = F.transform(
        "body.tool_calls",
        lambda c: F.struct(
            c["id"].alias("id"),
            F.coalesce(c["name"], c["function"]["name"]).alias("name"),
            F.coalesce(c["arguments"], c["function"]["arguments"]).alias("arguments"),
        ),
    )
    tool = F.col("role") == "tool"
    has_calls = ~F.coalesce(tool, F.lit(False)) & F.col("body.tool_calls").isNotNull()
    rows = rows.withColumn("calls", F.when(has_calls, calls).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>")))
    rows = rows.withColumn("result_id", F.when(tool, F.col("body.tool_call_id")))
    rows = rows.withColumn("content", F.when(has_calls | F.col("result_id").isNotNull(), F.col("body.content")).otherwise(F.col("raw")))
    links = F.col("result_id").isNotNull() | (F.size("calls") > 0)
    plain = rows.where(~links)
    rows = cut(rows.where(links).drop("raw", "body"))

    # One row for each identifier on either side, then the hash join.
    each = rows.select("conv", "turn", F.posexplode("calls").alias("pos", "c")).where("c.id is not null")
    first_call = each.groupBy("conv", F.col("c.id").alias("id")).agg(F.min(F.struct("turn", "pos")).alias("call"), F.count(F.lit(1)).alias("n_same"))
    answers = rows.where("result_id is not null").groupBy("conv", F.col("result_id").alias("id")).agg(F.min("turn").alias("answer"))
    linked = first_call.hint("shuffle_hash").join(answers, ["conv", "id"], "left")

    # Back to the messages: results by their identifier, calling messages by theirs.
    to_result = linked.select(F.col("conv").alias("c1"), F.col("id").alias("i1"), "call", F.col("answer").alias("first_answer"))
    results = rows.where("result_id is not null").join(to_result, (F.col("conv") == F.col("c1")) & (F.col("result_id") == F.col("i1")), "left")
    state = linked.select(
        F.col("conv").alias("c2"), F.col("call.turn").alias("t2"), F.when(F.col("n_same") > 1, F.concat(F.lit("repeated:"), "id")).alias("again"), F.when(F.col("answer").isNull(), F.concat(F.lit("unanswered:"), "id")).alias("open")
    )
    state = state.groupBy("c2", "t2").agg(F.array_sort(F.concat(F.collect_set("again"), F.collect_set("open"))).alias("about"))
    callers = rows.where(F.size("calls") > 0).join(state, (F.col("conv") == F.col("c2")) & F.col("turn").eqNullSafe(F.col("t2")), "left")

    checked = F.flatten(F.transform("calls", lambda c: F.transform(_problems(c["name"], c["arguments"], schemas), lambda p: F.concat_ws(":", c["id"], p))))
    as_text = lambda a: F.variant_get(F.parse_json(F.to_json(F.struct(a.alias("s")))), "$.s", "variant")
    out_calls = F.transform("calls", lambda c: F.struct(F.coalesce(F.try_parse_json(c["arguments"]), as_text(c["arguments"])).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    none = F.lit(None).cast("long")
    empty = F.array().cast("array<string>")
    simple = F.to_json(F.struct("content", "role"))
    zero = F.lit(0).cast("long")
    at = lambda turn, kind, call, result: {"order_turn": turn, "order_kind": kind, "order_call": call, "order_result": result}
    plain = plain.withColumns(at(F.col("turn"), F.lit(0), zero, zero) | {"message": simple, "n_calls": F.lit(0), "linked_turn": none, "problems": empty})
    callers = callers.withColumns(
        at(F.col("turn"), F.lit(0), zero, zero)
        | {
            "message": F.to_json(F.struct("content", "role", out_calls.alias("tool_calls"))),
            "n_calls": F.size("calls"),
            "linked_turn": none,
            "problems": F.concat(checked, F.coalesce("about", empty)),
        }
    )
    found = F.col("call").isNotNull()
    repeated = found & (F.col("turn") > F.col("first_answer"))
    results = results.withColumns(
        at(
            F.when(found, F.col("call.turn")).otherwise(F.col("turn")),
            F.when(found, 1).otherwise(0),
            F.when(found, F.col("call.pos").cast("long")).otherwise(zero),
            F.when(found, F.col("turn")).otherwise(zero),
        )
        | {
            "message": F.to_json(F.struct("content", "role", F.col("result_id").alias("tool_call_id"))),
            "n_calls": F.lit(0),
            "linked_turn": F.col("call.turn"),
            "problems": F.when(~found, F.array(F.concat(F.lit("orphan:"), "result_id"))).when(repeated, F.array(F.concat(F.lit("repeated:"), "result_id"))).otherwise(empty),
        }
    )
    names = ["conv", "turn", "role", "order_turn", "order_kind", "order_call", "order_result", "message", "n_calls", "linked_turn", "problems"]
    both = plain.select(*names).unionByName(callers.select(*names)).unionByName(results.select(*names))
    return both.withColumnsRenamed({"conv": "conv_id"})


#: Tools that the query knows.
TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "lookup": {"id": ("string", True), "fields": ("array", False)},
}


# ---------------------------------------------------------------- query
def op5_tool_call_linking(spark, sf_dir: str) -> DataFrame:
    found = format_chats(table(spark, sf_dir, "conversations"), TOOLS)
    return found.withColumn("problems", F.array_join("problems", ","))
