"""Tool calls linked to results, against a plain Python version."""

import json

from pyspark.sql import functions as F

from tidemark.llm import chat as C

KIND = "conv_id long, turn long, role string, text string, message string"


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", call({"id": "a", "name": "search", "arguments": {"query": "z", "limit": "3", "b": {"y": 1, "a": [1]}}}, {"id": "b", "function": {"name": "calculator", "arguments": '{"expression":"1+1"}'}})),
    (1, 4, "tool", result("a", "r")), (1, 2, "tool", result("b", "2")), (1, 5, "tool", result("q", "x")), (1, 6, "tool", result("a", "again")),
    (2, 1, "tool", result("late", "before its call")), (2, 3, "assistant", call({"id": "late", "name": "lookup", "arguments": {"id": 7}})), (2, 4, "assistant", call({"id": "late", "name": "lookup", "arguments": {"id": "7"}})),
    (3, None, None, None), (3, 1, "user", "{broken"), (3, 2, "user", '{"a": 1}'), (3, 3, "assistant", call({"id": "u", "name": "nope", "arguments": "not json"})), (3, 4, "tool", "plain"), (3, 5, "assistant", call({"name": "search", "arguments": {}})),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, "user", "no conversation"), (5, 0, "user", "x" * 300_000),
]


def formatted(spark, rows=ROWS):
    return C.format_chats(spark.createDataFrame([(*r, "clash") for r in rows], KIND), C.TOOLS)


def test_links_order_and_problems(spark):
    out = formatted(spark)
    assert out.count() == len(ROWS)
    by = lambda conv: out.where(F.col("conv_id") == conv).orderBy("order_turn", "order_kind", "order_call", "order_result").collect()
    one = by(1)
    assert [(r.turn, r.linked_turn) for r in one] == [(0, None), (1, None), (4, 1), (6, 1), (2, 1), (5, None)]
    assert one[1].problems == ["a:type:limit", "a:unknown:b"] and one[5].problems == ["orphan:q"] and one[3].problems == ["repeated:a"] and one[1].n_calls == 2
    assert one[1].message == '{"role":"assistant","tool_calls":[{"arguments":{"b":{"a":[1],"y":1},"limit":"3","query":"z"},"id":"a","name":"search"},{"arguments":{"expression":"1+1"},"id":"b","name":"calculator"}]}'
    two = by(2)
    assert [r.turn for r in two] == [3, 1, 4] and two[0].problems == ["late:type:id", "repeated:late"]
    three = by(3)
    assert [r.message for r in three[:3]] == ['{"content":""}', '{"content":"{broken","role":"user"}', '{"content":"{\\"a\\": 1}","role":"user"}']
    assert three[3].problems == ["u:tool", "unanswered:u"] and json.loads(three[3].message)["tool_calls"][0]["arguments"] == "not json"
    assert three[4].message == '{"content":"plain","role":"tool"}' and three[5].problems == ["missing:query"]
    assert len(by(4)) == 2 and out.where("conv_id is null").count() == 1
    assert len(json.loads(by(5)[0].message)["content"]) == 300_000


def slow_chats(rows, tools):
    """The same in plain Python, one conversation after the other: (turn, role, message, place, linked turn, problems) of each message."""
    fits = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
    out = []
    for conv in {r[0] for r in rows}:
        messages = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            try:
                body = json.loads(text or "")
            except ValueError:
                body = None
            body = body if isinstance(body, dict) else {}
            calls = body.get("tool_calls") if role != "tool" else None
            answer = body.get("tool_call_id") if role == "tool" else None
            messages.append((turn, role, text, body, calls or [], calls is not None, answer))
        first, answers, same = {}, {}, {}
        for turn, _, _, _, calls, _, answer in messages:
            for pos, c in enumerate(calls):
                same[c["id"]] = same.get(c["id"], 0) + 1
                first[c["id"]] = min(first.get(c["id"], (turn, pos)), (turn, pos))
            if answer is not None:
                answers[answer] = min(answers.get(answer, turn), turn)
        for turn, role, text, body, calls, has, answer in messages:
            place, linked, problems = (turn, 0, 0, 0), None, []
            message = {"role": role}
            content = body.get("content") if has or answer is not None else (text or "")
            if content is not None:
                message["content"] = content
            if answer is not None:
                message["tool_call_id"] = answer
                if answer not in first:
                    problems = [f"orphan:{answer}"]
                else:
                    linked, pos = first[answer]
                    place = (linked, 1, pos, turn)
                    problems = [f"repeated:{answer}"] if turn > answers[answer] else []
            if calls:
                message["tool_calls"] = [{"arguments": c["arguments"], "id": c["id"], "name": c["name"]} for c in calls]
                for c in calls:
                    known, given = tools.get(c["name"]), c["arguments"]
                    if known is None:
                        problems.append(f"{c['id']}:tool")
                        continue
                    found = [f"missing:{p}" for p, (_, needed) in known.items() if needed and p not in given]
                    found += [f"type:{p}" for p, (t, _) in known.items() if p in given and (not isinstance(given[p], fits[t]) or (isinstance(given[p], bool) and t != "boolean"))]
                    found += [f"unknown:{p}" for p in given if p not in known]
                    problems += [f"{c['id']}:{x}" for x in sorted(found)]
                mine = {i for i, at in first.items() if at[0] == turn}
                problems += sorted({f"repeated:{i}" for i in mine if same[i] > 1} | {f"unanswered:{i}" for i in mine if i not in answers})
            out.append((conv, turn, json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False), place, linked, problems))
    return sorted(out, key=repr)


def test_against_plain_python(spark):
    import random

    rng, rows = random.Random(3), []
    value = lambda: rng.choice(["x", 3, 2.5, True, ["a"], {"k": 1}])
    for conv in range(60):
        ids = [f"c{rng.randrange(6)}" for _ in range(8)]
        for turn in range(rng.randrange(1, 14)):
            kind = rng.choice(["plain", "call", "call", "result", "result"])
            if kind == "plain":
                rows.append((conv, turn, rng.choice(["user", "assistant", "tool"]), rng.choice(["hello", "{no", None, '{"a": 1}'])))
            elif kind == "call":
                names = rng.sample(["search", "calculator", "lookup", "nope"], 2)
                calls = [{"id": rng.choice(ids), "name": n, "arguments": {p: value() for p in rng.sample(["query", "limit", "expression", "id", "fields", "odd"], 3)}} for n in names]
                rows.append((conv, turn, "assistant", call(*calls, content=rng.choice([None, "thinking"]))))
            else:
                rows.append((conv, turn, "tool", result(rng.choice(ids), rng.choice(["r", "[1]"]))))
    hot = [(999, 2 * i, "assistant", call({"id": f"h{i}", "name": "search", "arguments": {"query": "q"}})) for i in range(400)]
    hot += [(999, 2 * i + 1 if i % 3 else 5000 - i, "tool", result(f"h{i}", "r")) for i in range(400) if i % 7]
    rows += hot
    out = formatted(spark, rows).collect()
    got = sorted(((r.conv_id, r.turn, r.message, (r.order_turn, r.order_kind, r.order_call, r.order_result), r.linked_turn, r.problems) for r in out), key=repr)
    assert got == slow_chats(rows, C.TOOLS)
    places = [(r.conv_id, r.order_turn, r.order_kind, r.order_call, r.order_result) for r in out if r.linked_turn is not None]
    assert len(places) > 300 and all(p[1] == r.linked_turn and p[2] == 1 for p, r in zip(places, [r for r in out if r.linked_turn is not None], strict=True))


def test_messages_are_canonical(spark):
    for r in formatted(spark).collect():
        m = json.loads(r.message)
        assert r.message == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_query_covers_every_turn(spark):
    sf_dir = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn): (r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    out = C.op5_tool_call_linking(spark, sf_dir).collect()
    assert len(out) == len(turns)
    for r in out:
        role, text = turns[(r.conv_id, r.turn)]
        assert json.loads(r.message) == {"content": text, "role": role} and r.problems == ""


def test_empty_and_native(spark):
    assert C.format_chats(spark.createDataFrame([], KIND), C.TOOLS).count() == 0
    assert C.format_chats(spark.createDataFrame([], KIND), {}).count() == 0
    plan = C.op5_tool_call_linking(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
