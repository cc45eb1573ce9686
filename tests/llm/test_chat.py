import json
import random

import pytest

from pagewright.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def tag(kind, value):
    return f"<tool_{kind}>{json.dumps(value)}</tool_{kind}>"


def call(i, *on):
    return tag("call", {"id": i, "name": "f", "arguments": {"x": [{"$result": o} for o in on]}})


def brute(rows):
    """(conv, turn, seq) -> (kind, linked, problems, at_turn, at_level), by one conversation after the other."""
    events = [(c, t, *e) for c, t, r, x in rows for e in chat.parse(c, t, r, x)]
    out = {}
    for conv in {c for c, *_ in events}:
        mine = sorted(e for e in events if e[0] == conv)
        calls, results, schemas = {}, {}, {}
        for e in mine if conv is not None else []:
            if e[3] == "call":
                calls.setdefault(e[4], e)
            elif e[3] == "result":
                results.setdefault(e[4], e)
            elif e[3] == "schema":
                schemas[e[4]] = json.loads(e[6])
        needs = {k: {r for r in e[8] if r in calls} for k, e in calls.items()}
        place, left = {}, dict(needs)
        while ready := [k for k, on in left.items() if all(o in place for o in on)]:
            for k in ready:
                place[k] = max([(calls[k][1], 0), *((place[o][0], place[o][1] + 2) for o in left[k])])
            for k in ready:
                del left[k]
        ring = set(left)
        while loose := [k for k in ring if not any(k in needs[o] for o in ring)]:
            ring -= set(loose)
        for e in mine:
            _, turn, seq, kind, key, _, body, name, _ = e
            if kind == "call":
                first = calls.get(key) == e
                said = ["no schema"] if name not in schemas else chat.problems(json.loads(body), schemas[name])
                said += [] if first else ["repeated identifier"]
                stuck = first and key in left
                said += (["cycle"] if key in ring else ["waits for a cycle"]) if stuck else []
                at = place[key] if first and not stuck else (turn, 0)
                out[conv, turn, seq] = (kind, first and key in results, "; ".join(x for x in said if x), *at)
            elif kind == "result":
                first, known = results.get(key) == e, key in calls
                at = (place.get(key, (calls[key][1], 0)) if known else (turn, 0))
                tied = first and known
                late = tied and at[0] >= turn
                out[conv, turn, seq] = (kind, tied, "no call" if not known else "" if first else "repeated identifier", *((at[0], at[1] + 1) if late else (turn, 0)))
            else:
                out[conv, turn, seq] = (kind, None, None, turn, 0)
    return out


def found(df):
    return {(r.conv_id, r.turn, r.seq): (r.kind, r.linked, r.problems, r.at_turn, r.at_level) for r in chat.format_chats(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linking_against_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for conv in [1, 2, 3, 4, None]:
        names = [f"c{i}" for i in range(8)]
        for turn in range(12):
            parts = []
            for _ in range(rng.randint(0, 3)):
                kind = rng.random()
                if kind < 0.55:
                    parts.append(call(rng.choice(names), *rng.sample(names, rng.choice([0, 0, 1, 2]))))
                elif kind < 0.9:
                    parts.append(tag("result", {"id": rng.choice(names), "content": turn}))
                else:
                    parts.append(tag("schema", {"name": "f", "parameters": {"type": "object", "required": rng.choice([["x"], ["y"]])}}))
            rows.append((conv, turn, "assistant", " and ".join(parts) or None))
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_long_chain_is_no_cycle(spark):
    n = 70
    chain = "".join(call(f"c{i}", *([f"c{i - 1}"] if i else [])) for i in reversed(range(n)))
    ring = call("a", "b") + call("b", "a") + call("behind", "a") + call("before")
    rows = [(1, 0, "assistant", chain), (2, 0, "assistant", ring)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r[4] for (c, *_), r in got.items() if c == 1 and r[0] == "call") == list(range(0, 2 * n, 2))
    assert got == brute(rows)
    assert [got[2, 0, s][2] for s in (1, 2, 3, 4)] == ["no schema; cycle", "no schema; cycle", "no schema; waits for a cycle", "no schema"]


def test_hostile_parts_stay_text(spark):
    deep = "[" * 5000 + "]" * 5000
    bad = [f'{{"id":"a","name":"f","arguments":{deep}}}', '{"id":"a","name":"f","arguments":NaN}', '{"id":"a","name":"f","arguments":1e999}', '{"id":"a","name":"f","arguments":' + "9" * 9000 + "}", "{", "[1]", '{"id":3,"name":"f"}']
    rows = [(1, i, "assistant", f"x<tool_call>{b}</tool_call>y") for i, b in enumerate(bad)]
    rows += [(2, 0, "assistant", '<tool_call>{"id":"\\ud800","name":"f","arguments":{"s":"\\udc00","n":' + "9" * 400 + "}}</tool_call>"), (2, 1, "tool", tag("result", {"id": "q" * 300_000, "content": None}))]
    rows += [(3, 0, "system", tag("schema", {"name": "f", "parameters": {"required": 5, "minimum": "0", "enum": 3, "properties": [], "maxLength": "x"}})), (3, 1, "assistant", tag("call", {"id": "a", "name": "f", "arguments": {}}))]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.kind for r in got if r.conv_id == 1] == ["message"] * len(bad)
    assert all(json.loads(r.json)["content"] == rows[r.turn][3] for r in got if r.conv_id == 1)
    one = next(r for r in got if r.conv_id == 2 and r.kind == "call")
    assert "\\ud800" in one.json and json.loads(one.json)["arguments"] == {"s": "\udc00", "n": int("9" * 400)}
    assert next(r for r in got if r.conv_id == 3 and r.kind == "call").problems == "$: schema enum; $: schema properties; $: schema required"


def test_rows_of_every_kind(spark):
    twice = (1, 1, "assistant", call("a") + tag("result", {"id": "a", "content": 1}))
    rows = [twice, twice, (1, 2, None, None), (None, 1, "user", ""), (1, 1, "assistant", call("a", "zz"))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", json string, seq int")
    got = chat.format_chats(df).collect()
    assert sorted((r.kind, r.problems) for r in got if r.kind != "message") == [("call", "no schema"), ("call", "no schema"), ("call", "no schema; repeated identifier"), ("result", ""), ("result", "")]
    assert len([r for r in got if r.kind == "message"]) == 5
    assert chat.format_chats(df.limit(0)).count() == 0
    text = spark.createDataFrame([("k", 0, "user", "hi")], "conv_id string, turn int, role string, text string")
    assert [r.conv_id for r in chat.format_chats(text).collect()] == ["k"]
