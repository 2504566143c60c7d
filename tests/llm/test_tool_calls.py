import decimal
import json
import random

import duckdb

from roadloom.llm import tool_calls as T

RESULTS = "conv_id long, call_id string, turn long, content string"
TOOLS = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("find", "where", "object", False), ("find", "tags", "array", True), ("find", "deep", "boolean", False)]


def link(spark, calls, results):
    out = T.link_tool_calls(spark.createDataFrame(calls, T.CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(TOOLS, T.SCHEMAS))
    return out.collect()


def test_cases(spark):
    calls = [
        (1, "x", 1, 0, "add", '{"b": 2.5, "a": 1}', None),
        (1, "y", 1, 1, "add", '{"a": "1", "c": null}', ["x"]),
        (1, "y", 3, 0, "add", "{}", ["x", "z"]),
        (1, None, 4, 0, "add", "{}", None),
        (2, "x", 0, 0, "find", '{"tags": [3, {"z": 1, "a": "q\\"é"}], "where": {"k": 1, "b": [true]}, "deep": false}', ["missing", "x9", None]),
        (2, "v", 1, 0, "find", '[{"tags": []}]', []),
        (2, "w", 1, 1, "none", '{"a":1}', []),
        (2, "u", 1, 2, None, None, []),
        (None, "x", 0, 0, "add", "not json {", None),
    ]
    results = [(1, "x", 2, "3.5"), (1, "x", 5, "later"), (1, "lost", 6, "?"), (2, "x", 1, None), (3, "x", 1, "other"), (None, "x", 1, "null conversation"), (1, None, 9, "nameless")]
    got = {(r.conv_id, r.call_id): r for r in link(spark, calls, results)}
    assert len(got) == 10
    r = got[1, "x"]
    assert (r.status, r.result_turn, r.valid, r.errors, r.canonical) == ("linked", 2, True, "", '{"arguments":{"a":1,"b":2.5},"call_id":"x","name":"add","result":"3.5"}')
    r = got[1, "y"]
    assert (r.status, r.turn, r.n_same, r.valid, r.errors) == ("unanswered", 1, 2, False, "missing b, unknown c, wrong type of a")
    assert got[1, None].status == "unidentified" and got[1, "lost"].status == got[3, "x"].status == "orphan"
    r = got[2, "x"]
    assert (r.status, r.valid, r.n_unknown) == ("linked", True, 2)
    assert json.loads(r.canonical)["arguments"] == {"deep": False, "tags": [3, {"a": 'q"é', "z": 1}], "where": {"b": [True], "k": 1}}
    assert '{"deep":false,"tags":[3,{"a"' in r.canonical
    assert [got[2, c].errors for c in "vwu"] == ["no object", "unknown tool", "no object"]
    assert (got[None, "x"].status, got[None, "x"].errors) == ("linked", "no object")
    assert link(spark, [], []) == []


def test_order(spark):
    rng = random.Random(3)
    calls, cyclic = [], set()
    for conv in range(12):
        n = 8
        order = list(range(n))
        if conv >= 4:
            rng.shuffle(order)
        after = {i: [f"c{j}" for j in rng.sample(range(i), min(i, rng.randrange(3)))] for i in range(n)}
        if conv >= 9:
            after[2], after[3], after[7] = ["c3"], ["c2"], ["c2"]
            cyclic |= {(conv, f"c{i}") for i in range(n)}
        calls += [(conv, f"c{i}", order[i] if conv >= 4 else i, 0, "add", "{}", after[i]) for i in range(n)]
    got = {(r.conv_id, r.call_id): (r.order_major, r.order_minor) for r in link(spark, calls, [])}
    for conv, name, *_, after in calls:
        for other in after:
            mine, theirs = got[conv, name], got[conv, other]
            if mine[0] is not None:
                assert theirs[0] is not None and theirs < mine
    placed = {k for k, v in got.items() if v[0] is not None}
    assert {k for k in got if k[0] < 9} <= placed
    assert all((conv, c) not in placed for conv in (9, 10, 11) for c in ("c2", "c3", "c7"))


def test_levels_take_few_rounds(spark, monkeypatch):
    """A row of 200 calls that point forward, a ladder, and calls behind a circle."""
    rounds = []
    write = T.Scratch.write
    monkeypatch.setattr(T.Scratch, "write", lambda self, df, name: rounds.append(name) or write(self, df, name))
    n = 200
    calls = [(1, f"c{i}", i, 0, "add", "{}", [f"c{i + 1}"]) for i in range(n)]
    calls += [(2, f"c{i}", i, 0, "add", "{}", [f"c{i + 1}", f"c{i + 2}"]) for i in range(6)]
    calls += [(3, f"c{i}", i, 0, "add", "{}", [f"c{(i + 1) % 3}"] if i < 3 else [f"c{i - 1}", "c9"]) for i in range(8)] + [(3, "c9", 9, 0, "add", "{}", ["c9"]), (3, "c10", 10, 0, "add", "{}", ["c11"]), (3, "c11", 11, 0, "add", "{}", [])]
    got = {(r.conv_id, r.call_id): r.order_major for r in link(spark, calls, [])}
    assert {i: got[1, f"c{i}"] for i in range(n)} == {i: n - 1 - i for i in range(n)}
    assert {i: got[2, f"c{i}"] for i in range(6)} == {i: 5 - i for i in range(6)}
    assert {c for (conv, c), m in got.items() if conv == 3 and m is not None} == {"c10", "c11"}
    assert len([x for x in rounds if x.startswith("levels-")]) < 15


def test_turns(spark):
    turns = [(3, 0, "system", "be kind"), (3, 1, "user", "hi"), (3, 2, "assistant", "hello"), (3, 3, "user", "bye"), (4, 0, "assistant", None), (None, 1, None, "x")]
    turns += [(7, 1, "user", "a"), (7, 3, "user", "b"), (7, 5, "user", "c"), (8, 1, "user", "d"), (8, 3, "user", "e")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in T.link_tool_calls(*T.turns_as_calls(frame), T.turn_schemas(spark)).collect()}
    assert {k: r.status for k, r in got.items() if r.conv_id in (3, 4)} == {"3:0": "unanswered", "3:1": "linked", "3:3": "unanswered", "4:-1": "orphan"}
    assert got["3:1"].canonical == '{"arguments":{"text":"hi","turn":1},"call_id":"3:1","name":"reply","result":"hello"}'
    # conversation 7 refers forward, conversation 8 in a circle
    assert {k: (r.order_major, r.order_minor, r.n_unknown) for k, r in got.items() if r.conv_id == 7} == {"7:1": (2, 1, 0), "7:3": (1, 3, 0), "7:5": (0, 5, 1)}
    assert {r.order_major for r in got.values() if r.conv_id == 8} == {None}
    # by the sum of conversation and turn: 3 gives the turn as a string, 9 has no text, 16 a field that no schema knows
    assert (got["3:0"].valid, got["3:0"].errors) == (False, "wrong type of turn")
    assert (got["8:1"].valid, got["8:1"].errors) == (False, "missing text")
    assert got["7:3"].valid


def by_value(x):
    """A number of json.loads with Decimal, in the same spelling rules."""
    sign, digits, power = x.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    stripped = text.rstrip("0")
    power += len(text) - len(stripped)
    if not stripped:
        return "0"
    if 0 <= power <= 40:
        out = stripped + "0" * power
    elif -40 <= power < 0:
        padded = stripped.rjust(1 - power, "0")
        out = f"{padded[:power]}.{padded[power:]}"
    else:
        out = f"{stripped}e{power}"
    return "-" * sign + out


def written(x):
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(written, x)) + "]"
    return by_value(x) if isinstance(x, decimal.Decimal) else json.dumps(x, ensure_ascii=False)


NUMBERS = ["1", "1.0", "1e0", "10e-1", "0.1e1", "-0", "-0.0", "0e5", "12345678901234567890123", "1.5", "15e-1", "1e40", "1e41", "1E+2", "123456789012345678901234567890123456789012345.5", "1e-40", "1e-41", "-2.50", "100", "0.001", "9" * 60, "1e400", "-1e-400"]


def test_numbers_by_value(spark):
    texts = [f'{{"a":{n},"b":{{"z":[{n},"{n}"],"y":-1.0}}}}' for n in NUMBERS]
    texts += [r'{"a":1,"b":"\\\"1.0\\"}', r'{"a":1,"k\u0001":"\u0001n5","b":"\\u0001s \u0001s","c":"\\\u0001"}', r'{"a\"1.0":1.0,"b":[],"c":{},"d":"-1.0"}']
    got = link(spark, [(i, "x", 0, 0, "add", t, None) for i, t in enumerate(texts)], [])
    for r in got:
        want = written(json.loads(texts[r.conv_id], parse_float=decimal.Decimal, parse_int=decimal.Decimal))
        assert r.canonical == '{"arguments":' + want.replace("\x01", "\\u0001") + ',"call_id":"x","name":"add","result":null}'
    first = {r.canonical.split(',"b"')[0] for r in got if r.conv_id < 5}
    assert len(first) == 1


def test_integers_by_value_and_texts_that_are_no_json(spark):
    cases = {"1": "", "1.0": "", "1e0": "", "12345678901234567890123": "", "1e400": "", "1.5": "wrong type of a", "1e-400": "wrong type of a", '"1"': "wrong type of a", '"\\u0001n1"': "wrong type of a", "true": "wrong type of a", "null": "wrong type of a"}
    bad = ["01", "1.", ".5", "--1", "1 2", "+1", "1e", "1x", "NaN", "'1'", "\x02", "-"]
    calls = [(i, "x", 0, 0, "add", f'{{"a":{v},"b":1.5}}', None) for i, v in enumerate([*cases, *bad])] + [(99, "x", 0, 0, "add", '{1:2}', None)]
    got = {r.conv_id: r.errors for r in link(spark, calls, [])}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert {got[i] for i in got if i >= len(cases)} == {"no object"}


def test_sql_says_the_same(spark):
    turns = [(c, t, ("system" if t == 0 else "user" if t % 2 else "assistant"), f"text {c} \"{t}\"" if (c + t) % 4 else None) for c in range(60) for t in range(7)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as call_id", "1 as level", "'y' as _c")
    got = sorted(map(str, (r.asDict() for r in T.link_tool_calls(*T.turns_as_calls(frame), T.turn_schemas(spark)).collect())))
    with duckdb.connect() as db:
        db.register("conversations", frame.toArrow())
        out = db.sql(T.TURNS_SQL)
        assert sorted(str(dict(zip(out.columns, r))) for r in out.fetchall()) == got
    assert any("12345678901234567890123" in x for x in got) and any('"b":1.5' in x for x in got)
