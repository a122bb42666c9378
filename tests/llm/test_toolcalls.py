"""Linked tool calls against the SQL twin, and hand-made graphs."""

import json

from alertweft.llm import toolcalls
from alertweft.llm.queries.op06_toolcalls import SQL, op6_toolcalls
from oracle import compare, connect

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, level int, position int"
RESULTS = "conv_id long, turn long, call_id string, content string, name string"
SCHEMAS = {"f": {"x": {"type": "integer", "required": True, "minimum": 1}, "m": {"type": "string", "enum": ["a", "b"]}}, "g": {}}


def test_twin(spark):
    folder = "/root/testdata/sf0.01"
    ok, note = compare(op6_toolcalls(spark, folder), connect(folder), SQL)
    assert ok, note


def test_graph_and_edge_rows(spark):
    ok = '{"x": 2, "m": "a"}'
    calls = [
        (1, 9, "a", "f", ok, None), (1, 1, "b", "f", '{"m":"c","x":0}', ["a"]), (1, 2, "c", "f", '{"x":"1","y":{"b":1,"a":2}}', ["b", "a"]),
        (1, 3, "d", "g", "{}", ["e"]), (1, 4, "e", "g", "{}", ["d"]), (1, 5, "h", "g", "{}", ["d", "a"]), (1, 6, "i", "nope", ok, ["zz"]),
        (1, 7, None, "g", "{}", None), (1, 8, "j", None, None, []), (2, 1, "a", "g", "{}", None), (2, 2, "a", "g", "{}", None), (None, 1, "q", "g", "{}", None),
    ]
    results = [(1, 10, "a", "late", "x"), (1, 9, "a", "early", "x"), (1, 9, "b", None, "x"), (3, 1, "lost", "é\n\"", "x"), (2, 3, "a", "r", "x"), (None, 1, "q", "n", "x"), (1, 1, None, "n", "x")]
    calls = spark.createDataFrame([(*c, 7, 7) for c in calls], CALLS)
    results = spark.createDataFrame(results, RESULTS)
    rows = toolcalls.link(calls, results, SCHEMAS).collect()
    got = {(r.conv_id, r.call_id, r.position): r for r in rows}
    by = {(r.conv_id, r.call_id): r for r in rows}
    assert len(got) == len(rows) == 13
    assert [by[1, k].level for k in "abcdehi"] == [0, 1, 2, None, None, None, 0]
    assert by[1, "a"].position < by[1, "b"].position < by[1, "c"].position < by[1, "d"].position
    assert by[1, "a"].valid and by[1, "a"].n_results == 2 and json.loads(by[1, "a"].record)["result"] == "early"
    assert by[1, "b"].errors == ["enum m", "minimum x"]
    assert by[1, "c"].errors == ["extra y", "no result", "type x"]
    assert by[1, "c"].record == '{"arguments":{"x":"1","y":{"a":2,"b":1}},"call_id":"c","name":"f","result":null}'
    assert "cyclic dependency" in by[1, "d"].errors and "cyclic dependency" in by[1, "h"].errors
    assert by[1, "i"].errors == ["no result", "unknown dependency", "unknown tool"]
    assert "no id" in by[1, None].errors and "unknown tool" in by[1, "j"].errors and "no id" in by[None, "q"].errors
    assert sorted(len(r.errors) for r in rows if r.conv_id == 2) == [0, 1]
    assert by[3, "lost"].errors == ["no call"] and json.loads(by[3, "lost"].record)["result"] == 'é\n"'
    assert toolcalls.link(calls.limit(0), results.limit(0), SCHEMAS).collect() == []


def test_no_python_in_the_plan(spark):
    plan = op6_toolcalls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_long_chain(spark):
    calls = spark.createDataFrame([(1, -i, f"k{i}", "g", "{}", [f"k{i - 1}"] if i else None, 0, 0) for i in range(12)], CALLS)
    results = spark.createDataFrame([(1, 0, f"k{i}", "r", "") for i in range(12)], RESULTS)
    rows = toolcalls.link(calls, results, SCHEMAS).orderBy("position").collect()
    assert [r.call_id for r in rows] == [f"k{i}" for i in range(12)] and [r.position for r in rows] == list(range(1, 13))


def test_levels_of_chains_joints_and_cycles(spark):
    """Random dependencies with long chains, calls with several, and cycles, against a walk in plain Python."""
    import random

    rng, rows, want = random.Random(6), [], {}
    for conv in range(25):
        size = rng.choice([1, 3, 40])
        after = {c: sorted({rng.randrange(c) if rng.random() < 0.3 else c - 1 for _ in range(rng.choice([1, 1, 1, 1, 2, 3]))}) if c and rng.random() < 0.95 else [] for c in range(size)}
        if conv % 3 == 0 and size > 3:  # a cycle of two, behind other calls or not, or a call that waits for itself
            at = size // 2
            after[at] = [*after[at][: conv % 2], at + 1 if conv % 4 else at]
            after[at + 1] = [at]
        level, changed = {}, True
        while changed:
            changed = False
            for c, parents in after.items():
                if c not in level and all(p in level for p in parents):
                    level[c], changed = max([level[p] + 1 for p in parents], default=0), True
        want |= {(conv, str(c)): n for c, n in level.items()}
        rows += [(conv, str(c), [*map(str, p), "gone"]) for c, p in after.items()]
    found = toolcalls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()
    assert len(found) == len(want) < len(rows) and {(r.conv_id, r.call_id): r.level for r in found} == want


def test_a_chain_of_five_hundred_calls(spark):
    import time

    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(500)]
    start = time.time()
    found = toolcalls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()
    assert sorted(r.level for r in found) == list(range(500)) and time.time() - start < 60
