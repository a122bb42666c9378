"""Rule replay from the document to the selected event."""

import datetime as dt

from alertweft.operators.replay import document_problems, replay
from alertweft.plans.rule_library import rules, taxonomy_rows

EVENT = "record_key string, event_time timestamp, event_code int, computer string, attributes map<string,string>, derived map<string,string>"
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run(spark, rows, cases, configured, change=lambda rule: None):
    chosen = [r for r in rules() if r["case_id"] in cases]
    for r in chosen:
        change(r)
    events = spark.createDataFrame([(k, t, c, "h", a, {}) for k, t, c, a in rows], EVENT)
    keys = spark.createDataFrame(list(configured.items()), "case_id string, record_key string")
    return {r.case_id: r for r in replay(events, chosen, taxonomy_rows(), keys).collect()}


def spray(n, gap, users):
    return [(f"e{i}", at(i * gap), 4625, {"sub_status": "0xC0000064", "workstation_name": "w", "target_user_name": f"u{i % users}"}) for i in range(n)]


def test_bursts_qualify_and_nearly_qualify(spark):
    early = ("e99", at(-900), 4625, {"sub_status": "0xC0000064", "workstation_name": "other", "target_user_name": "x"})
    got = run(spark, [early, *spray(10, 6, 10)], {"BF-002"}, {"BF-002": "e0"})["BF-002"]
    assert (got.predicate_matches, got.qualifying_groups, got.selected_key, got.passed) == (11, 1, "e0", True)
    for rows in (spray(9, 6, 9), spray(10, 7, 10), spray(10, 6, 9)):  # too few, too slow, too few users
        got = run(spark, rows, {"BF-002"}, {"BF-002": "e0"})["BF-002"]
        assert got.qualifying_groups == 0 and got.problems == ["nothing selected"]


def test_rdp_burst_and_module_sessions(spark):
    rdp = [(f"r{i}", at(i), 3, {"destination_port": "3389", "initiated": "FALSE", "source_ip": "1", "destination_ip": "2", "source_port": str(i)}) for i in range(12)]
    modules = [(f"m{i}", at(s), 7, {"image": "C:\\Windows\\System32\\spoolsv.exe", "image_loaded": f"C:\\w\\spool\\drivers\\x64\\3\\{n}.dll", "process_id": "5"})
               for i, (s, n) in enumerate([(0, "a"), (10, "b"), (11, "c"), (12, "d"), (30, "e"), (30, "e")])]
    got = run(spark, rdp + modules, {"BF-001", "ER-C03"}, {"BF-001": "r0", "ER-C03": "m1"})
    assert got["BF-001"].passed and got["BF-001"].qualifying_groups == 1
    # the lone module and the pair that loads one file twice do not qualify
    assert got["ER-C03"].qualifying_groups == 1 and got["ER-C03"].selected_key == "m1" and got["ER-C03"].passed


def test_selection_order_and_problems(spark):
    hit = {"image": "C:\\Windows\\System32\\net.exe", "command_line": "net user /add bob"}
    rows = [("k10", at(5), 1, hit), ("k9", at(5), 1, hit), ("k1", None, 1, hit), ("k2", at(9), 1, {**hit, "command_line": "net view"})]
    got = run(spark, rows, {"ACCT-001"}, {"ACCT-001": "k9"})["ACCT-001"]
    assert (got.raw_events, got.scope_events, got.predicate_matches, got.selected_key, got.passed) == (4, 4, 3, "k9", True)

    def latest(rule):
        rule["selection"]["strategy"] = "latest_match"
        rule["expected_a0"] = {"record_key": "k9"}

    got = run(spark, rows, {"ACCT-001"}, {"ACCT-001": "k10"}, latest)["ACCT-001"]
    assert got.selected_key == "k1" and got.problems == ["another event is configured", "the document expects another event"]
    got = run(spark, rows, {"DISC-002"}, {})["DISC-002"]
    assert got.problems == ["no event in scope", "nothing selected", "no event configured"] and not got.passed


def test_documents():
    catalogue = set(taxonomy_rows())
    assert all(document_problems(r, catalogue) == [] for r in rules())
    bad = rules()[0] | {"analytic_pattern_id": "NET-01", "selection": {"strategy": "any"}, "event_predicate": {"field": "attributes.Verdict", "op": "eq", "value": "x"}}
    assert len(document_problems(bad, catalogue)) == 3
    grouped = next(r for r in rules() if r.get("aggregation"))
    assert len(document_problems(grouped | {"selection": {"strategy": "earliest_match"}}, catalogue)) == 1
