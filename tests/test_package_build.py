"""Packages from events to the redacted document."""

import base64

import pytest

from alertweft.operators.integrity import difference
from alertweft.operators.package_build import build_packages

BLOB = base64.b64encode("Invoke-AtomicTest T1059 at WS1".encode("utf-16le")).decode()
EVENT = ("record_id string, event_time_utc string, event_type string, provider string, channel string, event_code int, computer string, "
         "attributes map<string,string>")


@pytest.fixture(scope="module")
def build(spark):
    events = spark.createDataFrame([
        ("10", "2024-01-01T00:00:05Z", "process_create", "", None, 1, "WS1.attackrange.local",
         {"user": "ATTACKRANGE\\jdoe", "command_line": f"powershell -enc {BLOB}", "image": "C:\\AtomicRedTeam\\x.exe", "note": "drop me"}),
        ("9", "2024-01-01T00:00:01Z", "logon", "P", "Security", 4624, "DC1.attackrange.local", {"subject_user_name": "svc", "target_user_name": "jdoe", "where": "ws1 and dc1"}),
        ("8", "2024-01-01T00:00:03Z", "dns_query", "P", "C", 22, "WS1.attackrange.local", {"query_name": "t1059.attackrange.local"}),
        ("7", "2024-01-01T00:00:03Z", "dns_query", "P", "C", 22, "WS1.attackrange.local", {"query_name": "other"}),
    ], EVENT)
    selection = [(1, "10", True), (1, "9", False), (1, "8", False), (1, "7", False)]
    specs = [(1, "DER-001", "A0", "command_line", "base64_utf16le", "decoded", "decoded once")]
    exclusions = [(1, "A0", "note")]

    def make(selection=selection, specs=specs, exclusions=exclusions, order=None):
        return build_packages(
            events.orderBy(order) if order else events, spark.createDataFrame(selection, "case_id long, record_id string, is_alert boolean"),
            spark.createDataFrame(specs, "case_id long, derivation_id string, source_evidence_id string, source_field string, method string, derived_field string, note string"),
            spark.createDataFrame(exclusions, "case_id long, evidence_id string, field string"), ["xml"])

    return make


def test_document(build):
    documents, problems = build()
    assert problems.count() == 0
    doc = documents.first()
    assert (doc.schema_version, doc.package_type, doc.case_id) == ("1.0", "neutral_security_event_package", 1)
    seen = doc.observed_context
    assert seen.computers == ["host-01.corp.local", "host-02.corp.local"] and seen.event_count == 4
    assert (seen.time_window_utc.start, seen.time_window_utc.end) == ("2024-01-01T00:00:01Z", "2024-01-01T00:00:05Z")
    assert seen.event_types_present == ["dns_query", "logon", "process_create"] and seen.sourcetypes_present == ["xml"]
    alert = doc.main_alert
    assert alert.is_triggering_alert and alert.computer == "host-02.corp.local" and alert.source_event.event_record_id == "10"
    assert alert.source_event.provider == "Microsoft-Windows-Sysmon" and "note" not in alert.attributes
    assert [i.evidence_id for i in doc.evidence_items] == ["EV-001", "EV-002", "EV-003"]
    assert [i.source_event.event_record_id for i in doc.evidence_items] == ["9", "7", "8"]
    assert doc.evidence_items[0].attributes["where"] == "host-02 and host-01"
    derived = doc.deterministic_derivations[0]
    assert (derived.derived_field, derived.derivation_method, derived.source_field) == ("decoded", "decoded once", "command_line")
    whole = str(doc).lower()
    for token in ("atomic", "t1059", "attackrange", "jdoe", "ws1", "dc1"):
        assert token not in whole, token
    assert BLOB.lower() not in whole and "host-02" in derived.value


def test_rebuild_is_the_same_whatever_the_order(build):
    a, b = build()[0], build(order="record_id")[0]
    text = lambda df: df.selectExpr("case_id", "to_json(struct(*)) AS document")
    assert difference(text(a), text(b)).count() == 0


def test_problems_are_reported(build):
    _, problems = build(selection=[(1, "10", True), (1, "404", False)], specs=[(1, "DER-9", "EV-007", "x", "base64_utf16le", "d", "n")],
                        exclusions=[(1, "A0", "absent"), (1, "EV-009", "x")])
    assert sorted((r.problem, r.detail) for r in problems.collect()) == [
        ("derivation without evidence", "DER-9"), ("exclusion: field_absent", "A0.absent"), ("exclusion: unknown_evidence", "EV-009.x"), ("record without an event", "404")]
