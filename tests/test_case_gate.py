"""The gate of built cases names every fault, and passes only a case that states everything."""

import pytest

from alertweft.fixed import CONDITION_POLICY
from alertweft.operators import case_gate as G

SCHEMA = ("case_id long, truth_case_id long, selection_case_id long, provenance_case_id long, documents_complete boolean, timing string, trigger_passed boolean, "
          "selected_key string, expected_key string, rule_case string, family string, pattern string, audit_family string, audit_pattern string, runbook string, "
          "source_sha256 string, actual_sha256 string, package_text string, event_count long, condition string, verdict string, severity_band array<string>, action_band array<string>")
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
CONDITION = sorted(CONDITION_POLICY)[0]
VERDICT, SEVERITY, ACTIONS = CONDITION_POLICY[CONDITION][:3]
SOUND = dict(zip(NAMES, [1, 1, 1, 1, True, G.TIMING, True, "r", "r", "C", "F", "P", "F", "P", G.RULE_FILE, "h", "h", "plain text", 2, CONDITION, VERDICT,
                         list(SEVERITY), list(ACTIONS)]))
IDS = [(1, "event", "A0", "SRC-A0"), (1, "event", "EV-001", "SRC-EV-001"), (1, "derivation", "DER-001", None), (1, "cited", "A0", None),
       (1, "cited", "DER-001", None), (1, "traced", "A0", None), (1, "traced", "EV-001", None)]


def faults(spark, ids=IDS, **changes):
    cases = spark.createDataFrame([tuple({**SOUND, **changes}[n] for n in NAMES)], SCHEMA)
    rows = G.case_faults(cases, spark.createDataFrame(ids, "case_id long, kind string, id string, record_id string"), [("F", "P", "C")]).collect()
    assert len(rows) == 1
    return rows[0].faults


def test_sound_case(spark):
    assert faults(spark) == []


@pytest.mark.parametrize("changes, want", [
    ({"documents_complete": None, "timing": None}, ["incomplete"]),
    ({"rule_case": None}, ["taxonomy"]),
    ({"timing": None, "trigger_passed": None}, ["timing", "trigger not passed"]),
    ({"selected_key": None, "expected_key": None}, ["selected event"]),
    ({"runbook": None, "source_sha256": None}, ["runbook", "no source"]),
    ({"actual_sha256": None}, ["source absent"]),
    ({"actual_sha256": "x"}, ["source hash"]),
    ({"package_text": "seen T1059.001 by WAZUH"}, ["leaked ATT&CK ID", "leaked source/detector identity"]),
    ({"package_text": None, "truth_case_id": None}, ["case ids"]),
    ({"event_count": 3, "condition": None}, ["event count", "decision band"]),
])
def test_columns(spark, changes, want):
    assert faults(spark, **changes) == want


@pytest.mark.parametrize("ids, want", [
    ([], ["event count"]),
    (IDS + [(1, "derivation", "A0", None)], ["repeated id"]),
    (IDS + [(1, "cited", "EV-009", None)], ["unknown id"]),
    (IDS + [(1, "traced", "EV-009", None)], ["provenance ids"]),
    (IDS[:-1], ["provenance ids"]),
    ([(1, "event", "A0", None), *IDS[1:]], ["record id"]),
    (IDS + [(2, "event", "A0", "x")], []),
])
def test_ids(spark, ids, want):
    assert faults(spark, ids) == want
