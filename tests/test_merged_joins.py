"""Joins of tables that grow with the input hold no table in the driver, however small the estimate is."""

from alertweft.operators import cost as M, gate as G, scoring as S

OUTPUT = "case_id long, verdict string, severity string, confidence double, key_evidence array<string>, rationale string, action string"
TRUTH = "case_id long, condition string, expected_verdict string, severity_band array<string>, action_band array<string>, supporting array<string>, counter array<string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def package(spark):
    evidence = spark.createDataFrame([(1, "A0", True), (1, "EV-001", False)], "case_id long, evidence_id string, is_alert boolean")
    derivations = spark.createDataFrame([(1, "DER-001", "A0")], "case_id long, derivation_id string, source_evidence_id string")
    outputs = spark.createDataFrame([(1, "malicious", "high", 0.9, ["A0"], "Alert a0 and ev-001, Ev-009.", "isolate")], OUTPUT)
    return outputs, evidence, derivations


def test_scoring(spark):
    truth = spark.createDataFrame([(1, "strong", "malicious", ["high", "critical"], ["isolate"], ["A0"], [])], TRUTH)
    checked = S.case_checks(*package(spark), truth)
    assert "Broadcast" not in plan(checked)
    row = checked.first()
    assert (row.c1, row.c2, row.c3, row.c4, row.text_ids, row.unknown_ids) == (False, True, True, True, ["A0", "EV-001", "EV-009"], ["EV-009"])


def test_gate(spark):
    declared = spark.createDataFrame([(1, 2)], "case_id long, declared_count long")
    assert "Broadcast" not in plan(G.gate_inputs(*package(spark), declared))


def test_usage(spark):
    usage = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "case_id long, seq int, tokens long")
    found = M.canonical_usage(usage, usage.select("case_id").distinct(), ["case_id"], "seq")
    assert "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 6)]
