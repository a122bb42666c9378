"""Scoring, gate, inference and lineage on small fixtures and known values."""

import pytest
from pyspark.sql import functions as F

from alertweft.fixed import RUNTIME_POLICY
from alertweft.functions.stats import f1_from_rounded, mcnemar_exact, safe_ratio, wilson
from alertweft.operators import gate as G, lineage as N, scoring as S
from alertweft.operators.inference import bootstrap_mean_ci
from alertweft.operators.integrity import set_digest


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_published_statistics(spark):
    n = lambda x: F.lit(x).cast("bigint")
    assert (value(spark, wilson(n(12), n(20), False)), value(spark, wilson(n(12), n(20), True))) == (0.3866, 0.7812)
    assert (value(spark, wilson(n(11), n(20), False)), value(spark, wilson(n(11), n(20), True))) == (0.3421, 0.7418)
    assert value(spark, wilson(n(0), n(0), True)) == 0.0
    assert value(spark, mcnemar_exact(n(4), n(3))) == 1.0 and value(spark, mcnemar_exact(n(0), n(0))) == 1.0
    assert value(spark, mcnemar_exact(n(0), n(5))) == 0.0625
    assert value(spark, mcnemar_exact(n(3000), n(3000))) == 1.0 and value(spark, mcnemar_exact(n(2000), n(4000))) == 0.0
    # held-out consequence gate: 4/6/4/6; safety profile of the development split uses rounded inputs
    p, r = safe_ratio(n(7), n(14)), safe_ratio(n(7), n(12))
    assert value(spark, p) == 0.5 and value(spark, r) == 0.5833 and value(spark, f1_from_rounded(p, r)) == 0.5384


def test_bootstrap_matches_published_interval(spark):
    values = spark.createDataFrame([(1,)] * 4 + [(-1,)] * 3 + [(0,)] * 13, "d int")
    ci = bootstrap_mean_ci(values.withColumn("k", F.lit("all")), ["k"], "d").first()
    assert ci.n == 20 and abs(ci.lower + 0.2) <= 0.051 and abs(ci.upper - 0.3) <= 0.051
    again = bootstrap_mean_ci(values.withColumn("k", F.lit("all")), ["k"], "d").first()
    assert (again.lower, again.upper) == (ci.lower, ci.upper)


OUTPUT = "case_id long, verdict string, severity string, confidence double, key_evidence array<string>, rationale string, action string"


@pytest.fixture(scope="module")
def package(spark):
    evidence = spark.createDataFrame(
        [(1, "A0", True), (1, "EV-001", False), (2, "A0", True), (2, "A0", False), (3, "EV-001", True), (4, "A0", False), (4, "EV-003", True), (5, "A0", True)],
        "case_id long, evidence_id string, is_alert boolean")
    derivations = spark.createDataFrame([(2, "DER-001", "A0"), (3, "DER-001", "A0"), (5, "a0", "A0")], "case_id long, derivation_id string, source_evidence_id string")
    return evidence, derivations


def decide(spark, package, rows):
    out = spark.createDataFrame(rows, OUTPUT)
    declared = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 2), (5, 1)], "case_id long, declared_count long")
    return {r.case_id: r for r in G.decide(G.gate_inputs(out, *package, declared)).collect()}


def test_gate_findings(spark, package):
    ok = (1, "suspicious", "medium", 0.5, ["A0"], "A0 is seen.", "investigate")
    got = decide(spark, package, [ok])[1]
    assert got.findings == [] and {r.profile: r.status for r in got.routes} == dict.fromkeys(RUNTIME_POLICY["routing_profiles"], "pass")
    got = decide(spark, package, [(1, "suspicious", "medium", 0.5, ["a0", "A0"], "decoded payload, ev-001", "investigate"),
                                  (2, "benign", "critical", 0.5, ["A0"], "nothing; decodes to x", "isolate"),
                                  (3, "malicious", "high", 0.5, ["EV-001", "EV-009"], "see EV-007", "isolate")])
    short = {k: [c[:4] for c in r.findings] for k, r in got.items()}
    assert short == {1: ["R007", "R011", "R012"], 2: ["R004", "R005", "R010", "R013"], 3: ["R003", "R006", "R008", "R009", "R011"]}
    ok = lambda case: (case, "suspicious", "medium", 0.5, ["A0"], "A0 is seen.", "investigate")
    flagged = {k: [c[:4] for c in r.findings] for k, r in decide(spark, package, [ok(4), ok(5)]).items()}
    # another item is flagged although A0 is there; a derivation takes the id of an event
    assert flagged == {4: ["R003"], 5: ["R004"]}
    bad = decide(spark, package, [(1, "maybe", "medium", 1.5, [], "", "reboot")])[1]
    assert [c[:4] for c in bad.findings] == ["R001"] and bad.signals == [] and bad.routes[0].status == "block"


def test_signals_and_policy(spark, package):
    got = decide(spark, package, [(1, "malicious", "high", 0.9, ["A0"], "A0", "isolate")])[1]
    assert {r.profile: r.status for r in got.routes} == {"integrity_only": "pass", "consequence_gate": "review", "safety_first": "review"}
    assert G.policy_errors(RUNTIME_POLICY) == []
    broken = {**RUNTIME_POLICY, "default_profile": "x", "routing_profiles": {"p": ["S999"]}}
    assert len(G.policy_errors(broken)) == 2
    with pytest.raises(G.PolicyError):
        G.decide(spark.range(1), broken)
    assert G.policy_errors({k: v for k, v in RUNTIME_POLICY.items() if k != "signals"}) == ["missing field signals"]


def test_lower_case_ids_differ_between_checks(spark, package):
    truth = spark.createDataFrame([(1, "weak", "suspicious", ["low", "medium"], ["monitor"], ["A0"], ["EV-001"])],
                                  "case_id long, condition string, expected_verdict string, severity_band array<string>, action_band array<string>, supporting array<string>, counter array<string>")
    out = spark.createDataFrame([(1, "suspicious", "low", 0.5, ["A0", "ev-001"], "see ev-001", "monitor")], OUTPUT)
    row = S.case_checks(out, *package, truth).first()
    # the key list is compared as given, the rationale upper-cased; the gate upper-cases both
    assert row.invalid_key_ids == ["ev-001"] and row.invalid_text_ids == [] and not row.c1 and row.c3
    assert decide(spark, package, [tuple(out.first())])[1].findings == []


def test_unknown_values_are_not_in_band(spark, package):
    truth = spark.createDataFrame([(1, "weak", "suspicious", ["low", "medium"], ["monitor"], ["A0"], ["EV-001"])],
                                  "case_id long, condition string, expected_verdict string, severity_band array<string>, action_band array<string>, supporting array<string>, counter array<string>")
    out = spark.createDataFrame([(1, "unsure", "urgent", 0.5, ["A0"], "A0", "reboot")], OUTPUT)
    row = S.case_checks(out, *package, truth).first()
    assert row.unknown_values == ["verdict", "severity", "action"] and not row.c2 and not row.c4
    assert row.action_direction is None and row.severity_direction is None


def test_deep_lineage(spark):
    edges = spark.createDataFrame([(0, 0)] + [(i, i - 1) for i in range(1, 101)] + [(200, 201), (201, 202), (202, 200), (203, 200)], "guid long, parent_guid long")
    up = N.ancestors(N.closure(edges), spark.createDataFrame([(100,), (203,)], "guid long")).collect()
    assert sorted(r.depth for r in up if r.anchor == 100) == list(range(1, 101))
    assert sorted((r.guid, r.depth) for r in up if r.anchor == 203) == [(200, 1), (201, 2), (202, 3)]
    roots = {r.guid: (r.root, r.depth) for r in N.roots(edges).collect()}
    assert all(roots[i] == (0, i) for i in range(101)) and all(roots[i] == (None, None) for i in range(200, 204))


def test_lineage_with_cycle_and_depth(spark):
    chain = [(i, i - 1) for i in range(1, 15)] + [(0, 0), (50, 51), (51, 50)]
    edges = spark.createDataFrame(chain, "guid long, parent_guid long")
    reach = N.closure(edges)
    anchors = spark.createDataFrame([(9,), (50,)], "guid long")
    up = {(r.anchor, r.guid, r.depth) for r in N.ancestors(reach, anchors).collect()}
    assert up == {(9, 9 - d, d) for d in range(1, 10)} | {(50, 51, 1)}
    down = N.descendants(reach, anchors.filter("guid = 9")).collect()
    assert sorted((r.guid, r.depth) for r in down) == [(9 + d, d) for d in range(1, 6)]
    roots = {r.guid: (r.root, r.depth) for r in N.roots(edges.filter("guid < 50")).collect()}
    assert roots[14] == (0, 14) and roots[0] == (0, 0)


def test_set_digest_ignores_order_and_sees_changes(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    a = set_digest(rows, "k", "h", "s", depth=2).first()
    b = set_digest(rows.orderBy(F.desc("k")).repartition(7), "k", "h", "s", depth=2).first()
    c = set_digest(rows.withColumn("h", F.when(F.col("k") == 77, "x").otherwise(F.col("h"))), "k", "h", "s", depth=2).first()
    assert a == b and a.digest != c.digest and a.n == 3000
