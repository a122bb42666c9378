"""Predicates, lint, library inventory."""

import json

import pytest
from pyspark.sql import functions as F

from alertweft.operators import rules as R
from alertweft.plans.rule_library import FAMILIES, PATTERN_CASES, rules, rules_from_json


def leaf(field, op, value):
    return {"field": field, "op": op, "value": value}


@pytest.fixture(scope="module")
def event(spark):
    return spark.sql("""select 8 as event_code, map('name', 'A\\\\Bc.EXE', 'n', '8', 'pct', '100%_x') as attributes,
        map('d', 'x') as derived, try_parse_json('{"data": {"http": {"url": "/InRelease"}}}') as record, 'Host-1' as computer""")


@pytest.mark.parametrize("node, expected", [
    (leaf("event_code", "eq", 8), True), (leaf("event_code", "eq", "8"), False),
    (leaf("attributes.n", "eq", "8"), True), (leaf("attributes.n", "eq", 8), False),
    (leaf("attributes.name", "iendswith", "\\bC.exe"), True), (leaf("attributes.name", "endswith", ".exe"), False),
    (leaf("attributes.name", "istartswith", "a\\"), True), (leaf("attributes.name", "startswith", "a"), False),
    (leaf("attributes.pct", "contains", "%_"), True), (leaf("attributes.pct", "contains", "0_x"), False),
    (leaf("attributes.name", "icontains", "\\BC"), True), (leaf("attributes.name", "ieq", "a\\bc.exe"), True),
    (leaf("attributes.name", "regex", r"(?i)\\b\w+\.exe$"), True), (leaf("attributes.name", "regex", r"\.exe"), False),
    (leaf("attributes.none", "eq", "x"), False), ({"not": leaf("attributes.none", "eq", "x")}, True),
    (leaf("attributes.none", "in", ["x", None]), True), (leaf("attributes.none", "in", ["x"]), False),
    (leaf("attributes.n", "in", [8, "8"]), True), (leaf("attributes.n", "in", [8]), False), (leaf("attributes.n", "in", "8"), False),
    (leaf("attributes.record.data.http.url", "iendswith", "/inrelease"), True), (leaf("attributes.record.data.x.url", "eq", "y"), False),
    (leaf("derived.d", "eq", "x"), True), (leaf("computer", "ieq", "HOST-1"), True),
    ({"all": []}, True), ({"any": []}, False),
    ({"any": [leaf("event_code", "eq", 1), {"all": [leaf("event_code", "eq", 8), {"not": leaf("attributes.n", "eq", "9")}]}]}, True),
])
def test_predicate(event, node, expected):
    assert event.select(R.predicate(node).alias("p")).first().p is expected


def test_unknown_operator():
    with pytest.raises(R.RuleError):
        R.predicate_sql(leaf("a", "like", "x"))


@pytest.mark.parametrize("field", ["record_key", "attributes.Line_Number", "severity", "attributes.record.timestamp", "raw_sha256", "event_time_utc"])
def test_lint(field):
    ok = leaf("attributes.image", "eq", "x")
    assert R.lint({"event_predicate": leaf(field, "eq", "x")})
    assert R.lint({"event_predicate": ok, "scope": {"filter_predicate": leaf(field, "eq", "x")}})
    assert R.lint({"event_predicate": ok, "aggregation": {"group_by": [field]}})
    assert R.lint({"event_predicate": ok, "aggregation": {"group_by": [], "distinct": {"field": field}}})
    assert not R.lint({"event_predicate": ok})


def test_library_inventory():
    shipped = rules()
    assert len(shipped) == 57 and len(FAMILIES) == 9 and len(PATTERN_CASES) == 21
    assert all(not R.lint(rule) for rule in shipped)
    assert {r["analytic_family_id"] for r in shipped} == set(FAMILIES)
    assert rules_from_json(json.dumps(shipped))[0] == shipped[0]


def test_match_keeps_every_event_column(spark, event):
    hits = R.match_rules(event.withColumn("id", F.lit(1)), [{"case_id": "A", "event_predicate": leaf("event_code", "eq", 8)},
                                                          {"case_id": "B", "event_predicate": leaf("event_code", "eq", 9)}])
    assert [r.rule_case for r in hits.collect()] == ["A"] and "record" in hits.columns
