"""FLT: rule predicates, searches and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweft.operators import rules as R, selection as S
from alertweft.plans.registry import query
from alertweft.plans.rule_library import rules as shipped_rules
from alertweft.plans.telemetry import SCENARIOS, expected_hits_sql, telemetry


def leaf(field, op, value):
    return {"field": field, "op": op, "value": value}


@query("flt_01", "ev", "SELECT event_id FROM ev WHERE event_type IN ('error', 'signup')")
def flt_01(lake):
    return lake.events().filter(R.predicate(leaf("attributes.event_type", "in", ["error", "signup", 7]))).select("event_id")


@query("flt_02", "ev", """
    SELECT event_id, event_code = 4625 AS code_number, false AS code_text, false AS k_number, k = 8 AS k_text FROM ev""")
def flt_02(lake):
    tests = {"code_number": ("event_code", 4625), "code_text": ("event_code", "4625"),
             "k_number": ("attributes.k", 8), "k_text": ("attributes.k", "8")}
    return lake.events().select("event_id", *[R.predicate(leaf(f, "eq", v)).alias(n) for n, (f, v) in tests.items()])


@query("flt_03", "ev", "SELECT event_id FROM ev WHERE lower(event_type) = 'error'")
def flt_03(lake):
    return lake.events().filter(R.predicate(leaf("attributes.event_type", "ieq", "ERROR"))).select("event_id")


def _text_filter(name, op, value, sql):
    @query(name, sql=f"SELECT doc_id FROM documents WHERE {sql}")
    def run(lake):
        return lake.table("documents").filter(R.predicate(leaf("text", op, value))).select("doc_id")


_text_filter("flt_04", "contains", "%%% ", "contains(text, '%%% ')")
_text_filter("flt_05", "icontains", "TH THE", "contains(lower(text), 'th the')")
_text_filter("flt_06", "startswith", "Th", "starts_with(text, 'Th')")
_text_filter("flt_07", "istartswith", "ÉA", "starts_with(lower(text), 'éa')")
_text_filter("flt_08", "endswith", "on.", "ends_with(text, 'on.')")
_text_filter("flt_09", "iendswith", "ION.", "ends_with(lower(text), 'ion.')")
_text_filter("flt_10", "regex", r"(?i)\btoken\s*=\s*.[0-9a-f]{8,}", r"regexp_matches(text, '(?i)\btoken\s*=\s*.[0-9a-f]{8,}')")

NESTED = {"all": [
    {"any": [leaf("event_code", "eq", 4625), leaf("event_code", "eq", 5145)]},
    {"not": {"all": [leaf("computer", "iendswith", "03"), leaf("attributes.k", "startswith", "1")]}},
    {"any": [leaf("attributes.user", "regex", r"user-\d$"), {"not": leaf("attributes.k", "contains", "5")}]},
]}


@query("flt_11", "ev", r"""
    SELECT event_id FROM ev WHERE event_code IN (4625, 5145)
      AND NOT (ends_with(computer, '03') AND starts_with(CAST(k AS VARCHAR), '1'))
      AND (regexp_matches(user_name, 'user-\d$') OR NOT contains(CAST(k AS VARCHAR), '5'))""")
def flt_11(lake):
    return lake.events().filter(R.predicate(NESTED)).select("event_id")


@query("flt_12", "ev", """
    SELECT event_id, json_extract_string(props, '$.k') AS record_k, json_extract_string(props, '$.k.deep') AS too_deep,
           event_type AS attribute, CAST(NULL AS VARCHAR) AS absent FROM ev""")
def flt_12(lake):
    ev = lake.events().withColumn("record", F.try_parse_json("props"))
    paths = {"record_k": "attributes.record.k", "too_deep": "attributes.record.k.deep",
             "attribute": "attributes.event_type", "absent": "attributes.nothing"}
    return ev.select("event_id", *[R.field_column(p).alias(n) for n, p in paths.items()])


SCOPED = [
    {"case_id": f"S{i}", "scope": {"filter_predicate": leaf("computer", "ieq", host)},
     "event_predicate": leaf("event_code", "eq", 4625)}
    for i, host in enumerate(["HOST-01", "host-07", "host-99"])
]


@query("flt_13", "ev", """
    SELECT s.case_id, CAST(count(*) FILTER (WHERE computer = s.host) AS BIGINT) AS scope_events,
           CAST(count(*) FILTER (WHERE computer = s.host AND event_code = 4625) AS BIGINT) AS predicate_matches,
           count(*) FILTER (WHERE computer = s.host) = 0 AS scope_empty
    FROM ev, (VALUES ('S0', 'host-01'), ('S1', 'host-07'), ('S2', 'host-99')) s(case_id, host) GROUP BY s.case_id""")
def flt_13(lake):
    return R.funnel(lake.events(), SCOPED).select(
        "case_id", "scope_events", "predicate_matches", (F.col("scope_events") == 0).alias("scope_empty"))


@query("flt_14", "ev", "SELECT event_id, true AS not_missing, event_type <> 'error' AS not_error FROM ev")
def flt_14(lake):
    return lake.events().select(
        "event_id",
        R.predicate({"not": leaf("attributes.nothing", "eq", "x")}).alias("not_missing"),
        R.predicate({"not": leaf("attributes.event_type", "eq", "error")}).alias("not_error"))


@query("flt_15", "ev", "SELECT event_id FROM ev WHERE starts_with(computer, 'host-00')")
def flt_15(lake):
    return lake.events().filter(S.host_scope("host-00")).select("event_id")


@query("flt_16", "ev", """SELECT event_id FROM ev
    WHERE (sensor = 'sysmon' AND starts_with(computer, 'host-02')) OR (sensor = 'security' AND starts_with(computer, 'host-0'))
       OR sensor = 'powershell'""")
def flt_16(lake):
    scope = [("sysmon", "host-02"), ("security", "host-0"), ("powershell", None)]
    return lake.events().filter(S.sensor_scope(scope)).select("event_id")


@query("flt_17", "ev", """SELECT event_id FROM ev WHERE event_type IN ('error', 'view') AND computer ILIKE 'host-0%'
    AND (CAST(k AS VARCHAR) ILIKE '1%' OR user_name ILIKE '%-2_' AND true AND user_name NOT ILIKE 'x%')""")
def flt_17(lake):
    either = S.wildcard(F.col("k").cast("string"), "1*") | (
        S.wildcard(F.col("user"), "USER-2*") & (F.length("user") == 7))
    return lake.events().filter(
        F.col("event_type").isin("error", "view") & S.wildcard(F.col("computer"), "HOST-0*") & either).select("event_id")


@query("flt_18", "ev", "SELECT event_id FROM ev WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'")
def flt_18(lake):
    return lake.table("events").filter(F.col("ts") >= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("event_id")


@query("flt_19", sql="SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'ing') AND contains(text, '. ')")
def flt_19(lake):
    return lake.table("documents").filter(S.all_fragments(F.col("text"), ["the", "ing", ". "])).select("doc_id")


@query("flt_20", "ev", """
    WITH n AS (SELECT count(*) FILTER (WHERE event_id = 5) AS one, count(*) FILTER (WHERE event_type = 'error') AS many,
                      count(*) FILTER (WHERE user_name = 'nobody') AS none FROM ev)
    SELECT 'many' AS selector, CAST(many AS BIGINT) AS matches FROM n WHERE many <> 1
    UNION ALL SELECT 'none', CAST(none AS BIGINT) FROM n WHERE none <> 1
    UNION ALL SELECT 'one', CAST(one AS BIGINT) FROM n WHERE one <> 1""")
def flt_20(lake):
    selectors = {"one": F.col("record_key") == "5", "many": F.col("event_type") == "error", "none": F.col("user") == "nobody"}
    return S.not_exactly_one(lake.events(), selectors)


@query("flt_21", sql="""SELECT source, min(doc_id) AS first_doc FROM documents WHERE contains(text, 'ing') GROUP BY source""")
def flt_21(lake):
    hits = lake.table("documents").filter(F.contains("text", F.lit("ing")))
    return S.first_in_order(hits, ["source"], "doc_id", ["doc_id"]).withColumnRenamed("doc_id", "first_doc")


@query("flt_22", "pkg", """SELECT case_id, record_id, evidence_id FROM pkg
    WHERE (case_id, record_id) IN (SELECT (case_id, record_id) FROM pkg WHERE flag = 'R')""")
def flt_22(lake):
    ev = lake.evidence()
    chosen = ev.filter("flag = 'R'").select("case_id", "record_id").distinct()
    return ev.join(chosen, ["case_id", "record_id"], "left_semi").select("case_id", "record_id", "evidence_id")


@query("flt_23", sql="SELECT o_orderkey AS case_id FROM orders WHERE o_orderstatus <> 'F'")
def flt_23(lake):
    return lake.table("orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("case_id"))


RULE_FIELDS = ["attributes.image", "computer", "Severity.level", "attributes.record_id", "event_code",
               "attributes.x.timestamp", "derived.decoded_command", "attributes.record.Verdict", "channel"]
_FIELDS_SQL = "[" + ", ".join(f"'{f}'" for f in RULE_FIELDS) + "]"


def rule_drafts(lake):
    """Draft rules from the part table: one field reference each."""
    return lake.table("part").select(
        F.col("p_partkey").alias("rule_no"),
        F.get(F.array(*[F.lit(f) for f in RULE_FIELDS]), (F.col("p_partkey") % len(RULE_FIELDS)).cast("int")).alias("field"))


@query("flt_24", sql=f"""
    SELECT p_partkey AS rule_no, {_FIELDS_SQL}[p_partkey % 9 + 1] AS field FROM part
    WHERE p_partkey % 9 IN (2, 3, 5, 7)""")
def flt_24(lake):
    return rule_drafts(lake).filter(R.forbidden_field(F.col("field")))


@query("flt_25", sql=r"""
    SELECT doc_id, concat_ws('|', CASE WHEN contains(text, '###') THEN '###' END, CASE WHEN contains(text, 'token') THEN 'token' END) AS stale,
           concat_ws('|', CASE WHEN NOT contains(text, '. ') THEN '. ' END, CASE WHEN NOT contains(text, 'the') THEN 'the' END) AS absent
    FROM documents WHERE contains(text, '###') OR contains(text, 'token') OR NOT contains(text, '. ') OR NOT contains(text, 'the')""")
def flt_25(lake):
    return S.document_structure(lake.table("documents"), "text", ["###", "token"], [". ", "the"]).select("doc_id", "stale", "absent")


@query("flt_26", "ev", f"""
    SELECT h.rule AS rule_case, CAST(count(*) AS BIGINT) AS matches, min(ev.event_id) AS first_event
    FROM ev JOIN (VALUES {expected_hits_sql()}) h(scenario, rule) ON ev.k % {len(SCENARIOS)} = h.scenario GROUP BY h.rule""")
def flt_26(lake):
    return R.match_rules(telemetry(lake), shipped_rules()).groupBy("rule_case").agg(
        F.count(F.lit(1)).alias("matches"), F.min("event_id").alias("first_event"))
