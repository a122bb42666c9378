"""CHK-10..22/24/25, AGG-10/11, JN-03: the runtime gate and its comparison with the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweft.fixed import ACTIONS, DECODE_PHRASES, FINDING_CODES, RUNTIME_POLICY, SEVERITIES, VERDICTS
from alertweft.functions.stats import count_where, safe_ratio, wilson
from alertweft.functions.text import joined
from alertweft.operators import gate as G, rounds as P
from alertweft.operators.scoring import duplicates_in
from alertweft.plans.adapters import _sql_list, add_view
from alertweft.plans.queries.scoring import _IDS, _any_sql, checks
from alertweft.plans.registry import query
from alertweft.session import merged


def drafts(lake):
    """Decisions with seeded contract faults and wrong request ids."""
    k = F.col("case_id")
    return lake.outputs().select(
        "case_id", "verdict", "severity", "rationale",
        F.when(k % 103 == 0, 1.2).otherwise(F.col("confidence")).alias("confidence"),
        F.when(k % 107 == 0, "reboot").otherwise(F.col("action")).alias("action"),
        F.when(k % 109 == 0, F.array().cast("array<string>")).when(k % 113 == 0, F.array_append("key_evidence", F.lit("a0")))
        .otherwise(F.col("key_evidence")).alias("key_evidence"),
        F.when(k % 101 == 0, k + 1).otherwise(k).alias("requested_id"),
    )


add_view("od", """
    SELECT case_id, verdict, severity, rationale, CASE WHEN case_id % 103 = 0 THEN 1.2::DOUBLE ELSE confidence END AS confidence,
           CASE WHEN case_id % 107 = 0 THEN 'reboot' ELSE action END AS action,
           CASE WHEN case_id % 109 = 0 THEN CAST([] AS VARCHAR[]) WHEN case_id % 113 = 0 THEN list_append(key_evidence, 'a0')
                ELSE key_evidence END AS key_evidence,
           CASE WHEN case_id % 101 = 0 THEN case_id + 1 ELSE case_id END AS requested_id FROM o""", "o")


def _facts_view(evidence, derivations):
    return f"""
    SELECT case_id, event_count, event_count + CASE WHEN case_id % 43 = 0 THEN 1 ELSE 0 END AS declared, main_id, distinct_ids, dup, coalesce(n_der, 0) AS n_der, has_a0 FROM (
        SELECT case_id, count(*) AS event_count, min(evidence_id) FILTER (WHERE is_alert) AS main_id, count(DISTINCT evidence_id) AS distinct_ids,
               bool_or(evidence_id = 'A0') AS has_a0 FROM {evidence} GROUP BY 1)
    LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE c > 1) AS dup FROM (SELECT case_id, id, count(*) AS c FROM (
        SELECT case_id, evidence_id AS id FROM {evidence} UNION ALL SELECT case_id, derivation_id FROM {derivations}) GROUP BY 1, 2) GROUP BY 1) USING (case_id)
    LEFT JOIN (SELECT case_id, count(*) AS n_der FROM {derivations} GROUP BY 1) USING (case_id)"""


# a few packages flag another line than the first, and a few derivations take the id of an event
add_view("pkgd", "SELECT * REPLACE (CASE WHEN case_id % 41 = 0 THEN line_no = 2 ELSE is_alert END AS is_alert) FROM pkg", "pkg")
add_view("derd", "SELECT * REPLACE (CASE WHEN case_id % 7 = 0 THEN 'EV-001' ELSE derivation_id END AS derivation_id) FROM der", "der")
add_view("facts", _facts_view("pkg", "der"), "pkg der")
add_view("factsd", _facts_view("pkgd", "derd"), "pkgd derd")
add_view("validd", """SELECT case_id, list(DISTINCT evidence_id) AS ids FROM
    (SELECT case_id, evidence_id FROM pkgd UNION ALL SELECT case_id, derivation_id FROM derd) GROUP BY case_id""", "pkgd derd")
_ERR = f"""concat_ws('|', CASE WHEN NOT list_contains({_sql_list(VERDICTS)}, verdict) THEN 'verdict' END,
    CASE WHEN NOT list_contains({_sql_list(SEVERITIES)}, severity) THEN 'severity' END,
    CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN len(key_evidence) < 1 THEN 'key_evidence' END,
    CASE WHEN length(rationale) < 1 THEN 'rationale' END, CASE WHEN NOT list_contains({_sql_list(ACTIONS)}, action) THEN 'action' END)"""


def _gate_view(source, keys, seeded=""):
    profile = RUNTIME_POLICY["decision_profiles"]
    ok = " OR ".join(
        f"(verdict = '{v}' AND list_contains({_sql_list(s)}, severity) AND list_contains({_sql_list(a)}, action))"
        for v, (s, a) in profile.items())
    key_bad = "len(list_filter(keys_up, lambda x: NOT list_contains(ids, x))) > 0"
    text_bad = "len(list_filter(text_ids, lambda x: NOT list_contains(ids, x))) > 0"
    arms = {
        "R002": "case_id <> requested_id", "R003": "main_id IS DISTINCT FROM 'A0'", "R004": "dup > 0", "R005": "event_count <> declared",
        "R006": "n_der > 0 AND NOT has_a0", "R007": "len(keys_up) <> len(list_distinct(keys_up))", "R008": key_bad, "R009": text_bad,
        "R010": "len(text_ids) = 0", "R011": "len(text_ids) > 0 AND NOT list_has_any(keys_up, text_ids)",
        "R012": f"{_any_sql('lower(rationale)', DECODE_PHRASES)} AND n_der = 0", "R013": f"NOT ({ok})",
    }
    late = ", ".join(f"CASE WHEN {t} THEN '{FINDING_CODES[c]}' END" for c, t in arms.items())
    signal = """concat_ws('|', CASE WHEN action IN ('isolate', 'close_benign') THEN 'S001_HIGH_CONSEQUENCE_ACTION' END,
        CASE WHEN verdict = 'malicious' OR severity IN ('high', 'critical') THEN 'S002_AGGRESSIVE_CLAIM' END,
        CASE WHEN action = 'close_benign' THEN 'S003_BENIGN_CLOSURE' END)"""
    return f"""
    SELECT {keys}, action, errors, findings, signals, hard, review, p.profile,
           CASE WHEN hard <> '' THEN 'block' WHEN review <> '' OR (p.profile = 'consequence_gate' AND contains(signals, 'S001'))
                OR (p.profile = 'safety_first' AND (contains(signals, 'S002') OR contains(signals, 'S003'))) THEN 'review' ELSE 'pass' END AS status,
           CASE WHEN hard <> '' THEN hard ELSE concat_ws('|', nullif(review, ''),
                CASE WHEN p.profile = 'consequence_gate' AND contains(signals, 'S001') THEN 'S001_HIGH_CONSEQUENCE_ACTION' END,
                CASE WHEN p.profile = 'safety_first' AND contains(signals, 'S002') THEN 'S002_AGGRESSIVE_CLAIM' END,
                CASE WHEN p.profile = 'safety_first' AND contains(signals, 'S003') THEN 'S003_BENIGN_CLOSURE' END) END AS reasons
    FROM (SELECT *, array_to_string(list_filter(string_split(findings, '|'), lambda x: x <> '' AND x NOT LIKE 'R010%' AND x NOT LIKE 'R011%'), '|') AS hard,
                 array_to_string(list_filter(string_split(findings, '|'), lambda x: x LIKE 'R010%' OR x LIKE 'R011%'), '|') AS review
          FROM (SELECT *, CASE WHEN errors <> '' THEN '{FINDING_CODES['R001']}' ELSE concat_ws('|', {late}) END AS findings,
                       CASE WHEN errors <> '' THEN '' ELSE {signal} END AS signals
                FROM (SELECT s.*, f.* EXCLUDE (case_id), v.ids, {_IDS} AS text_ids, {_ERR} AS errors,
                             list_transform(key_evidence, lambda x: upper(x)) AS keys_up
                      FROM {source} s JOIN facts{seeded} f USING (case_id) JOIN valid{seeded} v USING (case_id)))),
         (VALUES ('integrity_only'), ('consequence_gate'), ('safety_first')) p(profile)"""


add_view("gd", _gate_view("od", "case_id", "d"), "od factsd validd")
add_view("g", _gate_view("(SELECT *, case_id AS requested_id FROM o)", "case_id"), "o facts valid")
add_view("gr", _gate_view("(SELECT *, case_id AS requested_id FROM run)", "case_id, model, round, split"), "run facts valid")


def draft_package(lake):
    """Evidence and derivations with seeded faults: a wrong alert flag, an id used twice."""
    k = F.col("case_id")
    return (lake.evidence().withColumn("is_alert", F.when(k % 41 == 0, F.col("line_no") == 2).otherwise(F.col("is_alert"))),
            lake.derivations().withColumn("derivation_id", F.when(k % 7 == 0, "EV-001").otherwise(F.col("derivation_id"))))


def decided_drafts(lake):
    return G.decide(G.gate_inputs(drafts(lake), *draft_package(lake), lake.declared()))


def decided(lake):
    return G.decide(G.gate_inputs(lake.outputs(), lake.evidence(), lake.derivations(), lake.declared()))


_ONE = "(SELECT * FROM gd WHERE profile = 'integrity_only')"


def _codes_query(name, codes):
    """One query per finding group: which decisions raise the codes."""
    names = [FINDING_CODES[c] for c in codes]
    flags = ", ".join(f"contains(findings, '{n}') AS {c.lower()}" for c, n in zip(codes, names))

    @query(name, "gd", f"SELECT case_id, {flags} FROM {_ONE}")
    def run(lake):
        return decided_drafts(lake).select("case_id", *[F.array_contains("findings", n).alias(c.lower()) for c, n in zip(codes, names)])


@query("chk_10", "gd", f"SELECT case_id, errors, findings FROM {_ONE} WHERE errors <> ''")
def chk_10(lake):
    return decided_drafts(lake).filter(F.size("contract_errors") > 0).select(
        "case_id", F.array_join("contract_errors", "|").alias("errors"), F.array_join("findings", "|").alias("findings"))


_codes_query("chk_11", ["R002", "R003"])
_codes_query("chk_12", ["R004", "R007"])
_codes_query("chk_13", ["R005"])
_codes_query("chk_14", ["R006"])
_codes_query("chk_15", ["R008", "R009"])
_codes_query("chk_16", ["R010", "R011"])
_codes_query("chk_17", ["R012"])
_codes_query("chk_18", ["R013"])


@query("chk_19", "gd", f"SELECT case_id, signals FROM {_ONE}")
def chk_19(lake):
    return decided_drafts(lake).select("case_id", F.array_join("signals", "|").alias("signals"))


@query("chk_20", "gd", "SELECT case_id, profile, status, reasons FROM gd")
def chk_20(lake):
    return G.routed(decided_drafts(lake)).select("case_id", "profile", "status", F.array_join("reasons", "|").alias("reasons"))


@query("chk_21", "o", f"""
    SELECT action, CAST(count(*) AS BIGINT) AS decisions, list_contains({_sql_list(sorted({a for _, acts in RUNTIME_POLICY['decision_profiles'].values() for a in acts}))}, action) AS covered,
           true AS policy_ok FROM o GROUP BY action""")
def chk_21(lake):
    """Policy validation over the data: every action in use must be reachable in some profile."""
    covered = sorted({a for _, acts in RUNTIME_POLICY["decision_profiles"].values() for a in acts})
    return lake.outputs().groupBy("action").agg(F.count(F.lit(1)).alias("decisions")).select(
        "action", "decisions", F.col("action").isin(covered).alias("covered"), F.lit(not G.policy_errors(RUNTIME_POLICY)).alias("policy_ok"))


@query("chk_22", "chk", """
    SELECT case_id, (NOT c2 OR NOT c4) AND action IN ('isolate', 'close_benign') AS high_consequence_miscalibration,
           NOT c2 OR NOT c4 AS calibration, NOT (c1 AND c2 AND c3 AND c4) AS a4_any, NOT c1 AS "C1", NOT c2 AS "C2", NOT c3 AS "C3", NOT c4 AS "C4" FROM chk""")
def chk_22(lake):
    return checks(lake).select("case_id", *[P.target_column(t).alias(t) for t in P.TARGETS])


@query("chk_24", "od", f"SELECT case_id, {_ERR} AS errors FROM od")
def chk_24(lake):
    return drafts(lake).select("case_id", F.array_join(G.output_contract_errors(), "|").alias("errors"))


@query("chk_24_raw", "o", """SELECT case_id, CASE WHEN case_id % 29 = 0 THEN 'not an object' ELSE concat_ws('|', CASE WHEN case_id % 31 = 0 THEN 'extra notes' END,
    CASE WHEN case_id % 47 = 0 THEN 'missing rationale' END, CASE WHEN case_id % 37 = 0 THEN 'type confidence' END, CASE WHEN case_id % 41 = 0 THEN 'type key_evidence' END) END AS errors FROM o""")
def chk_24_raw(lake):
    """Decisions as written: extra and missing keys and wrong types are seen, which typed columns would hide."""
    k = F.col("case_id")
    quoted = lambda c: F.to_json(F.array(c))
    text = lambda c: F.regexp_replace(quoted(F.col(c)), r"^\[|\]$", "")
    fields = F.concat_ws(
        ",", F.concat(F.lit('"verdict":'), text("verdict")), F.concat(F.lit('"severity":'), text("severity")),
        F.concat(F.lit('"confidence":'), F.when(k % 37 == 0, F.lit('"high"')).otherwise(F.col("confidence").cast("string"))),
        F.concat(F.lit('"key_evidence":'), F.when(k % 41 == 0, F.lit('"A0"')).otherwise(F.to_json("key_evidence"))),
        F.when(k % 47 != 0, F.concat(F.lit('"rationale":'), text("rationale"))), F.concat(F.lit('"recommended_action":'), text("action")),
        F.when(k % 31 == 0, F.lit('"notes":1')))
    raw = F.when(k % 29 == 0, F.lit("[]")).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    return lake.outputs().select("case_id", F.array_join(G.raw_contract_errors(raw), "|").alias("errors"))


@query("chk_25", sql=r"""
    SELECT o_orderkey AS case_id, concat_ws('|', CASE WHEN NOT regexp_full_match(sha, '[0-9a-f]{64}') THEN 'sha256' END,
           CASE WHEN tier NOT IN (1, 2) THEN 'tier' END, CASE WHEN n_sensors < 1 THEN 'sensors' END, CASE WHEN host = '' THEN 'primary_host' END) AS errors
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'abc' ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS sha,
                 o_orderkey % 3 AS tier, o_custkey % 4 AS n_sensors, CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE 'host' END AS host FROM orders)""")
def chk_25(lake):
    from alertweft.operators.audits import provenance_errors
    k = F.col("o_orderkey")
    prov = lake.table("orders").select(
        k.alias("case_id"), F.when(k % 31 == 0, "abc").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"), (k % 3).alias("tier"),
        (F.col("o_custkey") % 4).alias("n_sensors"), F.when(k % 43 == 0, "").otherwise("host").alias("primary_host"))
    return prov.select("case_id", F.array_join(provenance_errors(), "|").alias("errors"))


_ROUTE_AGG = """CAST(count(*) FILTER (WHERE status = 'pass') AS BIGINT) AS pass_n, CAST(count(*) FILTER (WHERE status = 'review') AS BIGINT) AS review_n,
    CAST(count(*) FILTER (WHERE status = 'block') AS BIGINT) AS block_n, CAST(count(*) FILTER (WHERE status <> 'pass') AS BIGINT) AS human_review_n,
    round_even(count(*) FILTER (WHERE status <> 'pass')::DOUBLE / count(*), 4) AS human_review_rate"""


def route_aggregates():
    s = F.col("status")
    return [count_where(s == "pass").alias("pass_n"), count_where(s == "review").alias("review_n"), count_where(s == "block").alias("block_n"),
            count_where(s != "pass").alias("human_review_n"), safe_ratio(F.count_if(s != "pass"), F.count(F.lit(1))).alias("human_review_rate")]


@query("agg_10", "g", f"SELECT profile, {_ROUTE_AGG} FROM g GROUP BY profile")
def agg_10(lake):
    return G.routed(decided(lake)).groupBy("profile").agg(*route_aggregates())


def labelled(lake, targets=P.TARGETS):
    """Every (case, profile, target) with oracle label and runtime prediction; only the targets asked for are unfolded and joined."""
    truth = checks(lake).select("case_id", F.inline_outer(F.array(*[
        F.struct(F.lit(t).alias("target"), P.target_column(t).alias("label")) for t in targets])))
    routes = G.routed(decided(lake)).select("case_id", "profile", F.col("status").isin("review", "block").alias("predicted"))
    return truth.join(merged(routes), "case_id")


add_view("lab", """SELECT c.case_id, g.profile, t.target, g.status <> 'pass' AS predicted,
    CASE t.target WHEN 'high_consequence_miscalibration' THEN (NOT c2 OR NOT c4) AND c.action IN ('isolate', 'close_benign')
         WHEN 'calibration' THEN NOT c2 OR NOT c4 WHEN 'a4_any' THEN NOT (c1 AND c2 AND c3 AND c4)
         WHEN 'C1' THEN NOT c1 WHEN 'C2' THEN NOT c2 WHEN 'C3' THEN NOT c3 ELSE NOT c4 END AS label
    FROM chk c JOIN g USING (case_id), (VALUES ('high_consequence_miscalibration'), ('calibration'), ('a4_any'), ('C1'), ('C2'), ('C3'), ('C4')) t(target)""", "chk g")
add_view("conf", """SELECT profile, target, CAST(count(*) FILTER (WHERE label AND predicted) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT label AND predicted) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE NOT label AND NOT predicted) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE label AND NOT predicted) AS BIGINT) AS fn
    FROM lab GROUP BY profile, target""", "lab")


@query("agg_11", "conf", """
    SELECT *, round_even(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1 FROM (
      SELECT *, round_even(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision, round_even(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall,
             round_even(tn::DOUBLE / nullif(tn + fp, 0), 4) AS specificity, tp + fp AS deferral_n,
             round_even((tp + fp)::DOUBLE / nullif(tp + fp + tn + fn, 0), 4) AS deferral_rate FROM conf)""")
def agg_11(lake):
    """All targets against all profiles; cases are counted by their labels and statuses before these are unfolded."""
    outputs, passed = lake.outputs(), ["c1", "c2", "c3", "c4"]
    both = G.decide(G.gate_inputs(checks(lake).select(*outputs.columns, *passed), lake.evidence(), lake.derivations(), lake.declared(), citing=outputs))
    statuses = F.array_join(F.transform("routes", lambda r: F.concat_ws("=", r["profile"], r["status"])), "|")
    patterns = both.groupBy(*passed, "action", statuses.alias("statuses")).agg(F.count(F.lit(1)).alias("cases"))
    labels = F.inline(F.array(*[F.struct(F.lit(t).alias("target"), P.target_column(t).alias("label")) for t in P.TARGETS]))
    each = patterns.select("cases", "statuses", labels).select("cases", "target", "label", F.explode(F.split("statuses", r"\|")).alias("route"))
    unfolded = each.select("cases", "target", "label", F.split_part("route", F.lit("="), F.lit(1)).alias("profile"),
                           F.split_part("route", F.lit("="), F.lit(2)).isin("review", "block").alias("predicted"))
    return P.confusion(unfolded, ["profile", "target"], "cases")


@query("agg_11_cases", "lab", """SELECT case_id, profile, target,
    CASE WHEN label AND predicted THEN 'tp' WHEN predicted THEN 'fp' WHEN label THEN 'fn' ELSE 'tn' END AS outcome FROM lab WHERE target = 'calibration'""")
def agg_11_cases(lake):
    """The four case lists of the metrics, in long form."""
    return labelled(lake, ["calibration"]).select("case_id", "profile", "target", P.outcome_class().alias("outcome"))


@query("agg_23", "conf", """
    SELECT profile, tp + fn AS positive_n, tp AS recall_n, round_even(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall_rate,
           tp + fp AS review_n, fn AS unrouted_n FROM conf WHERE target = 'calibration'""")
def agg_23(lake):
    return runtime_uncertainty(lake).select("profile", "positive_n", "recall_n", "recall_rate", "review_n", "unrouted_n")


def runtime_uncertainty(lake):
    """Recall and review rate of every profile with Wilson intervals."""
    counts = P.confusion(labelled(lake, ["calibration"]), ["profile"])
    n, positive = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), F.col("tp") + F.col("fn")
    return counts.select(
        "profile", positive.alias("positive_n"), F.col("tp").alias("recall_n"), F.col("recall").alias("recall_rate"),
        F.col("deferral_n").alias("review_n"), F.col("fn").alias("unrouted_n"),
        wilson(F.col("tp"), positive, False).alias("recall_low"), wilson(F.col("tp"), positive, True).alias("recall_high"),
        wilson(F.col("deferral_n"), n, False).alias("review_low"), wilson(F.col("deferral_n"), n, True).alias("review_high"))


def _wilson_sql(s, n, upper):
    z = 1.959963984540054
    core = f"(({s})::DOUBLE/({n}) + {z * z}/(2.0*({n})))"
    margin = f"{z} * sqrt(({s})::DOUBLE/({n}) * (1 - ({s})::DOUBLE/({n})) / ({n}) + {z * z}/(4.0*({n})*({n})))"
    edge = f"least(1.0, ({core} + {margin}) / (1 + {z * z}/({n})))" if upper else f"greatest(0.0, ({core} - {margin}) / (1 + {z * z}/({n})))"
    return f"coalesce(round_even({edge}, 4), 0.0)"


@query("agg_23_intervals", "conf", f"""
    SELECT profile, {_wilson_sql('tp', 'nullif(tp + fn, 0)', False)} AS recall_low, {_wilson_sql('tp', 'nullif(tp + fn, 0)', True)} AS recall_high,
           {_wilson_sql('tp + fp', 'nullif(tp + fp + tn + fn, 0)', False)} AS review_low,
           {_wilson_sql('tp + fp', 'nullif(tp + fp + tn + fn, 0)', True)} AS review_high FROM conf WHERE target = 'calibration'""")
def agg_23_intervals(lake):
    return runtime_uncertainty(lake).select("profile", "recall_low", "recall_high", "review_low", "review_high")


@query("jn_03", "o", """
    SELECT a.case_id IS NULL AS left_only, b.case_id IS NULL AS right_only, coalesce(a.case_id, b.case_id) AS case_id,
           concat_ws('|', CASE WHEN a.verdict IS DISTINCT FROM b.verdict THEN 'verdict' END, CASE WHEN a.severity IS DISTINCT FROM b.severity THEN 'severity' END,
                     CASE WHEN a.action IS DISTINCT FROM b.action THEN 'action' END) AS mismatched
    FROM (SELECT * FROM o WHERE case_id % 53 <> 0) a
    FULL JOIN (SELECT case_id, verdict, severity, CASE WHEN case_id % 59 = 0 THEN 'monitor' ELSE action END AS action FROM o WHERE case_id % 47 <> 0) b ON a.case_id = b.case_id
    WHERE a.case_id IS NULL OR b.case_id IS NULL OR a.action IS DISTINCT FROM b.action""")
def jn_03(lake):
    """Report against report: a different key set or a changed decision makes the comparison unusable."""
    from alertweft.operators.audits import report_mismatches
    a = lake.outputs().filter("case_id % 53 <> 0")
    b = lake.outputs().filter("case_id % 47 <> 0").withColumn("action", F.when(F.col("case_id") % 59 == 0, "monitor").otherwise(F.col("action")))
    return report_mismatches(a, b, "case_id", ["verdict", "severity", "action"])


@query("agg_30", "pkg od", """
    SELECT 'package' AS kind, case_id, string_agg(evidence_id, '|' ORDER BY evidence_id) AS duplicates
    FROM (SELECT case_id, evidence_id FROM pkg GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY case_id
    UNION ALL SELECT 'key_evidence', case_id, 'A0' FROM od WHERE case_id % 113 = 0 AND case_id % 109 <> 0""")
def agg_30(lake):
    twice = lake.evidence().groupBy("case_id", "evidence_id").count().filter("count > 1")
    package = twice.groupBy("case_id").agg(joined(F.collect_list("evidence_id")).alias("duplicates")).select(
        F.lit("package").alias("kind"), "case_id", "duplicates")
    keys = drafts(lake).select(F.lit("key_evidence").alias("kind"), "case_id",
                               joined(duplicates_in(F.transform("key_evidence", F.upper))).alias("duplicates")).filter("duplicates <> ''")
    return package.unionByName(keys)


@query("agg_31", "pkg", """SELECT case_id, CAST(count(*) AS BIGINT) AS actual, CAST(count(*) + 1 AS BIGINT) AS declared
    FROM pkg WHERE case_id % 43 = 0 GROUP BY case_id""")
def agg_31(lake):
    """Packages whose stated number of events is not the number they hold."""
    facts = G.package_facts(lake.evidence(), lake.derivations()).join(lake.declared(), "case_id")
    return facts.filter("event_count <> declared_count").select(
        "case_id", F.col("event_count").cast("bigint").alias("actual"), F.col("declared_count").cast("bigint").alias("declared"))


@query("jn_10", "pkg der", "SELECT case_id, derivation_id, source_evidence_id FROM der WHERE (case_id, 'A0') NOT IN (SELECT (case_id, evidence_id) FROM pkg)")
def jn_10(lake):
    ids = lake.evidence().select("case_id", F.col("evidence_id").alias("source_evidence_id")).distinct()
    return lake.derivations().join(ids, ["case_id", "source_evidence_id"], "left_anti").select("case_id", "derivation_id", "source_evidence_id")
