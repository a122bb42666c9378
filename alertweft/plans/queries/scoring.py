"""CHK-01..09, JN-01/02/09/12, AGG-04..09, SCL-01..05, SET-04..07: scoring of saved decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweft.fixed import (
    ACTIONS, CERTAIN_WORDS, CONDITIONS, DECODE_PHRASES, DECODE_PHRASES_V10, HEDGE_WORDS, OUTCOME_WORDS, SEVERITIES, VERDICTS,
)
from alertweft.functions.ordinal import direction, policy_value, signed_distance
from alertweft.functions.stats import count_where, safe_ratio
from alertweft.functions.text import evidence_ids, first_phrase, joined
from alertweft.operators import scoring as S
from alertweft.plans.adapters import _case_of, _sql_list, add_view
from alertweft.plans.registry import query


def checks(lake):
    return S.case_checks(lake.outputs(), lake.evidence(), lake.derivations(), lake.truth())


def scored(lake):
    return S.scored_cases(lake.outputs(), lake.evidence(), lake.derivations(), lake.truth())


def _unknown_sql(value, band, ordering):
    return f"(NOT coalesce(list_contains({_sql_list(ordering)}, {value}), false) OR NOT list_has_all({_sql_list(ordering)}, {band}))"


def _dir_sql(value, band, ordering):
    o = _sql_list(ordering)
    pos, ranks = f"list_position({o}, {value})", f"list_transform({band}, lambda b: list_position({o}, b))"
    return (f"CASE WHEN {_unknown_sql(value, band, ordering)} THEN NULL WHEN {pos} > list_max({ranks}) THEN 'over' "
            f"WHEN {pos} < list_min({ranks}) THEN 'under' ELSE 'in_band' END")


def _dist_sql(value, band, ordering):
    o = _sql_list(ordering)
    pos, ranks = f"list_position({o}, {value})", f"list_transform({band}, lambda b: list_position({o}, b))"
    return (f"CAST(CASE WHEN {_unknown_sql(value, band, ordering)} THEN NULL WHEN {pos} > list_max({ranks}) THEN {pos} - list_max({ranks}) "
            f"WHEN {pos} < list_min({ranks}) THEN {pos} - list_min({ranks}) ELSE 0 END AS INTEGER)")


def _any_sql(text, phrases):
    return "(" + " OR ".join(f"contains({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


_IDS = r"list_distinct(list_transform(regexp_extract_all(rationale, '(?i)\b(A0|EV-\d{3}|DER-\d{3})\b', 1), lambda x: upper(x)))"
add_view("valid", """SELECT case_id, list(DISTINCT evidence_id) AS ids FROM
    (SELECT case_id, evidence_id FROM pkg UNION ALL SELECT case_id, derivation_id FROM der) GROUP BY case_id""", "pkg der")
add_view("sc", f"""
    SELECT o.*, gt.* EXCLUDE (case_id), v.ids, d.case_id IS NOT NULL AS has_derivation, {_IDS} AS text_ids
    FROM o JOIN gt USING (case_id) JOIN valid v USING (case_id) LEFT JOIN der d USING (case_id)
    WHERE o.case_id IN (SELECT case_id FROM pkg)""", "o gt valid der pkg")
_CHK = f"""
    SELECT *, len(list_filter(key_evidence, lambda x: NOT list_contains(ids, x))) = 0
             AND len(list_filter(text_ids, lambda x: NOT list_contains(ids, x))) = 0
             AND len(list_filter(key_evidence, lambda x: list_contains(supporting, x) OR list_contains(counter, x))) > 0
             AND NOT ({_any_sql('lower(rationale)', DECODE_PHRASES)} AND NOT has_derivation) AS c1,
           verdict = expected_verdict AS verdict_pass, list_contains(severity_band, severity) AS severity_pass,
           verdict = expected_verdict AND list_contains(severity_band, severity) AS c2,
           len(counter) > 0 AS c3_applicable,
           len(counter) = 0 OR len(list_filter(counter, lambda x: list_contains(key_evidence, x) OR list_contains(text_ids, x))) > 0 AS c3,
           list_contains(action_band, action) AS c4,
           {_dir_sql('verdict', '[expected_verdict]', VERDICTS)} AS verdict_direction,
           {_dir_sql('severity', 'severity_band', SEVERITIES)} AS severity_direction,
           {_dir_sql('action', 'action_band', ACTIONS)} AS action_direction
    FROM %s"""
add_view("chk", _CHK % "sc", "sc")
_SEEDS = """CASE WHEN case_id % 107 = 0 THEN 'reboot' ELSE action END AS action, CASE WHEN case_id % 97 = 0 THEN 'urgent' ELSE severity END AS severity,
    CASE WHEN case_id % 89 = 0 THEN 'unsure' ELSE verdict END AS verdict"""
add_view("ou", f"SELECT * REPLACE ({_SEEDS}) FROM o", "o")
add_view("chku", _CHK % f"(SELECT * REPLACE ({_SEEDS}) FROM sc)", "sc")


def seeded(lake):
    """Decisions some of which hold a verdict, severity or action that no ordering knows."""
    k = F.col("case_id")
    return lake.outputs().withColumns({
        "action": F.when(k % 107 == 0, "reboot").otherwise(F.col("action")), "severity": F.when(k % 97 == 0, "urgent").otherwise(F.col("severity")),
        "verdict": F.when(k % 89 == 0, "unsure").otherwise(F.col("verdict"))})


def seeded_checks(lake):
    return S.case_checks(seeded(lake), lake.evidence(), lake.derivations(), lake.truth())
_J = "array_to_string(list_sort(%s), '|')"


@query("chk_01", "chk", f"""
    SELECT case_id, {_J % 'list_filter(key_evidence, lambda x: NOT list_contains(ids, x))'} AS invalid_key_ids,
           {_J % 'list_filter(text_ids, lambda x: NOT list_contains(ids, x))'} AS invalid_text_ids,
           {_J % 'list_filter(key_evidence, lambda x: list_contains(supporting, x) OR list_contains(counter, x))'} AS relevant_key_ids,
           {_any_sql('lower(rationale)', DECODE_PHRASES)} AND NOT has_derivation AS decode_claim, c1 FROM chk""")
def chk_01(lake):
    return checks(lake).select("case_id", *[joined(F.col(c)).alias(c) for c in ("invalid_key_ids", "invalid_text_ids", "relevant_key_ids")],
                               "decode_claim", "c1")


@query("chk_02", "chku", "SELECT case_id, verdict, expected_verdict, verdict_direction, verdict_pass, severity, severity_direction, severity_pass, c2 FROM chku")
def chk_02(lake):
    return seeded_checks(lake).select("case_id", "verdict", "expected_verdict", "verdict_direction", "verdict_pass", "severity",
                               "severity_direction", "severity_pass", "c2")


@query("chk_03", "chk", f"""
    SELECT case_id, c3_applicable, {_J % 'list_filter(counter, lambda x: list_contains(key_evidence, x) OR list_contains(text_ids, x))'} AS cited_counter, c3 FROM chk""")
def chk_03(lake):
    return checks(lake).select("case_id", "c3_applicable", joined(F.col("cited_counter_ids")).alias("cited_counter"), "c3")


@query("chk_04", "chku", """SELECT case_id, action, action_direction, c4, concat_ws('|', CASE WHEN case_id % 89 = 0 THEN 'verdict' END,
    CASE WHEN case_id % 97 = 0 THEN 'severity' END, CASE WHEN case_id % 107 = 0 THEN 'action' END) AS unknown_values FROM chku""")
def chk_04(lake):
    return seeded_checks(lake).select("case_id", "action", "action_direction", "c4", F.array_join("unknown_values", "|").alias("unknown_values"))


def _over_sql(text):
    """First outcome word of the first sentence with certainty and no hedge."""
    sentences = (f"list_filter(regexp_split_to_array(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
                 f"lambda s: {_any_sql('s', OUTCOME_WORDS)} AND {_any_sql('s', CERTAIN_WORDS)} AND NOT {_any_sql('s', HEDGE_WORDS)})[1]")
    arms = " ".join(f"WHEN contains({sentences}, '{w}') THEN '{w}'" for w in OUTCOME_WORDS)
    return f"CASE {arms} END"


@query("chk_05", "sc", f"""
    SELECT case_id, {_J % 'list_filter(key_evidence, lambda x: NOT list_contains(ids, x))'} AS invalid_key_ids,
           {_any_sql('lower(rationale)', DECODE_PHRASES_V10)} AND NOT has_derivation AS legacy_decode,
           expected_verdict <> 'malicious' AND ({_over_sql('lower(rationale)')}) IS NOT NULL AS legacy_over_assertion,
           len(list_filter(key_evidence, lambda x: NOT list_contains(ids, x))) = 0
           AND NOT ({_any_sql('lower(rationale)', DECODE_PHRASES_V10)} AND NOT has_derivation)
           AND NOT (expected_verdict <> 'malicious' AND ({_over_sql('lower(rationale)')}) IS NOT NULL) AS c1
    FROM (SELECT * REPLACE (rationale || CASE WHEN case_id % 19 = 0 THEN ' This confirms a full compromise.'
          WHEN case_id % 23 = 0 THEN ' It likely confirms a breach.' ELSE '' END AS rationale) FROM sc)""")
def chk_05(lake):
    k = F.col("case_id")
    extra = F.when(k % 19 == 0, " This confirms a full compromise.").when(k % 23 == 0, " It likely confirms a breach.").otherwise("")
    asserted = scored(lake).withColumn("rationale", F.concat("rationale", extra))
    return S.legacy_checks(asserted).select("case_id", joined(F.array_intersect("key_ids", "unknown_ids")).alias("invalid_key_ids"),
                                            "legacy_decode", "legacy_over_assertion", "c1")


@query("chk_06", "chk", """SELECT case_id, severity_direction, severity_pass AS c2,
    CASE severity_direction WHEN 'over' THEN 'down_rank' WHEN 'under' THEN 'up_rank' ELSE 'preserve' END AS move FROM chk""")
def chk_06(lake):
    return S.legacy_checks(scored(lake)).select("case_id", "severity_direction", "move", "c2")


@query("chk_07", "sc", """SELECT case_id, len(counter) = 0 OR (len(list_filter(counter, lambda x: list_contains(key_evidence, x))) > 0
    AND verdict IN ('benign', 'suspicious') AND severity IN ('informational', 'low', 'medium')) AS c3 FROM sc""")
def chk_07(lake):
    return S.legacy_checks(scored(lake)).select("case_id", "c3")


@query("chk_08", "sc", f"""SELECT case_id, ceiling, list_position({_sql_list(ACTIONS)}, action) <= list_position({_sql_list(ACTIONS)}, ceiling) AS c4
    FROM (SELECT *, CASE condition WHEN 'strong' THEN 'isolate' WHEN 'counter' THEN 'close_benign' ELSE 'investigate' END AS ceiling FROM sc)""")
def chk_08(lake):
    return S.legacy_checks(scored(lake)).select("case_id", "ceiling", "c4")


_TRUTH_ERR = f"""
    SELECT case_id, concat_ws('|',
        CASE WHEN rubric_version <> '1.1' THEN 'version' END,
        CASE WHEN expected_verdict <> {_case_of('condition', 0)} THEN 'verdict' END,
        CASE WHEN %s THEN 'severity_band' END,
        CASE WHEN action_band <> {_case_of('condition', 2)} THEN 'action_band' END,
        CASE WHEN NOT list_contains({_case_of('condition', 3)}, role) THEN 'role' END,
        CASE WHEN len(list_filter(supporting || counter, lambda x: NOT list_contains(coalesce(ids, []), x))) > 0 THEN 'unknown_ids' END,
        CASE WHEN len(list_filter(supporting, lambda x: list_contains(counter, x))) > 0 THEN 'overlap' END,
        CASE WHEN len(supporting || counter) = 0 THEN 'no_evidence' END) AS errors
    FROM gtd LEFT JOIN valid USING (case_id)"""


@query("chk_09", "gtd valid", _TRUTH_ERR % f"severity_band <> {_case_of('condition', 1)}")
def chk_09(lake):
    return S.truth_errors(lake.truth_drafts(), lake.evidence(), lake.derivations()).select(
        "case_id", F.array_join("errors", "|").alias("errors"))


@query("jn_01", "sc", "SELECT case_id, verdict, expected_verdict, condition FROM sc")
def jn_01(lake):
    return lake.outputs().join(S.package_headers(lake.evidence()), "case_id").join(lake.truth(), "case_id").select(
        "case_id", "verdict", "expected_verdict", "condition")


@query("jn_02", "o pkg gt", """
    SELECT 'missing_output' AS problem, CAST(count(DISTINCT case_id) AS BIGINT) AS cases FROM pkg
      WHERE case_id NOT IN (SELECT case_id FROM o WHERE case_id % 37 <> 0)
    UNION ALL SELECT 'orphan_output', CAST(count(*) AS BIGINT) FROM o WHERE case_id % 37 <> 0 AND case_id NOT IN (SELECT case_id FROM pkg)
    UNION ALL SELECT 'missing_truth', CAST(count(DISTINCT case_id) AS BIGINT) FROM pkg
      WHERE case_id NOT IN (SELECT case_id FROM gt WHERE case_id % 41 <> 0)""")
def jn_02(lake):
    """Whole tables on both sides; the dropped multiples seed the gaps that must be found."""
    packages = lake.evidence().select("case_id").distinct()
    outputs = lake.outputs().select("case_id").filter("case_id % 37 <> 0")
    truth = lake.truth().select("case_id").filter("case_id % 41 <> 0")
    named = {
        "missing_output": packages.join(outputs, "case_id", "left_anti"),
        "orphan_output": outputs.join(packages, "case_id", "left_anti"),
        "missing_truth": packages.join(truth, "case_id", "left_anti"),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("cases")).select(F.lit(name).alias("problem"), "cases") for name, df in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("jn_09", "sc", f"""
    SELECT case_id, {_J % 'list_filter(list_distinct(key_evidence || text_ids), lambda x: NOT list_contains(ids, x))'} AS unknown_ids,
           {_J % 'list_filter(key_evidence, lambda x: list_contains(supporting || counter, x))'} AS relevant FROM sc""")
def jn_09(lake):
    return scored(lake).select("case_id", joined(F.col("unknown_ids")).alias("unknown_ids"),
                               joined(F.array_intersect("key_ids", F.array_union("supporting", "counter"))).alias("relevant"))


@query("jn_12", "gt", f"""SELECT case_id, condition, {_case_of('condition', 0)} AS verdict,
    array_to_string({_case_of('condition', 1)}, '|') AS severity, array_to_string({_case_of('condition', 2)}, '|') AS actions FROM gt""")
def jn_12(lake):
    c = F.col("condition")
    return lake.truth().select("case_id", "condition", policy_value(c, 0).alias("verdict"),
                               F.array_join(policy_value(c, 1), "|").alias("severity"), F.array_join(policy_value(c, 2), "|").alias("actions"))


_N = "CAST(count(*) FILTER (WHERE %s) AS BIGINT)"
_SUMMARY_SQL = f"""CAST(count(*) AS BIGINT) AS n, {_N % 'verdict_pass'} AS verdict_correct_n, {_N % 'severity_pass'} AS severity_in_band_n,
    {_N % 'c2'} AS joint_correct_n, {_N % 'c3_applicable'} AS c3_applicable_n"""
_FAIL_SQL = ", ".join(f"{_N % f'NOT c{i}'} AS c{i}_failures" for i in range(1, 5))


@query("agg_04", "chk", f"SELECT condition, {_SUMMARY_SQL} FROM chk GROUP BY condition")
def agg_04(lake):
    return checks(lake).groupBy("condition").agg(*S.summary_aggregates()[:5])


@query("agg_05", "chk", f"SELECT {_FAIL_SQL} FROM chk")
def agg_05(lake):
    return checks(lake).agg(*S.summary_aggregates()[5:9])


@query("agg_06", "chk", """
    SELECT case_id, NOT c1 AS a3_flagged, NOT (c1 AND c2 AND c3 AND c4) AS a4_flagged,
           concat_ws('|', CASE WHEN NOT c1 THEN 'C1' END, CASE WHEN NOT c2 THEN 'C2' END, CASE WHEN NOT c3 THEN 'C3' END,
                     CASE WHEN NOT c4 THEN 'C4' END) AS flags FROM chk""")
def agg_06(lake):
    return checks(lake).select("case_id", (F.size(S.failed_checks(["C1"])) > 0).alias("a3_flagged"),
                               (F.size(S.failed_checks()) > 0).alias("a4_flagged"), F.array_join(S.failed_checks(), "|").alias("flags"))


@query("agg_07", "chk", """
    SELECT c.condition, CAST(count(*) FILTER (WHERE severity_direction = 'over') AS BIGINT) AS over,
           CAST(count(*) FILTER (WHERE severity_direction = 'in_band') AS BIGINT) AS in_band,
           CAST(count(*) FILTER (WHERE severity_direction = 'under') AS BIGINT) AS under
    FROM (VALUES ('strong'), ('weak'), ('missing'), ('counter')) c(condition) LEFT JOIN chk USING (condition) GROUP BY c.condition""")
def agg_07(lake):
    """Every condition appears, also without cases: one fixed-width aggregate, unpivoted."""
    names = CONDITIONS
    cells = [count_where((F.col("condition") == c) & (F.col("severity_direction") == d)).alias(f"{c}_{d}")
             for c in names for d in ("over", "in_band", "under")]
    rows = F.array(*[F.struct(F.lit(c).alias("condition"), *[F.col(f"{c}_{d}").alias(d) for d in ("over", "in_band", "under")]) for c in names])
    return checks(lake).agg(*cells).select(F.inline(rows))


@query("agg_08", "chk", """
    SELECT condition, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE c2) AS BIGINT) AS correct_n,
           CAST(count(*) FILTER (WHERE NOT c2) AS BIGINT) AS incorrect_n,
           round_even(sum(u)::DOUBLE / count(*) / 10000.0, 4) AS mean_confidence,
           round_even(sum(u) FILTER (WHERE c2)::DOUBLE / nullif(count(*) FILTER (WHERE c2), 0) / 10000.0, 4) AS mean_correct,
           round_even(sum(u) FILTER (WHERE NOT c2)::DOUBLE / nullif(count(*) FILTER (WHERE NOT c2), 0) / 10000.0, 4) AS mean_incorrect,
           round_even(sum((u - CASE WHEN c2 THEN 10000 ELSE 0 END) * (u - CASE WHEN c2 THEN 10000 ELSE 0 END))::DOUBLE / count(*) / 1e8, 4) AS brier,
           CAST(count(*) FILTER (WHERE NOT c2 AND confidence >= 0.8) AS BIGINT) AS high_confidence_errors
    FROM (SELECT *, CAST(round_even(confidence * 10000, 0) AS BIGINT) AS u FROM chk) GROUP BY condition""")
def agg_08(lake):
    return checks(lake).groupBy("condition").agg(*S.confidence_aggregates())


@query("agg_09", "chk", f"""SELECT {_N % 'NOT (c1 AND c2 AND c3 AND c4)'} AS full_flagged, {_N % 'NOT c1'} AS active_flagged,
    {_N % 'NOT (c1 AND c2 AND c3 AND c4) AND c1'} AS missed FROM chk""")
def agg_09(lake):
    full, active = F.size(S.failed_checks()) > 0, F.size(S.failed_checks(["C1"])) > 0
    return checks(lake).agg(count_where(full).alias("full_flagged"), count_where(active).alias("active_flagged"),
                            count_where(full & ~active).alias("missed"))


@query("scl_01", "o", f"""SELECT case_id, {_J % _IDS} AS cited,
    {_J % "list_distinct(regexp_extract_all(rationale, '\\b(A0|EV-\\d{3}|DER-\\d{3})\\b', 1))"} AS cited_exact FROM o""")
def scl_01(lake):
    return lake.outputs().select("case_id", joined(evidence_ids(F.col("rationale"))).alias("cited"),
                                 joined(evidence_ids(F.col("rationale"), ignore_case=False)).alias("cited_exact"))


@query("scl_02", sql=f"""
    SELECT conv_id, turn, CASE {' '.join(f"WHEN contains(t, '{p}') THEN '{p}'" for p in DECODE_PHRASES)} END AS phrase
    FROM (SELECT conv_id, turn, lower(text || CASE WHEN turn % 2 = 1 THEN ' Upon Decoding it, the decoded value is 7.' ELSE '' END) AS t FROM conversations)""")
def scl_02(lake):
    tail = F.when(F.col("turn") % 2 == 1, " Upon Decoding it, the decoded value is 7.").otherwise("")
    return lake.table("conversations").select("conv_id", "turn", first_phrase(F.concat("text", tail), DECODE_PHRASES).alias("phrase"))


@query("scl_03", "ou gt", f"""SELECT case_id, {_dir_sql('severity', 'severity_band', SEVERITIES)} AS severity_direction,
    {_dir_sql('action', 'action_band', ACTIONS)} AS action_direction, {_dir_sql('verdict', '[expected_verdict]', VERDICTS)} AS verdict_direction
    FROM ou JOIN gt USING (case_id)""")
def scl_03(lake):
    both = seeded(lake).join(lake.truth(), "case_id")
    return both.select("case_id", direction(F.col("severity"), F.col("severity_band"), SEVERITIES).alias("severity_direction"),
                       direction(F.col("action"), F.col("action_band"), ACTIONS).alias("action_direction"),
                       direction(F.col("verdict"), F.array("expected_verdict"), VERDICTS).alias("verdict_direction"))


@query("scl_04", "ou gt", f"""SELECT case_id, {_dist_sql('severity', 'severity_band', SEVERITIES)} AS severity_distance,
    {_dist_sql('action', 'action_band', ACTIONS)} AS action_distance, {_dist_sql('verdict', '[expected_verdict]', VERDICTS)} AS verdict_distance
    FROM ou JOIN gt USING (case_id)""")
def scl_04(lake):
    both = seeded(lake).join(lake.truth(), "case_id")
    return both.select("case_id", signed_distance(F.col("severity"), F.col("severity_band"), SEVERITIES).alias("severity_distance"),
                       signed_distance(F.col("action"), F.col("action_band"), ACTIONS).alias("action_distance"),
                       signed_distance(F.col("verdict"), F.array("expected_verdict"), VERDICTS).alias("verdict_distance"))


@query("scl_05", "o", """SELECT action, round_even(count(*) FILTER (WHERE verdict = 'benign')::DOUBLE / nullif(count(*), 0), 4) AS benign_rate,
    round_even(count(*)::DOUBLE / nullif(count(*) FILTER (WHERE verdict = 'none'), 0), 4) AS empty_rate FROM o GROUP BY action""")
def scl_05(lake):
    return lake.outputs().groupBy("action").agg(
        safe_ratio(F.count_if(F.col("verdict") == "benign"), F.count(F.lit(1))).alias("benign_rate"),
        safe_ratio(F.count(F.lit(1)), F.count_if(F.col("verdict") == "none")).alias("empty_rate"))


@query("set_04", "gtd", f"SELECT case_id, {_J % 'list_filter(supporting, lambda x: list_contains(counter, x))'} AS overlap FROM gtd WHERE list_has_any(supporting, counter)")
def set_04(lake):
    return lake.truth_drafts().filter(F.arrays_overlap("supporting", "counter")).select(
        "case_id", joined(F.array_intersect("supporting", "counter")).alias("overlap"))


@query("set_05", sql="""
    WITH p AS (SELECT p_brand, list(DISTINCT p_type) AS have FROM part GROUP BY p_brand)
    SELECT p_brand AS brand, list_has_all(have, ['ECONOMY', 'SMALL']) AS complete FROM p""")
def set_05(lake):
    have = lake.table("part").groupBy(F.col("p_brand").alias("brand"))
    return have.agg(*[F.bool_or(F.col("p_type") == t).alias(t) for t in ("ECONOMY", "SMALL")]).select(
        "brand", (F.col("ECONOMY") & F.col("SMALL")).alias("complete"))


@query("set_06", "gtd", f"""SELECT case_id, severity_band = {_case_of('condition', 1)} AS same_list,
    list_sort(severity_band) = list_sort({_case_of('condition', 1)}) AS same_set FROM gtd""")
def set_06(lake):
    band, policy = F.col("severity_band"), policy_value(F.col("condition"), 1)
    return lake.truth_drafts().select("case_id", (band == policy).alias("same_list"),
                                      (F.array_sort(band) == F.array_sort(policy)).alias("same_set"))


@query("set_07", "o", f"SELECT case_id, {_J % f'list_distinct(key_evidence || {_IDS})'} AS all_ids FROM o")
def set_07(lake):
    return S.with_cited_ids(lake.outputs()).select("case_id", joined(F.array_union("key_ids", "text_ids")).alias("all_ids"))
