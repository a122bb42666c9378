"""Gate of built cases before they are frozen: documents, trigger, taxonomy, leaks, ids, decision band, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.fixed import FORBIDDEN_PATTERNS
from alertweft.functions.ordinal import policy_value
from alertweft.functions.text import labels
from alertweft.operators.redaction import has_any

#: what an id of ``ids`` is: an event of the package (alert or evidence), a derivation, an id the truth cites, an id with provenance
EVENT, DERIVATION, CITED, TRACED = "event", "derivation", "cited", "traced"
TIMING, RULE_FILE = "prospective_pre_model", "annotations/trigger_spec.json"


def id_faults(ids: DataFrame) -> DataFrame:
    """Per case of ``ids`` (case_id, kind, id, record_id): events, and whether ids repeat, are unknown, untraced or not neutral.

    Ids are counted per (case, id) first, so a case with very many is spread over them.
    """
    of = lambda kind: F.count_if(F.col("kind") == kind)
    neutral = F.col("record_id").eqNullSafe(F.concat(F.lit("SRC-"), F.col("id")))
    per_id = ids.groupBy("case_id", "id").agg(
        of(EVENT).alias("events"), of(DERIVATION).alias("derivations"), of(CITED).alias("cited"), of(TRACED).alias("traced"),
        F.count_if((F.col("kind") == EVENT) & ~neutral).alias("named"))
    held = F.col("events") + F.col("derivations")
    return per_id.groupBy("case_id").agg(
        F.sum("events").alias("n_events"), F.bool_or(held > 1).alias("repeated"), F.bool_or((F.col("cited") > 0) & (held == 0)).alias("unknown"),
        F.bool_or((F.col("traced") > 0) != (F.col("events") > 0)).alias("untraced"), F.bool_or(F.col("named") > 0).alias("named"))


def _same(*columns: str) -> Column:
    first = F.col(columns[0])
    out = first.isNotNull()
    for other in columns[1:]:
        out = out & first.eqNullSafe(F.col(other))
    return out


def case_faults(cases: DataFrame, ids: DataFrame, taxonomy: list[tuple[str, str, str]]) -> DataFrame:
    """(case_id, faults) of every row of ``cases``, faults in a fixed order, none if the case may be frozen.

    ``cases`` has one row per case: case_id, truth_case_id, selection_case_id,
    provenance_case_id, documents_complete, timing, trigger_passed, selected_key,
    expected_key, rule_case, family, pattern, audit_family, audit_pattern, runbook,
    source_sha256, actual_sha256, package_text, event_count, condition, verdict,
    severity_band, action_band.  A check whose value is null fails, and a case that is
    not complete has that one fault only.  ``taxonomy`` lists (family, pattern, case).
    """
    places = [f"{family}/{pattern}/{case}" for family, pattern, case in taxonomy]
    classified = F.concat_ws("/", "family", "pattern", "rule_case").isin(places) if places else F.lit(False)
    joined = cases.join(id_faults(ids), "case_id", "left")
    fails = lambda test: ~F.coalesce(test, F.lit(False))
    band = (F.col("verdict").eqNullSafe(policy_value(F.col("condition"), 0)) & F.col("severity_band").eqNullSafe(policy_value(F.col("condition"), 1))
            & F.col("action_band").eqNullSafe(policy_value(F.col("condition"), 2)) & policy_value(F.col("condition"), 0).isNotNull())
    faults = labels([
        (fails(classified), "taxonomy"), (fails(F.col("timing") == TIMING), "timing"), (fails(F.col("trigger_passed")), "trigger not passed"),
        (fails(_same("selected_key", "expected_key")), "selected event"), (fails(_same("family", "audit_family")), "audited family"),
        (fails(_same("pattern", "audit_pattern")), "audited pattern"), (fails(F.contains("runbook", F.lit(RULE_FILE))), "runbook"),
        (F.col("source_sha256").isNull(), "no source"), (F.col("source_sha256").isNotNull() & F.col("actual_sha256").isNull(), "source absent"),
        (F.coalesce(F.col("source_sha256") != F.col("actual_sha256"), F.lit(False)), "source hash"),
        *[(has_any(F.coalesce("package_text", F.lit("")), [pattern]), f"leaked {name}") for name, pattern in FORBIDDEN_PATTERNS.items()],
        (fails(_same("case_id", "truth_case_id", "selection_case_id", "provenance_case_id")), "case ids"),
        (F.coalesce("repeated", F.lit(False)), "repeated id"), (F.coalesce("unknown", F.lit(False)), "unknown id"),
        (fails(F.col("event_count") == F.coalesce("n_events", F.lit(0))), "event count"), (F.coalesce("named", F.lit(False)), "record id"),
        (fails(band), "decision band"), (F.coalesce("untraced", F.lit(False)), "provenance ids")])
    return joined.select("case_id", F.when(fails(F.col("documents_complete")), F.array(F.lit("incomplete"))).otherwise(faults).alias("faults"))
