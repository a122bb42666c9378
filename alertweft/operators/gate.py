"""Runtime decision gate: findings R000-R013, signals, and routing per profile.

The gate reads packages and decisions only, never ground truth.  The policy is
a plain dict, turned into literal columns, so no policy table is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.fixed import ACTIONS, FINDING_CODES, POLICY_KEYS, RUNTIME_POLICY, SEVERITIES, VERDICTS
from alertweft.functions.text import any_phrase, labels, str_array
from alertweft.operators.scoring import held_citations, package_ids, with_unknown_ids
from alertweft.session import merged

OUTPUT_FIELDS = ["verdict", "severity", "confidence", "key_evidence", "rationale", "action"]


class PolicyError(ValueError):
    """A runtime policy that cannot be used."""


def policy_errors(policy: dict) -> list[str]:
    """Every reason a policy is unusable."""
    errors = [f"missing field {k}" for k in POLICY_KEYS if k not in policy]
    if errors:
        return errors
    if policy["policy_version"] not in ("1.0", "1.1", "1.2"):
        errors.append(f"unsupported version {policy['policy_version']}")
    levels = policy.get("finding_levels", {})
    errors += [f"invalid level {c}={v}" for c, v in levels.items() if v not in ("block", "review")]
    if policy["policy_version"] in ("1.1", "1.2") and set(levels) != set(FINDING_CODES.values()):
        errors.append("finding levels must cover every code exactly")
    if policy["default_profile"] not in policy["routing_profiles"]:
        errors.append("default profile is undefined")
    for name, signals in policy["routing_profiles"].items():
        errors += [f"profile {name} uses unknown signal {s}" for s in signals if s not in policy["signals"]]
    return errors


def output_contract_errors() -> Column:
    """Contract violations of a decision: required fields, enums, range, minimum lengths."""
    tests = [
        (~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False)), "verdict"),
        (~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False)), "severity"),
        (~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence"),
        (F.coalesce(F.size("key_evidence"), F.lit(0)) < 1, "key_evidence"),
        (F.coalesce(F.length("rationale"), F.lit(0)) < 1, "rationale"),
        (~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "action"),
    ]
    return labels(tests)


#: JSON types of the fields a decision must have
OUTPUT_TYPES = {
    "verdict": "^STRING$", "severity": "^STRING$", "confidence": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "key_evidence": "^ARRAY<STRING>$",
    "rationale": "^STRING$", "recommended_action": "^STRING$",
}


def raw_contract_errors(text: Column) -> Column:
    """Sorted contract violations of a decision as it was written: JSON text with exactly the known keys and types."""
    parsed = F.try_parse_json(text)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT<")), F.lit(False))
    keys = F.json_object_keys(text)
    tests = []
    for field, kind in OUTPUT_TYPES.items():
        given = F.array_contains(keys, field)
        fits = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")).rlike(kind), F.lit(False))
        tests += [(~given, f"missing {field}"), (given & ~fits, f"type {field}")]
    extra = F.transform(F.array_except(keys, str_array(list(OUTPUT_TYPES))), lambda k: F.concat(F.lit("extra "), k))
    return F.when(is_object, F.array_sort(F.concat(labels(tests), extra))).otherwise(str_array(["not an object"]))


def package_facts(evidence: DataFrame, derivations: DataFrame) -> DataFrame:
    """Per package: counts, id of the flagged alert, duplicate ids, derivations without a source.

    Evidence and derivation ids share one name space, so an id that both use is a
    duplicate.  Copies are counted per (case, id) first; the per-case step sees
    counts only, so a very large package is never gathered in one place.
    ``is_alert`` marks the triggering evidence; a package without a mark has no main id.
    """
    events = evidence.select("case_id", F.upper("evidence_id").alias("id"), F.lit(1).alias("event"), F.coalesce("is_alert", F.lit(False)).alias("alert"))
    derived = derivations.select("case_id", F.upper("derivation_id").alias("id"), F.lit(0).alias("event"), F.lit(False).alias("alert"))
    per_id = events.unionByName(derived).groupBy("case_id", "id").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("event").alias("events"), F.bool_or("alert").alias("alert"))
    orphans = derivations.select("case_id", F.upper("source_evidence_id").alias("id")).join(
        merged(per_id.where("events > 0").select("case_id", "id")), ["case_id", "id"], "left_anti"
    ).groupBy("case_id").agg(F.count(F.lit(1)).alias("orphan_derivations"))
    facts = per_id.groupBy("case_id").agg(
        F.sum("events").alias("event_count"),
        F.min(F.when(F.col("alert"), F.col("id"))).alias("main_id"),
        F.count_if(F.col("copies") > 1).alias("duplicate_ids"),
        F.count_if(F.col("events") > 0).alias("distinct_ids"),
        F.sum(F.col("copies") - F.col("events")).alias("n_derivations"),
    ).where("event_count > 0")
    return facts.join(merged(orphans), "case_id", "left").withColumn("orphan_derivations", F.coalesce("orphan_derivations", F.lit(0)))


def gate_inputs(outputs: DataFrame, evidence: DataFrame, derivations: DataFrame, declared: DataFrame,
                citing: DataFrame | None = None) -> DataFrame:
    """Decisions with package facts and unknown citations (ids compared upper-cased).

    ``declared`` gives the ``declared_count`` that each package states.  ``citing``
    are the decisions themselves where ``outputs`` carries results computed from them.
    """
    held = held_citations(outputs if citing is None else citing, package_ids(evidence, derivations, upper=True), upper_keys=True)
    facts = package_facts(evidence, derivations)
    facts = facts.join(merged(declared.select("case_id", "declared_count")), "case_id", "left")
    return with_unknown_ids(outputs.join(merged(facts), "case_id").join(merged(held), "case_id", "left"), upper_keys=True)


def findings(policy: dict = RUNTIME_POLICY) -> Column:
    """Finding codes of one decision, in code order; contract failures hide all later ones."""
    profile = policy["decision_profiles"]
    allowed = {
        part: F.create_map(*[x for v, bands in profile.items() for x in (F.lit(v), str_array(bands[part]))])[F.col("verdict")]
        for part in (0, 1)
    }
    mismatch = ~(F.array_contains(allowed[0], F.col("severity")) & F.array_contains(allowed[1], F.col("action")))
    tests = {
        "R002": F.col("case_id") != F.coalesce(F.col("requested_id"), F.col("case_id")),
        "R003": ~F.col("main_id").eqNullSafe("A0"),
        "R004": F.col("duplicate_ids") > 0,
        "R005": ~F.col("event_count").eqNullSafe(F.col("declared_count")),
        "R006": F.col("orphan_derivations") > 0,
        "R007": F.size("key_ids") < F.size("key_evidence"),
        "R008": F.size(F.array_intersect("key_ids", "unknown_ids")) > 0,
        "R009": F.size(F.array_intersect("text_ids", "unknown_ids")) > 0,
        "R010": F.size("text_ids") == 0,
        "R011": (F.size("text_ids") > 0) & ~F.arrays_overlap("key_ids", "text_ids"),
        "R012": any_phrase(F.col("rationale"), policy["decode_claims"]) & (F.col("n_derivations") == 0),
        "R013": F.coalesce(mismatch, F.lit(True)),
    }
    late = labels([(t, FINDING_CODES[c]) for c, t in tests.items()])
    early = labels([(F.col("event_count") < 1, FINDING_CODES["R000"]), (F.size("contract_errors") > 0, FINDING_CODES["R001"])])
    return F.when(F.size(early) > 0, early).otherwise(late)


def signals(policy: dict = RUNTIME_POLICY) -> Column:
    """Signals raised by the decision: any configured verdict, severity or action matches."""
    raised = []
    for code, spec in policy["signals"].items():
        parts = [F.col(c).isin(spec[k]) for c, k in (("verdict", "verdicts"), ("severity", "severities"), ("action", "actions")) if spec.get(k)]
        raised.append((reduce(lambda a, b: a | b, parts, F.lit(False)), code))
    return labels(sorted(raised, key=lambda r: r[1]))


def split_levels(policy: dict = RUNTIME_POLICY) -> tuple[Column, Column]:
    """(blocking, review) findings; a code without a level blocks."""
    review = str_array([c for c, v in policy.get("finding_levels", {}).items() if v == "review"])
    return F.array_except("findings", review), F.array_intersect("findings", review)


def route(policy: dict = RUNTIME_POLICY) -> Column:
    """Array of (profile, status, reasons): block before review before pass."""
    hard, review = split_levels(policy)
    routes = []
    for name, review_on in policy["routing_profiles"].items():
        active = F.array_intersect("signals", str_array(sorted(review_on)))
        reasons = F.concat(review, active)
        status = F.when(F.size(hard) > 0, "block").when(F.size(reasons) > 0, "review").otherwise("pass")
        routes.append(F.struct(F.lit(name).alias("profile"), status.alias("status"),
                               F.when(F.size(hard) > 0, hard).otherwise(reasons).alias("reasons")))
    return F.array(*routes)


def decide(inputs: DataFrame, policy: dict = RUNTIME_POLICY) -> DataFrame:
    """Add findings, signals and routes to gate inputs; works on batch and streaming frames."""
    problems = policy_errors(policy)
    if problems:
        raise PolicyError("; ".join(problems))
    if "requested_id" not in inputs.columns:
        inputs = inputs.withColumn("requested_id", F.col("case_id"))
    checked = inputs.withColumn("contract_errors", output_contract_errors()).withColumn("findings", findings(policy))
    raised = F.when(F.size("contract_errors") > 0, F.array().cast("array<string>")).otherwise(signals(policy))
    return checked.withColumn("signals", raised).withColumn("routes", route(policy))


def routed(decided: DataFrame, *extra: str) -> DataFrame:
    """One row per (decision, profile)."""
    return decided.select("case_id", *extra, "findings", "signals", F.inline_outer("routes"))
