"""Package build from canonical events to the published document.

Select, number, derive, redact, exclude, replace identities, document - in this
order, each on the output of the one before, so nothing that a step removes can
come back later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.fixed import DEFAULT_CHANNEL, DEFAULT_PROVIDER
from alertweft.functions.codec import DERIVERS, derive
from alertweft.operators.packages import context, exclude_attributes, number_evidence
from alertweft.operators.aliases import replace_in_cases
from alertweft.operators.redaction import case_aliases, host_pseudonyms, redact, redact_map, user_pseudonyms

SCHEMA_VERSION, PACKAGE_TYPE = "1.0", "neutral_security_event_package"


def select_events(events: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence of the cases, selected records that no event has).

    ``selection`` has (case_id, record_id, is_alert); ``events`` is keyed by record_id.
    """
    chosen = selection.select("case_id", "record_id", "is_alert").join(events, "record_id")
    return chosen, selection.join(events.select("record_id"), "record_id", "left_anti").select("case_id", "record_id")


def derivations(evidence: DataFrame, specs: DataFrame) -> DataFrame:
    """Derived values of numbered evidence; ``specs`` has (case_id, derivation_id, source_evidence_id, source_field, method, derived_field, note)."""
    source = F.coalesce(F.col("attributes")[F.col("source_field")], F.lit(""))
    value = F.lit(None).cast("string")
    for method in DERIVERS:
        value = F.when(F.col("method") == method, derive(method, source)).otherwise(value)
    rows = specs.join(evidence.select("case_id", F.col("evidence_id").alias("source_evidence_id"), "attributes"), ["case_id", "source_evidence_id"])
    return rows.select("case_id", "derivation_id", F.col("note").alias("derivation_method"), "source_evidence_id", "source_field", "derived_field", value.alias("value"))


def _user(attributes: Column) -> Column:
    return F.coalesce(F.nullif(attributes["user"], F.lit("")), attributes["subject_user_name"], F.lit(""))


def replace_identities(evidence: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts, accounts and corpus domains of each case replaced everywhere a model can read them.

    The aliases of a case are as many as the identities its package shows.
    """
    hosts = host_pseudonyms(evidence, "case_id", "computer")
    users = user_pseudonyms(evidence.select("case_id", F.explode(F.array(
        F.col("attributes")["user"], F.col("attributes")["subject_user_name"], F.col("attributes")["target_user_name"])).alias("user")).where("user <> ''"), "case_id", "user")
    aliases = case_aliases(hosts, users, "case_id")
    return replace_in_cases(evidence, "case_id", ["computer", "attributes"], aliases), replace_in_cases(derived, "case_id", ["value"], aliases)


def item_struct() -> Column:
    """A published evidence item; only the alert carries the trigger mark."""
    source = F.struct(
        F.coalesce(F.nullif("provider", F.lit("")), F.lit(DEFAULT_PROVIDER)).alias("provider"),
        F.coalesce(F.nullif("channel", F.lit("")), F.lit(DEFAULT_CHANNEL)).alias("channel"), "event_code", F.col("record_id").alias("event_record_id"))
    return F.struct("evidence_id", F.when(F.col("is_alert"), True).alias("is_triggering_alert"), "event_time_utc", "event_type",
                    source.alias("source_event"), "computer", "attributes")


def package_documents(evidence: DataFrame, derived: DataFrame, sourcetypes: list[str]) -> DataFrame:
    """One document per case with the whole published contract."""
    seen = context(evidence.withColumn("user", _user(F.col("attributes"))), ["case_id"])
    number = F.when(F.col("is_alert"), 0).otherwise(F.substring("evidence_id", 4, 20).cast("long"))
    gathered = evidence.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), item_struct().alias("item"))), _by_number).alias("_items"))
    listed = derived.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(
        "derivation_id", "derived_field", "value", "derivation_method", "source_evidence_id", "source_field"))).alias("deterministic_derivations"))
    empty = F.array().cast("array<string>")
    rows = gathered.join(seen, "case_id").join(listed, "case_id", "left")
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "case_id", F.lit(PACKAGE_TYPE).alias("package_type"),
        F.struct(
            F.coalesce("computers", empty).alias("computers"), F.coalesce("users", empty).alias("users"),
            F.struct("start", "end").alias("time_window_utc"), "event_count", F.coalesce("types", empty).alias("event_types_present"),
            F.array(*[F.lit(s) for s in sourcetypes]).cast("array<string>").alias("sourcetypes_present")).alias("observed_context"),
        F.get(F.filter("_items", lambda i: i["n"] == 0), F.lit(0))["item"].alias("main_alert"),
        F.transform(F.filter("_items", lambda i: i["n"] > 0), lambda i: i["item"]).alias("evidence_items"),
        F.coalesce("deterministic_derivations", F.from_json(
            F.lit("[]"), "array<struct<derivation_id:string,derived_field:string,value:string,derivation_method:string,source_evidence_id:string,source_field:string>>"
        )).alias("deterministic_derivations"))


def _by_number(a: Column, b: Column) -> Column:
    return F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)


def build_packages(events: DataFrame, selection: DataFrame, specs: DataFrame, exclusions: DataFrame,
                   sourcetypes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, problems) of all cases; publish only when there is no problem.

    A problem is a selected record without an event, a derivation without its
    evidence, or an exclusion of an item or field that is not there.
    """
    chosen, absent = select_events(events, selection)
    numbered = number_evidence(chosen)
    derived = derivations(numbered, specs)
    lost = specs.join(numbered.select("case_id", F.col("evidence_id").alias("source_evidence_id")), ["case_id", "source_evidence_id"], "left_anti")
    redacted = numbered.withColumn("attributes", redact_map(F.col("attributes")))
    cleaned, stale = exclude_attributes(redacted, exclusions)
    items, values = replace_identities(cleaned, derived.withColumn("value", redact(F.col("value"))))
    problems = absent.select("case_id", F.lit("record without an event").alias("problem"), F.col("record_id").alias("detail")).unionByName(
        lost.select("case_id", F.lit("derivation without evidence").alias("problem"), F.col("derivation_id").alias("detail"))).unionByName(
        stale.select("case_id", F.concat(F.lit("exclusion: "), "problem").alias("problem"), F.concat_ws(".", "evidence_id", "field").alias("detail")))
    return package_documents(items, values, sourcetypes), problems
