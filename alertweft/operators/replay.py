"""Replay of trigger rules over complete logs, from the rule document to the selected event.

One row per rule tells what the document's checks found, how many events were in
scope, matched and formed qualifying groups, which event the rule selects and
whether that is the configured one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.operators.rules import field_column, funnel, lint, match_rules, predicate
from alertweft.operators.sessions import bursts

STRATEGIES = ("earliest_match", "latest_match")
GROUP_STRATEGY = "earliest_in_highest_count_group"


def natural(key: Column) -> Column:
    """Sort form of a record key: digit runs compare as numbers, everything else without case."""
    runs = F.regexp_extract_all(key, F.lit(r"(\d+|\D+)"), F.lit(1))
    parted = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(F.lower(r))), "\u0001")
    # a key of digits is one run
    return F.when((key != "") & (F.translate(key, "0123456789", "") == ""), F.lpad(key, 20, "0")).otherwise(parted)


def event_order(at: str, key: str) -> Column:
    """Time, then record key; events without a time come last."""
    return F.struct(F.col(at).isNull().cast("int").alias("late"), F.col(at).alias("at"), natural(F.col(key)).alias("key"))


def document_problems(rule: dict, catalogue: set[tuple[str, str, str]]) -> list[str]:
    """What is wrong with a rule document before any event is read."""
    problems = [f"forbidden field: {found}" for found in lint(rule)]
    if (rule.get("analytic_family_id"), rule.get("analytic_pattern_id"), rule["case_id"]) not in catalogue:
        problems.append("not in the taxonomy")
    strategy = rule.get("selection", {}).get("strategy")
    if rule.get("aggregation"):
        if strategy != GROUP_STRATEGY:
            problems.append("an aggregated rule selects the earliest event of the largest group")
    elif strategy not in STRATEGIES:
        problems.append("a rule without aggregation selects the earliest or latest match")
    return problems


def _groups(events: DataFrame, rule: dict, at: str, key: str) -> DataFrame:
    """(rule_case, groups, selected) of one aggregated rule."""
    scope = rule.get("scope", {}).get("filter_predicate")
    aggregation = rule["aggregation"]
    fields = [*aggregation["group_by"], *([aggregation["distinct"]["field"]] if aggregation.get("distinct") else [])]
    names = {f: f"_g{i}" for i, f in enumerate(dict.fromkeys(fields))}
    hits = events.where(predicate(rule["event_predicate"]))
    hits = hits.where(predicate(scope)) if scope else hits
    hits = hits.select(at, key, natural(F.col(key)).alias("_natural"), *[field_column(f).alias(n) for f, n in names.items()])
    found = bursts(hits, aggregation, names, at, F.struct("_natural", key), [key])
    first = F.min_by(key, F.struct(-F.col("n"), F.col("start_us"), natural(F.col(key))))
    return found.agg(F.count(F.lit(1)).alias("groups"), first.alias("selected")).select(
        F.lit(rule["case_id"]).alias("rule_case"), "groups", "selected")


def replay(events: DataFrame, rules: list[dict], catalogue: list[tuple[str, str, str]], configured: DataFrame,
           at: str = "event_time", key: str = "record_key") -> DataFrame:
    """One row per rule of ``rules``.

    ``catalogue`` lists (family, pattern, case); ``configured`` has (case_id,
    record_key) of the events the cases are built on.  All counts come from one
    scan and all selections without a group from a second; only a rule with an
    aggregation block groups its own matches.  A rule passes when its document is
    sound, its scope holds events, and it selects the configured event, which is
    also the one the document expects if it states one.
    """
    spark = events.sparkSession
    known = set(catalogue)
    plain = [r for r in rules if not r.get("aggregation")]
    order = event_order(at, key)
    # the order is formed for matches only
    ends = match_rules(events, plain).groupBy("rule_case").agg(
        F.min_by(key, order).alias("first"), F.max_by(key, order).alias("last")) if plain else None
    latest = [r["case_id"] for r in plain if r.get("selection", {}).get("strategy") == "latest_match"]
    parts = [] if ends is None else [ends.select(
        "rule_case", F.lit(0).cast("bigint").alias("groups"), F.when(F.col("rule_case").isin(latest), F.col("last")).otherwise(F.col("first")).alias("selected"))]
    parts += [_groups(events, r, at, key) for r in rules if r.get("aggregation")]
    selected = reduce(DataFrame.unionByName, parts)
    documents = spark.createDataFrame(
        [(r["case_id"], r["rule_id"], r.get("selection", {}).get("strategy"), r.get("expected_a0", {}).get("record_key"), document_problems(r, known)) for r in rules],
        "case_id string, rule_id string, strategy string, stated_key string, document_problems array<string>")
    configured = configured.select("case_id", F.col("record_key").alias("expected_key"))
    rows = documents.join(funnel(events, rules), "case_id").join(
        selected.withColumnRenamed("rule_case", "case_id"), "case_id", "left").join(configured, "case_id", "left")
    problem = lambda test, name: F.when(test, F.lit(name))
    found = F.concat("document_problems", F.array_compact(F.array(
        problem(F.col("scope_events") == 0, "no event in scope"),
        problem(F.col("selected").isNull(), "nothing selected"),
        problem(F.col("expected_key").isNull(), "no event configured"),
        problem(F.col("selected").isNotNull() & F.col("expected_key").isNotNull() & (F.col("selected") != F.col("expected_key")), "another event is configured"),
        problem(F.col("stated_key") != F.col("expected_key"), "the document expects another event"))))
    return rows.select(
        "case_id", "rule_id", "raw_events", "scope_events", "predicate_matches", F.coalesce("groups", F.lit(0)).cast("bigint").alias("qualifying_groups"),
        "strategy", F.col("selected").alias("selected_key"), "expected_key", found.alias("problems"), (F.size(found) == 0).alias("passed"))
