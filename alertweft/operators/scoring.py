"""Scoring of triage decisions against ground truth: checks C1-C4, summaries, policy audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.fixed import (
    ACTION_CEILING, ACTIONS, CERTAIN_WORDS, CHECKS, DECODE_PHRASES, DECODE_PHRASES_V10,
    HEDGE_WORDS, OUTCOME_WORDS, RUBRIC_VERSION, SEVERITIES, VERDICTS,
)
from alertweft.functions.ordinal import direction, known_edges, policy_value, rank, ranked_direction
from alertweft.functions.stats import count_where
from alertweft.functions.text import any_phrase, evidence_ids, labels, str_array
from alertweft.session import merged


def package_headers(evidence: DataFrame) -> DataFrame:
    """One row per package, fully reduced before the shuffle."""
    return evidence.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("evidence_id").alias("main_id"),
    )


def known_ids(evidence: DataFrame, derivations: DataFrame, upper: bool = False) -> DataFrame:
    """Distinct (case, id) pairs a decision may cite."""
    return package_ids(evidence, derivations, upper).distinct()


def package_ids(evidence: DataFrame, derivations: DataFrame, upper: bool = False) -> DataFrame:
    """(case, id) of all evidence and derivations, copies included."""
    ids = evidence.select("case_id", "evidence_id").unionByName(
        derivations.select("case_id", F.col("derivation_id").alias("evidence_id")))
    return ids.withColumn("evidence_id", F.upper("evidence_id")) if upper else ids


def with_cited_ids(outputs: DataFrame, upper_keys: bool = False) -> DataFrame:
    """Add ``key_ids`` and ``text_ids`` (distinct) to decisions."""
    keys = F.transform("key_evidence", F.upper) if upper_keys else F.col("key_evidence")
    return outputs.withColumn("key_ids", F.array_distinct(keys)).withColumn("text_ids", evidence_ids(F.col("rationale")))


def unknown_citations(cited: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Cited ids a package does not hold, one array per decision.

    Citations are exploded and joined on (case, id), so a package with very many
    evidence rows is spread over its ids instead of being collected into a set.
    The array is bounded by what one decision cites.
    """
    flat = cited.select(*keys, F.explode(F.array_union("key_ids", "text_ids")).alias("evidence_id"))
    missing = flat.join(ids, ["case_id", "evidence_id"], "left_anti")
    return missing.groupBy(*keys).agg(F.array_sort(F.collect_set("evidence_id")).alias("unknown_ids"))


def held_citations(outputs: DataFrame, ids: DataFrame, upper_keys: bool = False) -> DataFrame:
    """(case_id, held_ids): the ids that decisions of a case cite and its package holds.

    Runs that say the same are reduced to one before their text is read, and each
    cited (case, id) meets the package once, however many runs cite it.  The array
    is bounded by what the decisions of one case cite.
    """
    said = with_cited_ids(outputs.select("case_id", "key_evidence", "rationale").distinct(), upper_keys)
    cited = said.select("case_id", F.explode(F.array_union("key_ids", "text_ids")).alias("evidence_id")).distinct()
    return cited.join(merged(ids), ["case_id", "evidence_id"], "left_semi").groupBy("case_id").agg(F.collect_set("evidence_id").alias("held_ids"))


def with_unknown_ids(joined: DataFrame, upper_keys: bool = False) -> DataFrame:
    """Add the cited ids and, from ``held_ids``, those of them the package does not hold, sorted."""
    empty = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.array_union("key_ids", "text_ids"), F.coalesce("held_ids", empty)))
    return with_cited_ids(joined, upper_keys).withColumn("unknown_ids", F.coalesce(missing, empty)).drop("held_ids")


def scored_cases(outputs: DataFrame, evidence: DataFrame, derivations: DataFrame, truth: DataFrame) -> DataFrame:
    """Decisions joined with package facts and ground truth, with the cited-id columns.

    Every join is by case and sorted, so the decisions are shuffled once and read after it,
    and the driver holds no table.
    """
    held = held_citations(outputs, package_ids(evidence, derivations))
    derived = derivations.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_derivations"))
    joined = outputs.join(merged(package_headers(evidence)), "case_id").join(merged(truth), "case_id")
    joined = joined.join(merged(derived), "case_id", "left").join(merged(held), "case_id", "left")
    return with_unknown_ids(joined).withColumn("n_derivations", F.coalesce("n_derivations", F.lit(0)))


def check_columns(scored: DataFrame) -> DataFrame:
    """Add the C1-C4 result columns of rubric 1.1.

    A verdict, severity or action that is not in its ordering has no direction,
    is named in ``unknown_values`` and fails its check.
    """
    inside = lambda field: F.coalesce(F.col(f"{field}_direction") == "in_band", F.lit(False))
    relevant = F.array_union("supporting", "counter")
    cited = F.array_union("key_ids", "text_ids")
    has_counter = F.size("counter") > 0
    bands = {"verdict": (F.array("expected_verdict"), VERDICTS), "severity": (F.col("severity_band"), SEVERITIES), "action": (F.col("action_band"), ACTIONS)}
    # ranks and edges are columns of their own: inlined where they are compared, they make methods too long to be compiled
    staged = scored.select("*", *[rank(F.col(f), o).alias(f"_{f}_at") for f, (_, o) in bands.items()],
                           *[known_edges(b, o).alias(f"_{f}_edges") for f, (b, o) in bands.items()])
    detailed = staged.select(
        "*",
        F.array_intersect("key_ids", "unknown_ids").alias("invalid_key_ids"),
        F.array_intersect("text_ids", "unknown_ids").alias("invalid_text_ids"),
        F.array_intersect("key_ids", relevant).alias("relevant_key_ids"),
        (any_phrase(F.col("rationale"), DECODE_PHRASES) & (F.col("n_derivations") == 0)).alias("decode_claim"),
        *[ranked_direction(F.col(f"_{f}_at"), F.col(f"_{f}_edges")).alias(f"{f}_direction") for f in bands],
        has_counter.alias("c3_applicable"),
        F.array_intersect("counter", cited).alias("cited_counter_ids"),
    ).drop(*[f"_{f}_{part}" for f in bands for part in ("at", "edges")])
    return detailed.select(
        "*",
        ((F.size("invalid_key_ids") == 0) & (F.size("invalid_text_ids") == 0) & (F.size("relevant_key_ids") > 0)
         & ~F.col("decode_claim")).alias("c1"),
        inside("verdict").alias("verdict_pass"),
        inside("severity").alias("severity_pass"),
        (inside("verdict") & inside("severity")).alias("c2"),
        (~F.col("c3_applicable") | (F.size("cited_counter_ids") > 0)).alias("c3"),
        inside("action").alias("c4"),
        labels([(F.col(f"{f}_direction").isNull(), f) for f in ("verdict", "severity", "action")]).alias("unknown_values"),
    )


def case_checks(outputs: DataFrame, evidence: DataFrame, derivations: DataFrame, truth: DataFrame) -> DataFrame:
    """Rubric 1.1: one row per decision with every check."""
    return check_columns(scored_cases(outputs, evidence, derivations, truth))


def failed_checks(active=CHECKS) -> Column:
    """Names of the active checks a decision fails."""
    return labels([(~F.col(c.lower()), c) for c in active])


def legacy_checks(scored: DataFrame) -> DataFrame:
    """Rubric 1.0: grounding lexicons, severity only, heeded counter evidence, one-sided action ceiling."""
    text = F.lower("rationale")
    decode = any_phrase(text, DECODE_PHRASES_V10) & (F.col("n_derivations") == 0)
    hit = over_assertion(text)
    over = (F.col("expected_verdict") != "malicious") & hit.isNotNull()
    bad_keys = F.array_intersect("key_ids", "unknown_ids")
    severity = direction(F.col("severity"), F.col("severity_band"), SEVERITIES)
    move = F.when(severity == "over", "down_rank").when(severity == "under", "up_rank").otherwise("preserve")
    cited = F.array_intersect("counter", "key_ids")
    heeded = F.col("verdict").isin("benign", "suspicious") & F.col("severity").isin("informational", "low", "medium")
    ceiling = F.create_map(*[F.lit(x) for pair in ACTION_CEILING.items() for x in pair])[F.col("condition")]
    return scored.select(
        "*",
        decode.alias("legacy_decode"), over.alias("legacy_over_assertion"), hit.alias("over_asserted"),
        ((F.size(bad_keys) == 0) & ~decode & ~over).alias("c1"),
        severity.alias("severity_direction"), move.alias("move"), (severity == "in_band").alias("c2"),
        ((F.size("counter") == 0) | ((F.size(cited) > 0) & heeded)).alias("c3"),
        (rank(F.col("action"), ACTIONS) <= rank(ceiling, ACTIONS)).alias("c4"),
        ceiling.alias("ceiling"),
    )


def over_assertion(text: Column) -> Column:
    """First outcome word claimed with certainty and without a hedge in one sentence, else null."""
    has = lambda s, words: reduce(lambda a, b: a | b, [F.contains(s, F.lit(w)) for w in words])
    sentences = F.filter(
        F.split(text, r"(?<=[.!?])\s+"),
        lambda s: has(s, OUTCOME_WORDS) & has(s, CERTAIN_WORDS) & ~has(s, HEDGE_WORDS),
    )
    first = F.get(sentences, F.lit(0))
    return F.get(F.filter(str_array(OUTCOME_WORDS), lambda w: F.contains(first, w)), F.lit(0))


def summary_aggregates(active=CHECKS) -> list[Column]:
    """Aggregate columns of the evaluation summary."""
    return [
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("verdict_pass")).alias("verdict_correct_n"),
        count_where(F.col("severity_pass")).alias("severity_in_band_n"),
        count_where(F.col("c2")).alias("joint_correct_n"),
        count_where(F.col("c3_applicable")).alias("c3_applicable_n"),
        *[count_where(~F.col(c.lower())).alias(f"{c.lower()}_failures") for c in CHECKS],
        count_where(F.size(failed_checks(active)) > 0).alias("active_flagged_n"),
    ]


def confidence_aggregates(threshold: float = 0.8) -> list[Column]:
    """Confidence summary; means of empty groups are null.  Sums run on integers of 1/10000 for exactness."""
    ok, conf = F.col("c2"), F.col("confidence")
    unit = F.bround(conf * 10000).cast("bigint")

    def mean(values: Column) -> Column:
        return F.bround(F.sum(values) / F.nullif(F.count(values), F.lit(0)) / F.lit(10000.0), 4)

    gap = (unit - F.when(ok, 10000).otherwise(0))
    return [
        F.count(F.lit(1)).alias("n"), count_where(ok).alias("correct_n"), count_where(~ok).alias("incorrect_n"),
        mean(unit).alias("mean_confidence"), mean(F.when(ok, unit)).alias("mean_correct"),
        mean(F.when(~ok, unit)).alias("mean_incorrect"),
        F.bround(F.sum(gap * gap) / F.nullif(F.count(F.lit(1)), F.lit(0)) / F.lit(1e8), 4).alias("brier"),
        count_where(~ok & (conf >= threshold)).alias("high_confidence_errors"),
    ]


def truth_errors(truth: DataFrame, evidence: DataFrame, derivations: DataFrame, ordered_bands: bool = True) -> DataFrame:
    """Ground-truth policy audit: an array of error labels per case.

    Bands compare as ordered lists, or as sets when ``ordered_bands`` is false.
    """
    ids = known_ids(evidence, derivations)
    named = truth.withColumn("named", F.array_union("supporting", "counter"))
    flat = named.select("case_id", F.explode("named").alias("evidence_id"))
    unknown = flat.join(ids, ["case_id", "evidence_id"], "left_anti").groupBy("case_id").agg(
        F.array_join(F.array_sort(F.collect_set("evidence_id")), "|").alias("unknown_ids"))
    same = (lambda a, b: a == b) if ordered_bands else (lambda a, b: F.array_sort(a) == F.array_sort(b))
    condition = F.col("condition")
    tests = [
        (F.col("rubric_version") != RUBRIC_VERSION, "version"),
        (F.col("expected_verdict") != policy_value(condition, 0), "verdict"),
        (~same(F.col("severity_band"), policy_value(condition, 1)), "severity_band"),
        (~same(F.col("action_band"), policy_value(condition, 2)), "action_band"),
        (~F.array_contains(policy_value(condition, 3), F.col("role")), "role"),
        (F.col("unknown_ids").isNotNull(), "unknown_ids"),
        (F.arrays_overlap("supporting", "counter"), "overlap"),
        (F.size("named") == 0, "no_evidence"),
    ]
    errors = labels(tests)
    return named.join(unknown, "case_id", "left").withColumn("errors", errors)


def duplicates_in(array: Column) -> Column:
    """Values occurring more than once in an array, sorted."""
    return F.array_sort(F.filter(F.array_distinct(array), lambda v: F.size(F.filter(array, lambda x: x == v)) > 1))
