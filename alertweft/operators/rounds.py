"""Comparisons across rounds, models and paired versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.fixed import ACTIONS, CHECKS, SEVERITIES, VERDICTS
from alertweft.functions.ordinal import known_edges, rank, ranked_distance
from alertweft.functions.stats import count_where, f1_from_rounded, mcnemar_exact, safe_ratio
from alertweft.functions.text import evidence_ids

FIELDS = ["verdict", "severity", "action"]
ORDERINGS = {"verdict": VERDICTS, "severity": SEVERITIES, "action": ACTIONS}
TARGETS = ["high_consequence_miscalibration", "calibration", "a4_any", "C1", "C2", "C3", "C4"]


def target_column(target: str) -> Column:
    """Oracle label of a scored decision for one comparison target."""
    calibration = ~F.col("c2") | ~F.col("c4")
    if target == "high_consequence_miscalibration":
        return calibration & F.col("action").isin("isolate", "close_benign")
    if target == "calibration":
        return calibration
    if target == "a4_any":
        return ~(F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4"))
    if target not in CHECKS:
        raise ValueError(f"unknown target {target!r}; choose from {TARGETS}")
    return ~F.col(target.lower())


def confusion(labelled: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Binary metrics of ``label`` against ``predicted`` per key; null on zero denominators.

    ``weight`` counts a row several times, for rows that are counted already.
    F1 is taken from the already rounded precision and recall.
    """
    y, p = F.col("label"), F.col("predicted")
    number = count_where if weight is None else lambda test: F.coalesce(F.sum(F.when(test, F.col(weight))), F.lit(0)).cast("bigint")
    counts = labelled.groupBy(*keys).agg(
        number(y & p).alias("tp"), number(~y & p).alias("fp"),
        number(~y & ~p).alias("tn"), number(y & ~p).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rated = counts.select(
        "*", safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(tn, tn + fp).alias("specificity"), (tp + fp).alias("deferral_n"),
        safe_ratio(tp + fp, tp + fp + tn + fn).alias("deferral_rate"),
    )
    return rated.withColumn("f1", f1_from_rounded(F.col("precision"), F.col("recall")))


def outcome_class() -> Column:
    y, p = F.col("label"), F.col("predicted")
    return F.when(y & p, "tp").when(p, "fp").when(y, "fn").otherwise("tn")


def majority(checked: DataFrame, keys: list[str]) -> DataFrame:
    """2-of-3 majority per check; cases without exactly three rounds are marked incomplete."""
    joint = F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4")
    sums = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rounds"),
        *[count_where(F.col(c.lower())).alias(f"{c.lower()}_passes") for c in CHECKS],
        count_where(joint).alias("joint_passes"),
    )
    return sums.select(*keys, *_majorities())


def _majorities() -> list[Column]:
    return [
        F.col("rounds"), (F.col("rounds") == 3).alias("complete"),
        *[(F.col(f"{c.lower()}_passes") >= 2).alias(f"{c.lower()}_majority") for c in CHECKS],
        (F.col("joint_passes") >= 2).alias("joint_majority"),
    ]


def round_patterns(checked: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`majority` with ``passes``, the sorted (round, joint) array of how many decisions of a round pass every check.

    Decisions are counted per round first, so the array has an entry per round of a case.
    """
    joint = F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4")
    sums = [f"{c.lower()}_passes" for c in CHECKS] + ["joint_passes"]
    each = checked.groupBy(*keys, "round").agg(
        F.count(F.lit(1)).alias("rounds"), *[count_where(F.col(c.lower())).alias(f"{c.lower()}_passes") for c in CHECKS], count_where(joint).alias("joint_passes"))
    whole = each.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("rounds", *sums)], F.array_sort(F.collect_list(F.struct("round", F.col("joint_passes").alias("joint")))).alias("passes"))
    return whole.select(*keys, *_majorities(), "passes")


def stability(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per case: whether each field and the whole tuple is the same in every round."""
    same = [(F.min(f) == F.max(f)).alias(f"{f}_stable") for f in FIELDS]
    grouped = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rounds"), *same)
    varied = sum((~F.col(f"{f}_stable")).cast("int") for f in FIELDS)
    return grouped.withColumn("varied", varied).withColumn("tuple_stable", varied == 0)


def by_round(runs: DataFrame, keys: list[str], rounds=(1, 2, 3)) -> DataFrame:
    """One row per case with the decision of every round side by side (no self-join)."""
    cells = [F.max(F.when(F.col("round") == r, F.struct(*FIELDS))).alias(f"r{r}") for r in rounds]
    return runs.groupBy(*keys).agg(*cells)


def with_distances(scored: DataFrame) -> DataFrame:
    """Add the signed ordinal distance of every decision field."""
    bands = {"verdict": F.array("expected_verdict"), "severity": F.col("severity_band"), "action": F.col("action_band")}
    # ranks and edges are columns of their own: inlined where they are compared, they make methods too long to be compiled
    staged = scored.select("*", *[rank(F.col(f), ORDERINGS[f]).alias(f"_{f}_at") for f in FIELDS], *[known_edges(bands[f], ORDERINGS[f]).alias(f"_{f}_edges") for f in FIELDS])
    return staged.select(*scored.columns, *[ranked_distance(F.col(f"_{f}_at"), F.col(f"_{f}_edges")).alias(f"{f}_distance") for f in FIELDS])


def distance_summary(distanced: DataFrame, keys: list[str]) -> DataFrame:
    """Ordinal-error summary per field: one narrow unpivot, then one aggregation."""
    long = distanced.select(*keys, F.inline_outer(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"{f}_distance").alias("d")) for f in FIELDS
    ])))
    n, d = F.count(F.lit(1)), F.col("d")
    return long.groupBy(*keys, "field").agg(
        n.alias("n"), count_where(d == 0).alias("in_band_n"), safe_ratio(F.count_if(d == 0), n).alias("in_band_rate"),
        safe_ratio(F.sum(d), n).alias("mean_signed"), safe_ratio(F.sum(F.abs(d)), n).alias("mean_absolute"),
        count_where(F.abs(d) >= 2).alias("severe_n"), safe_ratio(F.count_if(F.abs(d) >= 2), n).alias("severe_rate"),
    )


def paired(checked: DataFrame, left: str, right: str, fields: list[str], keys: list[str]) -> DataFrame:
    """Decisions of two models for the same case side by side; unpaired cases drop out."""
    value = lambda m: F.max(F.when(F.col("model") == m, F.struct(*fields)))
    both = checked.filter(F.col("model").isin(left, right)).groupBy(*keys).agg(value(left).alias("a"), value(right).alias("b"))
    return both.filter("a is not null and b is not null")


def discordance(pairs: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """2x2 table of a boolean field per group, with risk difference and exact McNemar p."""
    a, b = F.col(f"a.{field}"), F.col(f"b.{field}")
    counts = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), count_where(a & b).alias("both"), count_where(a & ~b).alias("a_only"),
        count_where(~a & b).alias("b_only"), count_where(~a & ~b).alias("neither"),
    )
    return counts.select(
        "*", safe_ratio(F.col("a_only") - F.col("b_only"), F.col("n_pairs")).alias("risk_difference"),
        mcnemar_exact(F.col("a_only"), F.col("b_only")).alias("mcnemar_p"),
    )


def pair_versions(versions: DataFrame, roles: tuple[str, str], keys: list[str]) -> DataFrame:
    """Both roles of a pair side by side as structs ``low`` and ``high``; incomplete pairs are reported."""
    fields = [c for c in versions.columns if c not in keys and c != "role"]
    pick = lambda role: F.max(F.when(F.col("role") == role, F.struct(*fields)))
    joined = versions.groupBy(*keys).agg(pick(roles[0]).alias("low"), pick(roles[1]).alias("high"))
    return joined.withColumn("complete", F.col("low").isNotNull() & F.col("high").isNotNull())


def _in_band(v: str) -> Column:
    return (
        F.array_contains(F.col(f"{v}.expected_verdict"), F.col(f"{v}.verdict"))
        & F.array_contains(F.col(f"{v}.severity_band"), F.col(f"{v}.severity"))
        & F.array_contains(F.col(f"{v}.action_band"), F.col(f"{v}.action"))
    )


def _deltas() -> list[Column]:
    return [rank(F.col(f"high.{f}"), ORDERINGS[f]) - rank(F.col(f"low.{f}"), ORDERINGS[f]) for f in FIELDS]


def outcome_pairs(pairs: DataFrame, added: Column) -> DataFrame:
    """Base/strong scoring: endpoint, upward movement, identity, citation of all added evidence."""
    d = _deltas()
    cited = F.array_union(evidence_ids(F.col("high.rationale"), ignore_case=False), F.col("high.key_evidence"))
    complete = pairs.filter("complete")
    return complete.select(
        "*", _in_band("low").alias("low_in_band"), _in_band("high").alias("high_in_band"),
        (_in_band("low") & _in_band("high")).alias("endpoint_met"),
        ((F.greatest(*d) > 0) & (F.least(*d) >= 0)).alias("directional"),
        ((F.greatest(*d) == 0) & (F.least(*d) == 0)).alias("identical"),
        F.when(F.size(added) > 0, F.size(F.array_except(added, cited)) == 0).alias("cites_added"),
        F.bround(F.col("high.confidence") - F.col("low.confidence"), 3).alias("confidence_delta"),
    )


def context_pairs(pairs: DataFrame, terms: list[str]) -> DataFrame:
    """Weak/counter scoring with the six-way result, first matching rule wins."""
    d = _deltas()
    no_reversal, changed = F.greatest(*d) <= 0, (F.greatest(*d) != 0) | (F.least(*d) != 0)
    weak_ok, counter_ok = _in_band("low"), _in_band("high")
    rationale = F.lower(F.coalesce(F.col("high.rationale"), F.lit("")))
    mention = F.lit(False)
    for term in terms:
        mention = mention | F.contains(rationale, F.lit(term.lower()))
    result = (
        F.when(weak_ok & counter_ok & no_reversal & changed & mention, "correct_transition")
        .when(~changed, "no_response").when(~no_reversal, "reversed_or_mixed_response")
        .when(counter_ok & ~weak_ok, "counter_correct_weak_miscall")
        .when(weak_ok & ~counter_ok, "weak_correct_counter_not_downranked").otherwise("target_miss")
    )
    return pairs.filter("complete").select(
        "*", weak_ok.alias("low_in_band"), counter_ok.alias("high_in_band"),
        (weak_ok & counter_ok & no_reversal & changed).alias("endpoint_met"), changed.alias("changed"),
        (no_reversal & changed).alias("directional"), mention.alias("context_mentioned"), result.alias("result"),
        F.bround(F.col("high.confidence") - F.col("low.confidence"), 4).alias("confidence_delta"),
    )
