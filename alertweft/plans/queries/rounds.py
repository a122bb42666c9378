"""AGG-12..22/26..28/33/34/37, JN-04..07, CHK-26..28/34, SET-02, WIN-11, SCL-19: rounds, models and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweft.functions.ordinal import policy_value
from alertweft.functions.stats import count_where, mcnemar_exact, safe_ratio, wilson
from alertweft.operators import gate as G, rounds as P, scoring as S
from alertweft.operators.inference import bootstrap_mean_ci
from alertweft.plans.adapters import MODELS, _case_of, _sql_list, add_view
from alertweft.plans.queries.gate import _wilson_sql
from alertweft.plans.queries.scoring import _CHK, _IDS, _dist_sql, ACTIONS, SEVERITIES, VERDICTS
from alertweft.plans.registry import query

RUN_KEYS = ["case_id", "model", "round"]
GM, CM = MODELS


def run_checks(lake):
    return S.case_checks(lake.runs(), lake.evidence(), lake.derivations(), lake.truth())


add_view("scr", f"""
    SELECT r.*, gt.* EXCLUDE (case_id), v.ids, d.case_id IS NOT NULL AS has_derivation, {_IDS} AS text_ids
    FROM run r JOIN gt USING (case_id) JOIN valid v USING (case_id) LEFT JOIN der d USING (case_id)
    WHERE r.case_id IN (SELECT case_id FROM pkg)""", "run gt valid der pkg")
add_view("chkr", _CHK % "scr", "scr")
_ALL = "(c1 AND c2 AND c3 AND c4)"


def _n(cond):
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


add_view("maj", f"""SELECT model, split, case_id, CAST(count(*) AS BIGINT) AS rounds, count(*) = 3 AS complete,
    {', '.join(f"count(*) FILTER (WHERE c{i}) >= 2 AS c{i}_majority" for i in range(1, 5))},
    count(*) FILTER (WHERE {_ALL}) >= 2 AS joint_majority FROM chkr GROUP BY model, split, case_id""", "chkr")


def majorities(lake):
    return P.majority(run_checks(lake), ["model", "split", "case_id"])


@query("agg_12", "maj", "SELECT * FROM maj")
def agg_12(lake):
    return majorities(lake)


@query("agg_13", "chkr maj", f"""
    WITH r AS (SELECT model, split, round, {_n(_ALL)} AS passes FROM chkr GROUP BY 1, 2, 3),
    s AS (SELECT model, split, round_even(avg(passes), 4) AS mean_passes, min(passes) AS min_passes, max(passes) AS max_passes FROM r GROUP BY 1, 2),
    m AS (SELECT model, split, {', '.join(f'{_n(f"NOT c{i}_majority")} AS c{i}_majority_failures' for i in range(1, 5))}, {_n('joint_majority')} AS joint_majority_n FROM maj GROUP BY 1, 2)
    SELECT * FROM s JOIN m USING (model, split)""")
def agg_13(lake):
    """Spread and majorities from one pass: cases are counted by their majorities and what passed in each round before these are unfolded."""
    flags, unit = [*[f"c{i}_majority" for i in range(1, 5)], "joint_majority"], ["model", "split"]
    patterns = P.round_patterns(run_checks(lake), [*unit, "case_id"]).groupBy(*unit, *flags, "passes").agg(F.count(F.lit(1)).alias("cases"))
    passes = patterns.select(*unit, "cases", F.inline_outer("passes")).groupBy(*unit, "round").agg(F.sum(F.col("cases") * F.col("joint")).alias("passes"))
    spread = passes.groupBy(*unit).agg(
        F.bround(F.avg("passes"), 4).alias("mean_passes"), F.min("passes").alias("min_passes"), F.max("passes").alias("max_passes"))
    number = lambda test: F.coalesce(F.sum(F.when(test, F.col("cases"))), F.lit(0)).cast("bigint")
    failures = patterns.groupBy(*unit).agg(
        *[number(~F.col(f"c{i}_majority")).alias(f"c{i}_majority_failures") for i in range(1, 5)],
        number(F.col("joint_majority")).alias("joint_majority_n"))
    return spread.join(failures, unit)


add_view("dist", f"""SELECT r.case_id, r.model, r.round, r.split, gt.condition, r.verdict, r.severity, r.action,
    {_dist_sql('r.verdict', '[expected_verdict]', VERDICTS)} AS verdict_distance, {_dist_sql('r.severity', 'severity_band', SEVERITIES)} AS severity_distance,
    {_dist_sql('r.action', 'action_band', ACTIONS)} AS action_distance FROM run r JOIN gt USING (case_id)""", "run gt")
add_view("distl", """SELECT model, split, round, condition, case_id, f.field, CASE f.field WHEN 'verdict' THEN verdict_distance WHEN 'severity' THEN severity_distance ELSE action_distance END AS d
    FROM dist, (VALUES ('verdict'), ('severity'), ('action')) f(field)""", "dist")


def distances(lake):
    return P.with_distances(lake.runs().join(lake.truth(), "case_id"))


@query("agg_14", "distl", f"""
    SELECT model, split, round, field, CAST(count(*) AS BIGINT) AS n, {_n('d = 0')} AS in_band_n,
           round_even(count(*) FILTER (WHERE d = 0)::DOUBLE / count(*), 4) AS in_band_rate, round_even(sum(d)::DOUBLE / count(*), 4) AS mean_signed,
           round_even(sum(abs(d))::DOUBLE / count(*), 4) AS mean_absolute, {_n('abs(d) >= 2')} AS severe_n,
           round_even(count(*) FILTER (WHERE abs(d) >= 2)::DOUBLE / count(*), 4) AS severe_rate FROM distl GROUP BY model, split, round, field""")
def agg_14(lake):
    return P.distance_summary(distances(lake), ["model", "split", "round"])


def unit_rates(lake, keys):
    c, d = run_checks(lake), P.with_distances
    joint = F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4")
    severe = F.greatest(*[F.abs(f"{f}_distance") for f in P.FIELDS]) >= 2
    n = F.count(F.lit(1))
    return d(c).groupBy(*keys).agg(
        n.alias("n"), count_where(F.col("c2")).alias("c2_n"), safe_ratio(F.count_if(F.col("c2")), n).alias("c2_rate"),
        count_where(joint).alias("a4_n"), safe_ratio(F.count_if(joint), n).alias("a4_rate"),
        count_where(severe).alias("severe_n"), safe_ratio(F.count_if(severe), n).alias("severe_rate"))


_UNIT = f"""CAST(count(*) AS BIGINT) AS n, {_n('c2')} AS c2_n, round_even(count(*) FILTER (WHERE c2)::DOUBLE / count(*), 4) AS c2_rate,
    {_n(_ALL)} AS a4_n, round_even(count(*) FILTER (WHERE {_ALL})::DOUBLE / count(*), 4) AS a4_rate,
    {_n('sev')} AS severe_n, round_even(count(*) FILTER (WHERE sev)::DOUBLE / count(*), 4) AS severe_rate"""
add_view("unit", """SELECT c.model, c.split, c.round, c.condition, c1, c2, c3, c4, greatest(abs(verdict_distance), abs(severity_distance), abs(action_distance)) >= 2 AS sev
    FROM chkr c JOIN dist USING (case_id, model, round)""", "chkr dist")


@query("agg_15", "unit", f"SELECT model, split, round, {_UNIT} FROM unit GROUP BY model, split, round")
def agg_15(lake):
    return unit_rates(lake, ["model", "split", "round"])


@query("agg_16", "unit", f"""
    WITH c AS (SELECT model, split, round, condition, {_UNIT} FROM unit GROUP BY model, split, round, condition)
    SELECT model, split, round, round_even(sum(CAST(round(c2_rate * 10000) AS BIGINT))::DOUBLE / count(*), 0) / 10000.0 AS macro_c2_rate,
           round_even(sum(CAST(round(a4_rate * 10000) AS BIGINT))::DOUBLE / count(*), 0) / 10000.0 AS macro_a4_rate, CAST(count(*) AS BIGINT) AS conditions
    FROM c GROUP BY model, split, round""")
def agg_16(lake):
    """Macro average: unweighted mean of the rounded condition rates."""
    rates = unit_rates(lake, ["model", "split", "round", "condition"])
    tenth = lambda c: F.sum(F.round(F.col(c) * 10000).cast("bigint"))
    n = F.count(F.lit(1))
    return rates.groupBy("model", "split", "round").agg(
        (F.bround(tenth("c2_rate") / n, 0) / F.lit(10000.0)).alias("macro_c2_rate"),
        (F.bround(tenth("a4_rate") / n, 0) / F.lit(10000.0)).alias("macro_a4_rate"), n.alias("conditions"))


@query("agg_16_breakdown", "unit", f"""SELECT model, split, round, condition, {_UNIT} FROM unit GROUP BY model, split, round, condition""")
def agg_16_breakdown(lake):
    return unit_rates(lake, ["model", "split", "round", "condition"])


@query("agg_17", "unit", f"""
    SELECT model, split, round, {_wilson_sql('count(*) FILTER (WHERE c2)', 'count(*)', False)} AS c2_low,
           {_wilson_sql('count(*) FILTER (WHERE c2)', 'count(*)', True)} AS c2_high FROM unit GROUP BY model, split, round""")
def agg_17(lake):
    rates = unit_rates(lake, ["model", "split", "round"])
    return rates.select("model", "split", "round", wilson(F.col("c2_n"), F.col("n"), False).alias("c2_low"),
                        wilson(F.col("c2_n"), F.col("n"), True).alias("c2_high"))


add_view("pair", f"""SELECT a.case_id, a.split, a.c2 AS a, b.c2 AS b, a.c1 AND a.c2 AND a.c3 AND a.c4 AS a4_a, b.c1 AND b.c2 AND b.c3 AND b.c4 AS a4_b, a.condition
    FROM chkr a JOIN chkr b USING (case_id, round) WHERE a.model = '{GM}' AND b.model = '{CM}' AND round = 1""", "chkr")


def model_pairs(lake, fields=("c2",)):
    return P.paired(run_checks(lake).filter("round = 1"), GM, CM, list(fields), ["case_id", "split"])


@query("agg_18", "pair", """
    WITH g AS (SELECT split, count(*) AS n_pairs, count(*) FILTER (WHERE a AND b) AS both_, count(*) FILTER (WHERE a AND NOT b) AS b_,
        count(*) FILTER (WHERE NOT a AND b) AS c_, count(*) FILTER (WHERE NOT a AND NOT b) AS neither_ FROM pair GROUP BY split),
    t AS (SELECT *, CASE WHEN b_ + c_ = 0 THEN 1.0 ELSE least(1.0, 2 * (
        SELECT sum(exp(lgamma(b_ + c_ + 1) - lgamma(k + 1) - lgamma(b_ + c_ - k + 1) + (b_ + c_) * ln(0.5)))
        FROM range(0, (SELECT count(*) FROM pair)) r(k) WHERE k <= least(b_, c_))) END AS p FROM g)
    SELECT split, n_pairs, both_ AS "both", b_ AS a_only, c_ AS b_only, neither_ AS neither,
        round_even((b_ - c_) / n_pairs::DOUBLE, 4) AS risk_difference, round_even(p, 6) AS mcnemar_p FROM t""")
def agg_18(lake):
    """Discordance table, risk difference and exact McNemar p of each split, over all its pairs."""
    return P.discordance(model_pairs(lake), "c2", ["split"])


@query("agg_19")
def agg_19(lake):
    """Bootstrap interval of the mean signed distance per unit and field, 20,000 draws."""
    unit = ["model", "split", "round"]
    # decisions are counted by what they say and what was expected, before any distance is taken
    counted = lake.runs().join(lake.truth(), "case_id").groupBy(*unit, *P.FIELDS, "expected_verdict", "severity_band", "action_band").agg(F.count(F.lit(1)).alias("cases"))
    long = P.with_distances(counted).select(*unit, "cases", F.inline_outer(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"{f}_distance").alias("d")) for f in P.FIELDS])))
    return bootstrap_mean_ci(long, [*unit, "field"], "d", weight="cases")


@query("agg_20", "pair", f"""
    SELECT split, CAST(count(*) AS BIGINT) AS n_pairs, {_n('a AND NOT b')} AS a_only, {_n('NOT a AND b')} AS b_only,
           round_even((count(*) FILTER (WHERE a AND NOT b) - count(*) FILTER (WHERE NOT a AND b))::DOUBLE / count(*), 4) AS risk_difference FROM pair GROUP BY split""")
def agg_20(lake):
    pairs = model_pairs(lake)
    a, b, n = F.col("a.c2"), F.col("b.c2"), F.count(F.lit(1))
    return pairs.groupBy("split").agg(
        n.alias("n_pairs"), count_where(a & ~b).alias("a_only"), count_where(~a & b).alias("b_only"),
        safe_ratio(F.count_if(a & ~b) - F.count_if(~a & b), n).alias("risk_difference"))


@query("agg_20_distance", "dist", f"""
    WITH p AS (SELECT a.split, f.field, abs(CASE f.field WHEN 'verdict' THEN a.verdict_distance WHEN 'severity' THEN a.severity_distance ELSE a.action_distance END)
        - abs(CASE f.field WHEN 'verdict' THEN b.verdict_distance WHEN 'severity' THEN b.severity_distance ELSE b.action_distance END) AS d
        FROM dist a JOIN dist b USING (case_id, round), (VALUES ('verdict'), ('severity'), ('action')) f(field)
        WHERE a.model = '{GM}' AND b.model = '{CM}' AND round = 1)
    SELECT split, field, round_even(sum(d)::DOUBLE / count(*), 4) AS mean_difference, median(d)::DOUBLE AS median_difference FROM p GROUP BY split, field""")
def agg_20_distance(lake):
    """Mean and median of the paired absolute-distance differences."""
    fields = [f"{f}_distance" for f in P.FIELDS]
    pairs = P.paired(distances(lake).filter("round = 1"), GM, CM, fields, ["case_id", "split"])
    long = pairs.select("split", F.inline_outer(F.array(*[
        F.struct(F.lit(f).alias("field"), (F.abs(f"a.{f}_distance") - F.abs(f"b.{f}_distance")).alias("d")) for f in P.FIELDS])))
    return long.groupBy("split", "field").agg(
        safe_ratio(F.sum("d"), F.count(F.lit(1))).alias("mean_difference"), F.median("d").cast("double").alias("median_difference"))


@query("agg_20_discordant", "pair", "SELECT case_id, CASE WHEN a THEN 'a_only' ELSE 'b_only' END AS side FROM pair WHERE a <> b")
def agg_20_discordant(lake):
    return model_pairs(lake).filter("a.c2 <> b.c2").select("case_id", F.when(F.col("a.c2"), "a_only").otherwise("b_only").alias("side"))


add_view("stab", """SELECT model, split, case_id, count(*) AS rounds, min(verdict) = max(verdict) AS v, min(severity) = max(severity) AS s, min(action) = max(action) AS a
    FROM run GROUP BY model, split, case_id""", "run")


@query("agg_21", "stab", f"""
    SELECT model, split, CAST(count(*) AS BIGINT) AS n, {_n('v')} AS verdict_n, {_n('s')} AS severity_n, {_n('a')} AS action_n, {_n('v AND s AND a')} AS tuple_n,
           {_n('(NOT v)::INT + (NOT s)::INT + (NOT a)::INT = 1')} AS one_field_n, {_n('(NOT v)::INT + (NOT s)::INT + (NOT a)::INT > 1')} AS multi_field_n,
           round_even(count(*) FILTER (WHERE v AND s AND a)::DOUBLE / count(*), 4) AS tuple_rate FROM stab GROUP BY model, split""")
def agg_21(lake):
    n = F.count(F.lit(1))
    return P.stability(lake.runs(), ["model", "split", "case_id"]).groupBy("model", "split").agg(
        n.alias("n"), *[count_where(F.col(f"{f}_stable")).alias(f"{f}_n") for f in P.FIELDS], count_where(F.col("tuple_stable")).alias("tuple_n"),
        count_where(F.col("varied") == 1).alias("one_field_n"), count_where(F.col("varied") > 1).alias("multi_field_n"),
        safe_ratio(F.count_if(F.col("tuple_stable")), n).alias("tuple_rate"))


@query("agg_21_flips", "run", """
    SELECT model, case_id, string_agg('r' || round || ':' || verdict || '/' || severity || '/' || action, ' ' ORDER BY round) AS decisions
    FROM run GROUP BY model, case_id HAVING min(verdict) <> max(verdict) OR min(severity) <> max(severity) OR min(action) <> max(action)""")
def agg_21_flips(lake):
    side = P.by_round(lake.runs(), ["model", "case_id"])
    text = [F.concat(F.lit(f"r{r}:"), F.concat_ws("/", *[f"r{r}.{f}" for f in P.FIELDS])) for r in (1, 2, 3)]
    return side.filter("r1 <> r2 or r1 <> r3").select("model", "case_id", F.concat_ws(" ", *text).alias("decisions"))


@query("agg_22", "run", """
    SELECT a.model, 'round_' || a.round || '_vs_' || b.round AS pair, round_even(avg((a.verdict = b.verdict)::INT), 4) AS verdict,
           round_even(avg((a.severity = b.severity)::INT), 4) AS severity, round_even(avg((a.action = b.action)::INT), 4) AS action,
           round_even(avg((a.verdict = b.verdict AND a.severity = b.severity AND a.action = b.action)::INT), 4) AS tuple
    FROM run a JOIN run b ON a.case_id = b.case_id AND a.model = b.model AND a.round < b.round GROUP BY a.model, a.round, b.round""")
def agg_22(lake):
    """Pairwise agreement from one side-by-side aggregation instead of three self-joins."""
    side = P.by_round(lake.runs(), ["model", "case_id"])
    rows = F.array(*[
        F.struct(F.lit(f"round_{x}_vs_{y}").alias("pair"), *[(F.col(f"r{x}.{f}") == F.col(f"r{y}.{f}")).alias(f) for f in P.FIELDS])
        for x, y in ((1, 2), (1, 3), (2, 3))])
    long, n = side.select("model", F.inline_outer(rows)), F.count(F.lit(1))
    return long.groupBy("model", "pair").agg(
        *[safe_ratio(F.count_if(F.col(f)), n).alias(f) for f in P.FIELDS],
        safe_ratio(F.count_if(F.col("verdict") & F.col("severity") & F.col("action")), n).alias("tuple"))


def run_routes(lake):
    return G.decide(G.gate_inputs(lake.runs(), lake.evidence(), lake.derivations(), lake.declared()))


@query("agg_26", "chkr gr", f"""
    SELECT c.model, c.split, c.round, CAST(count(*) AS BIGINT) AS n, {_n(_ALL)} AS a4_pass_n,
           {_n("c.severity_direction = 'over'")} AS severity_over_n, {_n("c.severity_direction = 'under'")} AS severity_under_n,
           {_n("g.status = 'pass'")} AS runtime_pass_n, {_n("g.status = 'block'")} AS runtime_block_n, {_n(f"g.status = 'pass' AND NOT {_ALL}")} AS pass_but_fails_n
    FROM chkr c JOIN gr g ON c.case_id = g.case_id AND c.model = g.model AND c.round = g.round AND g.profile = 'consequence_gate'
    GROUP BY GROUPING SETS ((c.model, c.split, c.round), (c.model), ())""")
def agg_26(lake):
    """Dashboard counts per model, split and round with model and grand totals."""
    joint = F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4")
    runs = lake.runs()
    checked = run_checks(lake).select(*runs.columns, joint.alias("joint"), "severity_direction")
    decided = G.decide(G.gate_inputs(checked, lake.evidence(), lake.derivations(), lake.declared(), citing=runs))
    both = G.routed(decided, "model", "split", "round", "joint", "severity_direction").filter("profile = 'consequence_gate'")
    joint = F.col("joint")
    return both.groupingSets([["model", "split", "round"], ["model"], []], "model", "split", "round").agg(
        F.count(F.lit(1)).alias("n"), count_where(joint).alias("a4_pass_n"),
        count_where(F.col("severity_direction") == "over").alias("severity_over_n"), count_where(F.col("severity_direction") == "under").alias("severity_under_n"),
        count_where(F.col("status") == "pass").alias("runtime_pass_n"), count_where(F.col("status") == "block").alias("runtime_block_n"),
        count_where((F.col("status") == "pass") & ~joint).alias("pass_but_fails_n"))


@query("agg_27", "gr", f"""
    SELECT split, model, profile, CAST(count(*) AS BIGINT) AS n, {_n("status = 'pass'")} AS pass_n, {_n("status = 'review'")} AS review_n, {_n("status = 'block'")} AS block_n
    FROM gr WHERE round = 1 GROUP BY split, model, profile""")
def agg_27(lake):
    first = lake.runs().filter("round = 1")
    routes = G.routed(G.decide(G.gate_inputs(first, lake.evidence(), lake.derivations(), lake.declared())), "model", "split")
    return routes.groupBy("split", "model", "profile").agg(
        F.count(F.lit(1)).alias("n"), *[count_where(F.col("status") == s).alias(f"{s}_n") for s in ("pass", "review", "block")])


@query("agg_28", "pair", f"""
    SELECT condition, {_n('a4_a AND a4_b')} AS both_n, {_n('a4_a AND NOT a4_b')} AS a_only_n, {_n('NOT a4_a AND a4_b')} AS b_only_n, {_n('NOT a4_a AND NOT a4_b')} AS neither_n,
           round_even(count(*) FILTER (WHERE a4_a)::DOUBLE / count(*), 4) AS a_rate, round_even(count(*) FILTER (WHERE a4_b)::DOUBLE / count(*), 4) AS b_rate,
           round_even(100.0 * (count(*) FILTER (WHERE a4_b) - count(*) FILTER (WHERE a4_a))::DOUBLE / count(*), 1) AS difference_pp FROM pair GROUP BY condition""")
def agg_28(lake):
    joint = F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4")
    checked = run_checks(lake).filter("round = 1").withColumn("a4", joint)
    pairs = P.paired(checked, GM, CM, ["a4"], ["case_id", "condition"])
    a, b, n = F.col("a.a4"), F.col("b.a4"), F.count(F.lit(1))
    return pairs.groupBy("condition").agg(
        count_where(a & b).alias("both_n"), count_where(a & ~b).alias("a_only_n"), count_where(~a & b).alias("b_only_n"),
        count_where(~a & ~b).alias("neither_n"), safe_ratio(F.count_if(a), n).alias("a_rate"), safe_ratio(F.count_if(b), n).alias("b_rate"),
        F.bround(F.lit(100.0) * (F.count_if(b) - F.count_if(a)) / n, 1).alias("difference_pp"))


@query("agg_37", "stab", """
    SELECT model, split, CAST(count(*) FILTER (WHERE v AND s AND a) AS BIGINT) AS agreement_n, CAST(count(*) AS BIGINT) AS n,
           CASE WHEN count(*) FILTER (WHERE v AND s AND a) * 21 >= count(*) * 20 THEN 1 ELSE 3 END AS heldout_runs FROM stab GROUP BY model, split""")
def agg_37(lake):
    """Repeat gate: agreement of at least 20 in 21 allows a single held-out run."""
    stable = P.stability(lake.runs(), ["model", "split", "case_id"]).groupBy("model", "split").agg(
        count_where(F.col("tuple_stable")).alias("agreement_n"), F.count(F.lit(1)).alias("n"))
    return stable.withColumn("heldout_runs", F.when(F.col("agreement_n") * 21 >= F.col("n") * 20, 1).otherwise(3))


def partial_runs(lake):
    """Runs with seeded holes: round 3 misses some cases and one round has another condition."""
    k = F.col("case_id")
    runs = lake.runs().filter(~((k % 29 == 0) & (F.col("round") == 3)))
    return runs.join(lake.truth().select("case_id", "condition"), "case_id").withColumn(
        "condition", F.when((k % 31 == 0) & (F.col("round") == 2), "weak").otherwise(F.col("condition")))


add_view("prun", """SELECT run.*, CASE WHEN run.case_id % 31 = 0 AND run.round = 2 THEN 'weak' ELSE gt.condition END AS condition
    FROM run JOIN gt USING (case_id) WHERE NOT (run.case_id % 29 = 0 AND run.round = 3)""", "run gt")


@query("jn_04", "prun", """
    SELECT model, case_id, CAST(count(DISTINCT round) AS BIGINT) AS rounds, CAST(count(DISTINCT condition) AS BIGINT) AS conditions
    FROM prun GROUP BY model, case_id HAVING count(DISTINCT round) <> 3 OR count(DISTINCT condition) <> 1""")
def jn_04(lake):
    """Cases that are not aligned over the rounds; condition equality is min = max, so one aggregation does."""
    r = F.col("round")
    return partial_runs(lake).groupBy("model", "case_id").agg(
        sum(F.max((r == i).cast("bigint")) for i in (1, 2, 3)).alias("rounds"), F.count_distinct("condition").alias("conditions")
    ).filter("rounds <> 3 or conditions <> 1")


@query("jn_05", "run", f"""SELECT a.case_id, a.verdict AS verdict_a, b.verdict AS verdict_b, a.action AS action_a, b.action AS action_b
    FROM run a JOIN run b USING (case_id, round) WHERE a.model = '{GM}' AND b.model = '{CM}' AND round = 1 AND a.split = 'heldout'""")
def jn_05(lake):
    runs = lake.runs().filter("round = 1 and split = 'heldout'")
    return P.paired(runs, GM, CM, ["verdict", "action"], ["case_id"]).select(
        "case_id", F.col("a.verdict").alias("verdict_a"), F.col("b.verdict").alias("verdict_b"),
        F.col("a.action").alias("action_a"), F.col("b.action").alias("action_b"))


def versions(lake, low: str, high: str):
    """Two roles per pair: even cases are the low version, odd cases the high one."""
    role = F.when(F.col("case_id") % 2 == 0, low).otherwise(high)
    condition = {"base": "weak", "strong": "strong", "weak": "weak", "counter": "counter"}
    cond = F.create_map(*[F.lit(x) for p in condition.items() for x in p])[role]
    return lake.runs().select(
        F.floor(F.col("case_id") / 2).alias("pair_id"), "model", "round", role.alias("role"), "verdict", "severity", "action", "confidence",
        "key_evidence", "rationale", policy_value(cond, 0).alias("ev"), policy_value(cond, 1).alias("severity_band"), policy_value(cond, 2).alias("action_band"),
    ).withColumn("expected_verdict", F.array("ev")).drop("ev")


PAIR_KEYS = ["pair_id", "model", "round"]


def outcome_scores(lake):
    added = F.array(F.lit("EV-001"), F.lit("A0"))
    return P.outcome_pairs(P.pair_versions(versions(lake, "base", "strong"), ("base", "strong"), PAIR_KEYS), added)


TERMS = ["adds context", "Benign"]


def context_scores(lake):
    return P.context_pairs(P.pair_versions(versions(lake, "weak", "counter"), ("weak", "counter"), PAIR_KEYS), TERMS)


def _rank(f):
    return {"verdict": VERDICTS, "severity": SEVERITIES, "action": ACTIONS}[f]


add_view("pv", f"""SELECT l.case_id // 2 AS pair_id, l.model, l.round, {', '.join(f"l.{f} AS l_{f}, h.{f} AS h_{f}, list_position({_sql_list(_rank(f))}, h.{f}) - list_position({_sql_list(_rank(f))}, l.{f}) AS d_{f}" for f in ('verdict', 'severity', 'action'))},
    h.rationale AS h_rationale, h.key_evidence AS h_key, l.confidence AS l_conf, h.confidence AS h_conf
    FROM run l JOIN run h ON h.case_id = l.case_id + 1 AND h.model = l.model AND h.round = l.round WHERE l.case_id % 2 = 0""", "run")


def _band_sql(side, condition):
    return (f"({side}_verdict = {_case_of(repr(condition), 0)} AND list_contains({_case_of(repr(condition), 1)}, {side}_severity) "
            f"AND list_contains({_case_of(repr(condition), 2)}, {side}_action))")


_CITED_EXACT = r"list_concat(regexp_extract_all(h_rationale, '\b(A0|EV-\d{3}|DER-\d{3})\b', 1), h_key)"
add_view("op", f"""SELECT *, {_band_sql('l', 'weak')} AS low_in_band, {_band_sql('h', 'strong')} AS high_in_band,
    {_band_sql('l', 'weak')} AND {_band_sql('h', 'strong')} AS endpoint_met,
    greatest(d_verdict, d_severity, d_action) > 0 AND least(d_verdict, d_severity, d_action) >= 0 AS directional,
    d_verdict = 0 AND d_severity = 0 AND d_action = 0 AS identical, list_has_all({_CITED_EXACT}, ['EV-001', 'A0']) AS cites_added,
    round_even(h_conf - l_conf, 3) AS confidence_delta FROM pv""", "pv")
_MENTION = "(contains(lower(h_rationale), 'adds context') OR contains(lower(h_rationale), 'benign'))"
_NOREV, _CHANGED = "greatest(d_verdict, d_severity, d_action) <= 0", "(d_verdict <> 0 OR d_severity <> 0 OR d_action <> 0)"
add_view("cp", f"""SELECT *, CASE WHEN w AND c AND norev AND chg AND men THEN 'correct_transition' WHEN NOT chg THEN 'no_response' WHEN NOT norev THEN 'reversed_or_mixed_response'
      WHEN c AND NOT w THEN 'counter_correct_weak_miscall' WHEN w AND NOT c THEN 'weak_correct_counter_not_downranked' ELSE 'target_miss' END AS result,
      w AND c AND norev AND chg AS endpoint_met, norev AND chg AS directional
    FROM (SELECT *, {_band_sql('l', 'weak')} AS w, {_band_sql('h', 'counter')} AS c, {_NOREV} AS norev, {_CHANGED} AS chg, {_MENTION} AS men FROM pv)""", "pv")


@query("chk_26", "op", "SELECT pair_id, model, round, low_in_band, high_in_band, endpoint_met, directional, identical, cites_added, confidence_delta FROM op")
def chk_26(lake):
    return outcome_scores(lake).select(*PAIR_KEYS, "low_in_band", "high_in_band", "endpoint_met", "directional", "identical", "cites_added", "confidence_delta")


@query("chk_27", "cp", "SELECT pair_id, model, round, endpoint_met, chg AS changed, directional, men AS context_mentioned, result FROM cp")
def chk_27(lake):
    return context_scores(lake).select(*PAIR_KEYS, "endpoint_met", "changed", "directional", "context_mentioned", "result")


@query("agg_33", "cp", f"SELECT model, round, result, CAST(count(*) AS BIGINT) AS pairs, {_n('endpoint_met')} AS endpoint_n FROM cp GROUP BY model, round, result")
def agg_33(lake):
    return context_scores(lake).groupBy("model", "round", "result").agg(
        F.count(F.lit(1)).alias("pairs"), count_where(F.col("endpoint_met")).alias("endpoint_n"))


@query("scl_19", "pv", "SELECT pair_id, model, round, round_even(h_conf - l_conf, 3) AS delta3, round_even(h_conf - l_conf, 4) AS delta4 FROM pv")
def scl_19(lake):
    pairs = P.pair_versions(versions(lake, "weak", "counter"), ("weak", "counter"), PAIR_KEYS).filter("complete")
    delta = F.col("high.confidence") - F.col("low.confidence")
    return pairs.select(*PAIR_KEYS, F.bround(delta, 3).alias("delta3"), F.bround(delta, 4).alias("delta4"))


@query("jn_07", "run", """
    SELECT case_id // 2 AS pair_id, CASE WHEN bool_or(case_id % 2 = 0) THEN '' ELSE 'weak' END || CASE WHEN bool_or(case_id % 2 = 1) THEN '' ELSE 'counter' END AS missing_roles
    FROM run WHERE case_id % 33 <> 0 AND round = 1 AND model LIKE 'gemini%' GROUP BY 1 HAVING count(*) < 2""")
def jn_07(lake):
    """Incomplete pairs with the role that is missing (holes are seeded)."""
    part = versions(lake, "weak", "counter").filter(f"round = 1 and model = '{GM}'").filter(
        "(pair_id * 2 + if(role = 'weak', 0, 1)) % 33 <> 0")
    pairs = P.pair_versions(part, ("weak", "counter"), ["pair_id"]).filter("not complete")
    return pairs.select("pair_id", F.concat(F.when(F.col("low").isNull(), "weak").otherwise(""), F.when(F.col("high").isNull(), "counter").otherwise("")).alias("missing_roles"))


@query("jn_07_cells", "run", """
    SELECT case_id // 2 AS pair_id, model, round, CASE WHEN bool_or(case_id % 2 = 0) THEN '' ELSE 'weak' END || CASE WHEN bool_or(case_id % 2 = 1) THEN '' ELSE 'counter' END AS missing_roles
    FROM run WHERE (case_id + round) % 33 <> 0 GROUP BY 1, 2, 3 HAVING count(*) < 2""")
def jn_07_cells(lake):
    """Incomplete pairs of every model and round; each round lacks others."""
    part = versions(lake, "weak", "counter").filter("(pair_id * 2 + if(role = 'weak', 0, 1) + round) % 33 <> 0")
    pairs = P.pair_versions(part, ("weak", "counter"), PAIR_KEYS).filter("not complete")
    return pairs.select(*PAIR_KEYS, F.concat(F.when(F.col("low").isNull(), "weak").otherwise(""), F.when(F.col("high").isNull(), "counter").otherwise("")).alias("missing_roles"))


def treatment(lake):
    """Control = round 1, treatment = round 2, both with their outcome-pair scores."""
    scores = outcome_scores(lake)
    pick = lambda r: F.max(F.when(F.col("round") == r, F.struct(
        "endpoint_met", "directional", F.struct(*[f"low.{f}" for f in P.FIELDS]).alias("base"), F.struct(*[f"high.{f}" for f in P.FIELDS]).alias("strong"))))
    return scores.groupBy("pair_id", "model").agg(pick(1).alias("control"), pick(2).alias("treated"))


@query("jn_06", "pv", """
    SELECT a.pair_id, a.model, concat_ws('|', CASE WHEN (a.l_verdict, a.l_severity, a.l_action) <> (b.l_verdict, b.l_severity, b.l_action) THEN 'base' END,
           CASE WHEN (a.h_verdict, a.h_severity, a.h_action) <> (b.h_verdict, b.h_severity, b.h_action) THEN 'strong' END) AS changed_roles
    FROM pv a JOIN pv b USING (pair_id, model) WHERE a.round = 1 AND b.round = 2""")
def jn_06(lake):
    changed = [F.when(F.col(f"control.{r}") != F.col(f"treated.{r}"), F.lit(r)) for r in ("base", "strong")]
    return treatment(lake).select("pair_id", "model", F.concat_ws("|", *changed).alias("changed_roles"))


@query("chk_28", "op", f"""
    SELECT a.model, CAST(count(*) AS BIGINT) AS pairs, {_n('a.endpoint_met')} AS control_endpoint_n, {_n('b.endpoint_met')} AS treatment_endpoint_n,
           {_n('a.directional')} AS control_direction_n, {_n('b.directional')} AS treatment_direction_n
    FROM op a JOIN op b USING (pair_id, model) WHERE a.round = 1 AND b.round = 2 GROUP BY a.model""")
def chk_28(lake):
    return treatment(lake).groupBy("model").agg(
        F.count(F.lit(1)).alias("pairs"), *[count_where(F.col(f"{side}.{field}")).alias(f"{name}_{short}_n")
          for field, short in (("endpoint_met", "endpoint"), ("directional", "direction")) for side, name in (("control", "control"), ("treated", "treatment"))])


@query("agg_34", "usage", """
    SELECT model, round, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
           CAST(count(*) AS BIGINT) AS calls FROM usage GROUP BY model, round""")
def agg_34(lake):
    return lake.usage().groupBy("model", "round").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.count(F.lit(1)).alias("calls"))


@query("set_02", "prun", "SELECT model, case_id FROM prun GROUP BY model, case_id HAVING count(DISTINCT round) = 3")
def set_02(lake):
    r = F.col("round")
    grouped = partial_runs(lake).groupBy("model", "case_id").agg(*[F.bool_or(r == i).alias(f"r{i}") for i in (1, 2, 3)])
    return grouped.filter("r1 and r2 and r3").select("model", "case_id")


@query("win_11", "chkr", f"""
    WITH p AS (SELECT *, CASE WHEN model LIKE 'gemini%' THEN 0 ELSE 1 END AS pri, {_ALL} AS ok FROM chkr WHERE round = 1),
    c AS (SELECT 'strong_ok' AS preset, 0 AS lvl, pri, case_id, model FROM p WHERE condition = 'strong' AND ok
      UNION ALL SELECT 'over_triage', 0, pri, case_id, model FROM p WHERE condition IN ('weak', 'missing') AND severity_direction = 'over'
      UNION ALL SELECT 'counter_missed', 0, pri, case_id, model FROM p WHERE condition = 'counter' AND severity_direction = 'over'
      UNION ALL SELECT 'counter_missed', 1, pri, case_id, model FROM p WHERE condition = 'counter' AND NOT ok
      UNION ALL SELECT 'under_triage', 0, pri, case_id, model FROM p WHERE condition = 'strong' AND severity_direction = 'under'
      UNION ALL SELECT 'under_triage', 1, pri, case_id, model FROM p WHERE severity_direction = 'under'
      UNION ALL SELECT 'isolated', 0, pri, case_id, model FROM p WHERE action = 'isolate')
    SELECT preset, case_id, model FROM c QUALIFY row_number() OVER (PARTITION BY preset ORDER BY lvl, pri, case_id) = 1""")
def win_11(lake):
    """Top-1 per preset over (fallback level, model priority, case): one aggregation with min_by."""
    ok = F.col("c1") & F.col("c2") & F.col("c3") & F.col("c4")
    cond, sev = F.col("condition"), F.col("severity_direction")
    presets = [
        ("strong_ok", 0, (cond == "strong") & ok), ("over_triage", 0, cond.isin("weak", "missing") & (sev == "over")),
        ("counter_missed", 0, (cond == "counter") & (sev == "over")), ("counter_missed", 1, (cond == "counter") & ~ok),
        ("under_triage", 0, (cond == "strong") & (sev == "under")), ("under_triage", 1, sev == "under"),
        ("isolated", 0, F.col("action") == "isolate"),
    ]
    hits = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("preset"), F.lit(level).alias("lvl"))) for name, level, test in presets]))
    rows = run_checks(lake).filter("round = 1").select(
        F.when(F.startswith("model", F.lit("gemini")), 0).otherwise(1).alias("pri"), "case_id", "model", F.inline(hits))
    return rows.groupBy("preset").agg(F.min(F.struct("lvl", "pri", "case_id", "model")).alias("best")).select("preset", "best.case_id", "best.model")


# The fourteen scenario ids and their expected C1-C4; the texts and changes are our own.
MUTATIONS = {
    "BASE": ({}, "1111"), "INV-EVIDENCE-ORDER": ({"key_evidence": lambda: F.reverse("key_evidence")}, "1111"),
    "INV-CONFIDENCE": ({"confidence": lambda: F.lit(0.1)}, "1111"),
    "INV-VALID-IRRELEVANT-ID": ({"key_evidence": lambda: F.array_append("key_evidence", F.lit("EV-002"))}, "1111"),
    "INV-ID-PRESERVING-PROSE": ({"rationale": lambda: F.lit("Item A0 shows the activity, and EV-001 gives a harmless reason for it.")}, "1111"),
    "C1-INVALID-ID": ({"key_evidence": lambda: F.array_append("key_evidence", F.lit("EV-999"))}, "0111"),
    "C1-UNSUPPORTED-DECODE": ({"rationale": lambda: F.concat("rationale", F.lit(" Its decoded payload does harm."))}, "0111"),
    "C2-VERDICT-OVER": ({"verdict": lambda: F.lit("malicious")}, "1011"),
    "C2-SEVERITY-OVER": ({"severity": lambda: F.lit("high")}, "1011"),
    "C2-SEVERITY-UNDER": ({"severity": lambda: F.lit("low")}, "1011"),
    "C3-COUNTER-CITATION-REMOVED": ({"rationale": lambda: F.lit("A0 fired, and nothing here settles what it means.")}, "1101"),
    "C4-ACTION-OVER": ({"action": lambda: F.lit("isolate")}, "1110"),
    "C4-ACTION-UNDER": ({"action": lambda: F.lit("monitor")}, "1110"),
    "C2-C4-COMBINED-OVER": ({"verdict": lambda: F.lit("malicious"), "severity": lambda: F.lit("high"), "action": lambda: F.lit("isolate")}, "1010"),
}
STRONG_BASE = {"C2-SEVERITY-UNDER", "C4-ACTION-UNDER"}


def conformance(lake):
    """Every package that holds A0, EV-001 and EV-002 without derivation, under all 14 one-factor mutations."""
    ids = lake.evidence().filter(F.col("evidence_id").isin("A0", "EV-001", "EV-002")).groupBy("case_id").agg(
        *[F.bool_or(F.col("evidence_id") == i).alias(n) for n, i in (("a", "A0"), ("b", "EV-001"), ("c", "EV-002"))])
    usable = ids.filter("a and b and c").select("case_id").join(lake.derivations().select("case_id"), "case_id", "left_anti")
    strong = F.col("condition") == "strong"
    expanded = usable.select("case_id", F.explode(F.array(*[F.lit(s) for s in MUTATIONS])).alias("scenario")).withColumn(
        "condition", F.when(F.col("scenario").isin(*STRONG_BASE), "strong").otherwise("weak"))
    base = expanded.select(
        "case_id", "scenario", "condition", F.lit(0.8).alias("confidence"), F.array(F.lit("A0")).alias("key_evidence"),
        policy_value(F.col("condition"), 0).alias("expected_verdict"), policy_value(F.col("condition"), 1).alias("severity_band"),
        policy_value(F.col("condition"), 2).alias("action_band"), F.array(F.lit("A0")).alias("supporting"),
        F.when(strong, F.array().cast("array<string>")).otherwise(F.array(F.lit("EV-001"))).alias("counter"),
    ).withColumn("verdict", F.col("expected_verdict")).withColumn("severity", F.element_at("severity_band", -1)).withColumn(
        "action", F.element_at("action_band", -1)).withColumn("rationale", F.when(
            strong, "The harm that was done can be read from A0.").otherwise("A0 fired, but EV-001 gives a harmless reason for it."))
    for field in ("verdict", "severity", "action", "confidence", "key_evidence", "rationale"):
        value = F.col(field)
        for scenario, (changes, _) in MUTATIONS.items():
            if field in changes:
                value = F.when(F.col("scenario") == scenario, changes[field]()).otherwise(value)
        base = base.withColumn(field, value)
    outputs = base.select("case_id", "scenario", "verdict", "severity", "action", "confidence", "key_evidence", "rationale")
    truth = base.select("case_id", "scenario", "condition", "expected_verdict", "severity_band", "action_band", "supporting", "counter")
    keyed = ["case_id", "scenario"]
    cited = S.with_cited_ids(outputs)
    unknown = S.unknown_citations(cited, S.known_ids(lake.evidence(), lake.derivations()), keyed)
    scored = cited.join(truth, keyed).join(unknown, keyed, "left").withColumn(
        "unknown_ids", F.coalesce("unknown_ids", F.array().cast("array<string>"))).withColumn("n_derivations", F.lit(0))
    observed = F.concat(*[F.col(f"c{i}").cast("int").cast("string") for i in range(1, 5)])
    expected = F.create_map(*[F.lit(x) for s, (_, e) in MUTATIONS.items() for x in (s, e)])[F.col("scenario")]
    return S.check_columns(scored).withColumn("observed", observed).withColumn("expected", expected)


@query("chk_34", "pkg der", f"""
    WITH u AS (SELECT case_id FROM pkg GROUP BY case_id HAVING bool_or(evidence_id = 'A0') AND bool_or(evidence_id = 'EV-001') AND bool_or(evidence_id = 'EV-002')
               EXCEPT SELECT case_id FROM der)
    SELECT s.scenario, s.expected, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) AS BIGINT) AS passed
    FROM u, (VALUES {', '.join(f"('{s}', '{e}')" for s, (_, e) in MUTATIONS.items())}) s(scenario, expected) GROUP BY s.scenario, s.expected""")
def chk_34(lake):
    return conformance(lake).groupBy("scenario", "expected").agg(
        F.count(F.lit(1)).alias("cases"), count_where(F.col("observed") == F.col("expected")).alias("passed"))
