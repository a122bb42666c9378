"""Scoring takes ranks, edges and majorities once per decision."""

from collections import Counter

from alertweft.functions.ordinal import direction, signed_distance
from alertweft.operators import rounds as P
from pyspark.sql import functions as F

ORDER = ["low", "medium", "high"]


def test_ranks_and_edges_are_not_inlined(spark):
    row = ("malicious", "high", "isolate", "malicious", ["high", "critical"], ["isolate"])
    scored = spark.createDataFrame([row] * 2, "verdict string, severity string, action string, expected_verdict string, severity_band array<string>, action_band array<string>")
    found = P.with_distances(scored.repartition(2))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") <= 6 and plan.count("array_except(") == 3
    assert found.columns == [*scored.columns, "verdict_distance", "severity_distance", "action_distance"]


def test_ordinals_of_odd_bands(spark):
    rows = [("low", ["medium", "high"]), ("high", ["low"]), ("medium", ["high", "low"]), ("none", ["low"]), (None, ["low"]),
            ("low", []), ("low", None), ("low", ["low", "none"]), ("low", ["low", None]), ("high", ["medium", "medium"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, band array<string>")
    got = df.select("i", direction(F.col("v"), F.col("band"), ORDER).alias("d"), signed_distance(F.col("v"), F.col("band"), ORDER).alias("n")).orderBy("i").collect()
    assert [(r.d, r.n) for r in got] == [("under", -1), ("over", 2), ("in_band", 0), (None, None), (None, None),
                                         (None, None), (None, None), (None, None), (None, None), ("over", 1)]


def test_round_patterns(spark):
    rows = [(case, rnd, *[(case * 7 + (rnd or 0) * 3 + i) % 3 != 0 for i in range(4)]) for case in range(20) for rnd in (1, 1, 2, 3, None)[: 2 + case % 4]]
    checked = spark.createDataFrame(rows, "case_id int, round int, c1 boolean, c2 boolean, c3 boolean, c4 boolean")
    found = P.round_patterns(checked, ["case_id"])
    assert sorted(map(tuple, found.drop("passes").collect())) == sorted(map(tuple, P.majority(checked, ["case_id"]).collect()))
    joint = Counter()
    for case, rnd, *cs in rows:
        joint[case, rnd] += all(cs)
    assert {(r.case_id, p["round"]): p["joint"] for r in found.collect() for p in r.passes} == dict(joint)
