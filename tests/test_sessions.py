"""Sessions and bursts against a plain sequential computation, including hot keys and tiny slices."""

import random

import pytest
from pyspark.sql import functions as F

from alertweft.functions.ranking import split_row_number
from alertweft.operators import correlation as T, sessions as Q


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, key string, sec double, user string").withColumn(
        "at", F.timestamp_micros((F.col("sec") * 1_000_000).cast("bigint")))


def sequential(rows, gap):
    out, by_key = [], {}
    for row in rows:
        by_key.setdefault(row[1], []).append(row)
    for key, items in by_key.items():
        timed = sorted((r for r in items if r[2] is not None), key=lambda r: (r[2], r[0]))
        sessions = []
        for row in timed:
            if sessions and row[2] - sessions[-1][-1][2] <= gap:
                sessions[-1].append(row)
            else:
                sessions.append([row])
        out += [(key, len(s), s[0][0], len({r[3] for r in s})) for s in sessions]
        out += [(key, 1, r[0], 1) for r in items if r[2] is None]
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_seconds", [5.0, 60.0, 86400.0])
def test_gap_sessions_match_sequential(spark, slice_seconds):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, float(rng.randrange(0, 900))]) if i % 9 == 0 else float(rng.randrange(0, 900)),
             rng.choice(["u", "v", None])) for i in range(400)]
    found = Q.gap_sessions(frame(spark, rows), ["key"], "at", 3, F.col("id"), ["id"], "user", slice_seconds)
    got = sorted(((r.key, r.n, r.id, r.n_distinct) for r in found.collect()), key=str)
    assert got == sequential(rows, 3)


def test_gap_equal_to_threshold_stays_in_session(spark):
    rows = [(1, "k", 0.0, "u"), (2, "k", 10.0, "u"), (3, "k", 20.001, "u")]
    found = Q.gap_sessions(frame(spark, rows), ["key"], "at", 10, F.col("id"), ["id"], None, 5.0)
    assert sorted((r.n, r.id) for r in found.collect()) == [(1, 3), (2, 1)]


def test_burst_thresholds(spark):
    burst = [(10 + i, "k", 100.0 + i, f"u{i}") for i in range(4)]
    rows = [(1, "k", 0.0, "u0"), *burst, (99, "k", None, "z")]
    rule = {"group_by": ["key"], "count_gte": 3, "session_gap_seconds_lte": 5, "within_seconds_lte": 3, "distinct": {"field": "user", "count_gte": 4}}
    columns = {"key": "key", "user": "user"}
    got = Q.bursts(frame(spark, rows), rule, columns, "at", F.col("id"), ["id"]).collect()
    assert [(r.id, r.n, r.n_distinct) for r in got] == [(10, 4, 4)]
    # without a gap the whole group counts, and one untimed member makes its span infinite
    del rule["session_gap_seconds_lte"]
    assert Q.bursts(frame(spark, rows), rule, columns, "at", F.col("id"), ["id"]).count() == 0
    assert Q.bursts(frame(spark, burst), rule, columns, "at", F.col("id"), ["id"]).count() == 1


def test_null_counts_as_a_distinct_value(spark):
    rows = [(1, None, 0.0, None), (2, None, 1.0, "u")]
    got = Q.plain_groups(frame(spark, rows), ["key"], "at", F.col("id"), ["id"], "user").collect()
    assert [(r.n, r.n_distinct) for r in got] == [(2, 2)]


def test_split_row_number(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), float(rng.randrange(1000)), "u") for i in range(300)] + [(300, "b", None, "u"), (301, None, 5.0, "u"), (302, None, 7.0, "u")]
    got = split_row_number(frame(spark, rows), ["key"], F.floor(F.col("sec") / 100), [F.col("sec"), F.col("id")], "rn").collect()
    expected = {}
    for key in ("a", "b", None):
        for n, row in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (-1.0 if r[2] is None else r[2], r[0])), 1):
            expected[row[0]] = n
    assert {r.id: r.rn for r in got} == expected


@pytest.mark.parametrize("slice_us", [20, 1000])
def test_nearest_matches_brute_force(spark, slice_us):
    rng = random.Random(5)
    rows = [(i, rng.choice("hhhk"), rng.randrange(0, 400), rng.choice("pq")) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, host string, us long, kind string")
    got = {r.id for r in T.unconfirmed(df, "host", "us", F.col("kind") == "p", F.col("kind") == "q", 7).collect()}
    expected = {a[0] for a in rows if a[3] == "p" and not any(b[3] == "q" and b[1] == a[1] and 0 <= b[2] - a[2] <= 7 for b in rows)}
    assert got == expected
    near = T.nearest(df, "host", "us", {"q": F.col("kind") == "q"}, 7, slice_us).collect()
    assert len(near) == len(rows)
