"""Aggregated rules on a stream that was ended give the groups of the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from alertweft.operators.replay import natural
from alertweft.operators.rules import RuleError, field_column, predicate
from alertweft.operators.sessions import bursts
from alertweft.session import scratch_path
from alertweft.streaming import bursts as B

HOST = {"field": "event_code", "op": "eq", "value": 1}
RULES = [
    {"case_id": "GAP", "event_predicate": HOST, "aggregation": {
        "group_by": ["computer"], "count_gte": 2, "session_gap_seconds_lte": 5, "within_seconds_lte": 20, "distinct": {"field": "attributes.user", "count_gte": 2}}},
    {"case_id": "ALL", "event_predicate": HOST, "aggregation": {
        "group_by": ["computer", "attributes.port"], "count_gte": 3, "within_seconds_lte": 300, "distinct": {"field": "attributes.user", "count_gte": 2}}},
    {"case_id": "ONE", "event_predicate": {"field": "event_code", "op": "eq", "value": 2}, "aggregation": {
        "group_by": ["computer"], "count_gte": 1, "session_gap_seconds_lte": 1}},
    {"case_id": "OPEN", "event_predicate": HOST, "aggregation": {"group_by": ["attributes.port"], "count_gte": 2}},
]
START = 1_700_000_000_000_000
COLUMNS = "record_key string, computer string, sec double, event_code int, attributes map<string,string>"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("event_time", F.timestamp_micros((F.col("sec") * 1_000_000).cast("bigint") + START))


def made(rng, number):
    rows = []
    for i in range(number):
        sec = None if rng.random() < 0.03 else round(rng.uniform(0, 600), 1)
        attributes = {"user": rng.choice(["u", "v", "w"])} if rng.random() < 0.9 else {}
        if rng.random() < 0.8:
            attributes["port"] = rng.choice("12345678")
        rows.append((f"r{i}", rng.choice(["hot"] * 4 + ["a", "b", None]), sec, rng.choice([1, 1, 1, 2]), attributes))
    return rows


def batch(events):
    out = []
    for rule in RULES:
        block = rule["aggregation"]
        fields = [*block["group_by"], *([block["distinct"]["field"]] if "distinct" in block else [])]
        names = {f: f"_g{i}" for i, f in enumerate(fields)}
        hits = events.where(predicate(rule["event_predicate"])).select(
            "event_time", "record_key", natural(F.col("record_key")).alias("_natural"), *[field_column(f).alias(n) for f, n in names.items()])
        found = bursts(hits, block, names, "event_time", F.struct("_natural", "record_key"), ["record_key"])
        for r in found.collect():
            group = [r[names[f]] for f in block["group_by"]]
            out.append((rule["case_id"], group, r.n, r.start_us, r.end_us, r.n_distinct if "distinct" in block else None, r.record_key))
    return sorted(out, key=repr)


def run(spark, parts, late):
    source, target, marks = (scratch_path(spark, name) for name in ("burst-in", "burst-out", "burst-end"))
    like = frame(spark, parts[0]).drop("sec")

    def go():
        stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(source)
        B.write_available(B.aggregated_alerts(stream, RULES, B.endings(spark, marks), late=late), target).awaitTermination()
        return sorted(map(tuple, spark.read.schema(B.OUTPUT).parquet(target).collect()), key=repr)

    for part in parts:
        frame(spark, part).drop("sec").coalesce(1).write.mode("append").parquet(source)
    before = go()
    B.end(spark, marks)
    return before, go()


def test_shuffled_arrival(spark):
    """Sessions grow, meet and merge over micro-batches; untimed events, null groups and null values count as in batch."""
    rows = made(random.Random(3), 240)
    before, got = run(spark, [rows[:80], rows[80:160], rows[160:]], "1 hour")
    assert got == batch(frame(spark, rows))
    assert {g[0] for g in got} == {"GAP", "ALL", "ONE", "OPEN"}
    assert {g[0] for g in before} <= {"ONE"}  # untimed events alone are final at once


def test_closed_by_the_watermark(spark):
    """In order of time, sessions come out before the end, each once."""
    rows = sorted((r for r in made(random.Random(5), 150) if r[2] is not None), key=lambda r: r[2])
    before, got = run(spark, [rows[:50], rows[50:100], rows[100:]], "5 seconds")
    assert got == batch(frame(spark, rows))
    assert {g[0] for g in before} >= {"GAP", "ONE"} and not {g[0] for g in before} & {"ALL", "OPEN"}


def test_gap_that_is_met_exactly(spark):
    rows = [("r1", "k", 0.0, 1, {"user": "a"}), ("r2", "k", 5.0, 1, {"user": "b"}), ("r3", "k", 10.1, 1, {"user": "c"})]
    got = run(spark, [rows], "0 seconds")[1]
    assert [g[2:] for g in got if g[0] == "GAP"] == [(2, START, START + 5_000_000, 2, "r1")]


def test_nothing_arrives(spark):
    assert run(spark, [[]], "1 minute") == ([], [])


def test_rules_without_groups(spark):
    with pytest.raises(RuleError):
        B.aggregated_alerts(frame(spark, []), [{"case_id": "X", "event_predicate": HOST}], spark.createDataFrame([], "at timestamp"))


def test_keys_beyond_one_entry(spark, monkeypatch):
    """Keys that outgrow their one entry, and sessions that outgrow their values, go on in the maps."""
    monkeypatch.setattr(B, "PACKED", 4)
    monkeypatch.setattr(B, "HELD", 1)
    rows = made(random.Random(8), 200)
    _, got = run(spark, [rows[:70], rows[70:140], rows[140:]], "1 hour")
    assert got == batch(frame(spark, rows))
