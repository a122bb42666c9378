"""STR: the streaming operators, run to completion over the tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweft.operators import gate as G, scoring as S
from alertweft.operators.sessions import limits
from alertweft.plans.adapters import canonical_events
from alertweft.plans.queries.gate import _gate_view  # noqa: F401  (registers the gate views)
from alertweft.plans.registry import query
from alertweft.plans.rule_library import rules as shipped_rules
from alertweft.plans.telemetry import BURST_START, burst_telemetry, bursts_sql
from alertweft.session import materialise, scratch_path
from alertweft.streaming import bursts as B, rules as Z

GROUPED = [r for r in shipped_rules() if r.get("aggregation")]

RULES = [
    {"case_id": "ERR", "event_predicate": {"field": "attributes.event_type", "op": "eq", "value": "error"}},
    {"case_id": "HOT", "event_predicate": {"all": [{"field": "computer", "op": "iendswith", "value": "-03"}, {"field": "attributes.k", "op": "regex", "value": "^9"}]}},
]


def event_stream(lake):
    return Z.file_stream(lake.spark, lake.folder, lake.table("events"), "events.parquet")


@query("str_01", "ev", """SELECT event_id, 'ERR' AS rule_case FROM ev WHERE event_type = 'error' UNION ALL SELECT event_id, 'HOT' FROM ev WHERE ends_with(computer, '-03') AND starts_with(CAST(k AS VARCHAR), '9')""")
def str_01(lake):
    return Z.drain(Z.alerts(canonical_events(event_stream(lake)), RULES).select("event_id", "rule_case"), "alerts")


@query("str_02", "ev", """
    WITH f AS (SELECT *, us - lag(us) OVER (PARTITION BY computer ORDER BY us, event_id) AS gap FROM ev WHERE event_type = 'error'),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY computer ORDER BY us, event_id) AS sid FROM f)
    SELECT computer, CAST(count(*) AS BIGINT) AS n, min(us) AS start_us, max(us) AS end_us, CAST(count(DISTINCT user_id) AS BIGINT) AS n_distinct FROM s GROUP BY computer, sid
    HAVING count(*) >= 3 AND count(DISTINCT user_id) >= 2 AND max(us) + 7200000000 <= (SELECT max(us) FROM ev WHERE event_type = 'error') - 600000000""")
def str_02(lake):
    """Sessions the watermark has closed; the rest stay open in the state store."""
    errors = canonical_events(event_stream(lake)).filter("event_type = 'error'").select("computer", "event_time", "user_id")
    return Z.drain(Z.burst_sessions(errors, ["computer"], "event_time", 7200, "user_id", 3, 2), "bursts")


@query("str_02_rules", sql=f"WITH {bursts_sql({r['case_id']: limits(r) for r in GROUPED})} SELECT rule_case, grp, n, start_us, end_us, n_distinct, CAST(first_event AS VARCHAR) AS first_key FROM found")
def str_02_rules(lake):
    """All aggregated library rules over a log that arrives in three parts, up to four minutes out of order, and then ends."""
    source, target, marks = (scratch_path(lake.spark, name) for name in ("burst-in", "burst-out", "burst-end"))
    events = burst_telemetry(lake).drop("event_id")
    since = F.unix_micros("event_time") - BURST_START
    last = events.agg(F.max(since).alias("last")).first().last or 0
    delay = F.col("record_key").cast("bigint") % 5 * 60_000_000
    part = F.least(F.lit(2), F.floor((since + delay) * 3 / (last + 1)))
    for number in range(3):
        events.filter(part == number).write.mode("append").parquet(source)
    stream = lake.spark.readStream.schema(events.schema).parquet(source)
    for final in (False, True):
        if final:
            B.end(lake.spark, marks)
        B.write_available(B.aggregated_alerts(stream, GROUPED, B.endings(lake.spark, marks)), target).awaitTermination()
    found = lake.spark.read.schema(B.OUTPUT).parquet(target)
    return found.select("rule_case", F.array_join("group", "|").alias("grp"), "n", "start_us", "end_us", "n_distinct", "first_key")


@query("str_03", "g", "SELECT case_id, profile, status FROM g")
def str_03(lake):
    """Decisions arrive as a stream; package facts are a static table."""
    path = scratch_path(lake.spark, "decisions")
    lake.outputs().write.parquet(path)
    facts = materialise(G.package_facts(lake.evidence(), lake.derivations()).join(lake.declared(), "case_id", "left"), "facts")
    ids = materialise(S.known_ids(lake.evidence(), lake.derivations(), upper=True), "ids")
    stream = Z.file_stream(lake.spark, path, lake.outputs(), "*.parquet")
    target = scratch_path(lake.spark, "routes")
    Z.gate_stream(stream, facts, ids, target).awaitTermination()
    return lake.spark.read.parquet(target).select("case_id", "profile", "status")


@query("str_04", "usage", """SELECT case_id, model, round, seq, input_tokens FROM usage QUALIFY row_number() OVER (PARTITION BY case_id, model, round ORDER BY seq DESC) = 1""")
def str_04(lake):
    """Usage log ingestion keeping the last record per key, over several input files."""
    source, target = scratch_path(lake.spark, "usage-in"), scratch_path(lake.spark, "usage-latest")
    rows = lake.usage().select("case_id", "model", "round", "seq", "input_tokens")
    for part in (1, 2):
        rows.filter(F.col("seq") == part).write.mode("append").parquet(source)
    stream = lake.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    keys = ["case_id", "model", "round"]
    Z.upsert_latest(stream, target, keys, F.col("seq")).awaitTermination()
    return Z.latest(lake.spark, target, rows)
