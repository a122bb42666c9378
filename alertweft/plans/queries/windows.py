"""Flagship, WIN: ordering, sessions, top-1; AGG-02/03: bursts and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweft.functions.ranking import numbered_distinct, split_row_number
from alertweft.functions.times import event_order
from alertweft.operators import rules as R, sessions as Q
from alertweft.operators.selection import first_in_order
from alertweft.operators.replay import replay
from alertweft.plans.registry import query
from alertweft.plans.rule_library import rules as shipped_rules, taxonomy_rows
from alertweft.plans.telemetry import SCENARIOS, burst_telemetry, bursts_sql, expected_hits_sql, telemetry

ERROR = {"all": [{"field": "attributes.event_type", "op": "eq", "value": "error"}]}
BURST = {"group_by": ["computer"], "count_gte": 3, "session_gap_seconds_lte": 21600,
         "distinct": {"field": "attributes.user", "count_gte": 2}}

# sessions of the filtered events {where}, grouped by {key}, gap in microseconds {gap}
_SESSION_SQL = """
    WITH f AS (SELECT *, us - lag(us) OVER (PARTITION BY {key} ORDER BY us, event_id) AS gap FROM ev WHERE {where}),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY {key} ORDER BY us, event_id) AS sid FROM f)
    SELECT {key}, CAST(count(*) AS BIGINT) AS n, min(us) AS start_us, max(us) AS end_us,
           min_by(event_id, us) AS anchor_event, CAST(count(DISTINCT user_id) AS BIGINT) AS n_distinct
    FROM s GROUP BY {key}, sid"""


@query("flagship", "ev", _SESSION_SQL.format(key="computer", where="event_type = 'error'", gap=21600000000)
       + " HAVING count(*) >= 3 AND count(DISTINCT user_id) >= 2")
def flagship(lake):
    hits = lake.events().filter(R.predicate(ERROR)).withColumnRenamed("event_id", "anchor_event")
    return Q.bursts(hits, BURST, {"computer": "computer", "attributes.user": "user"}, "event_time",
                    F.col("anchor_event"), ["anchor_event"])


@query("win_01", "pkg", """
    SELECT case_id, record_id, event_time_utc,
           'EV-' || lpad(CAST(row_number() OVER (PARTITION BY case_id ORDER BY event_time_utc, record_id) AS VARCHAR), 3, '0') AS new_id
    FROM pkg WHERE evidence_id <> 'A0'""")
def win_01(lake):
    ev = lake.evidence().filter("evidence_id <> 'A0'").select("case_id", "record_id", "event_time_utc")
    ranked = split_row_number(ev, ["case_id"], F.left("event_time_utc", F.lit(7)),
                              [F.col("event_time_utc"), F.col("record_id")], "rn")
    return ranked.select("case_id", "record_id", "event_time_utc", F.format_string("EV-%03d", "rn").alias("new_id"))


@query("win_02", "ev", _SESSION_SQL.format(key="user_id", where="true", gap=7200000000))
def win_02(lake):
    ev = lake.events().withColumnRenamed("event_id", "anchor_event")
    return Q.gap_sessions(ev, ["user_id"], "event_time", 7200, F.col("anchor_event"), ["anchor_event"], "user_id")


@query("win_03", "ev", """
    SELECT computer, min_by(event_id, us) AS earliest, max_by(event_id, us) AS latest FROM ev
    WHERE event_code = 4625 GROUP BY computer""")
def win_03(lake):
    hits = lake.events().filter("event_code = 4625")
    order = event_order(F.col("event_time_utc"), F.col("event_time"), F.col("record_key"))
    return hits.groupBy("computer").agg(F.min_by("event_id", order).alias("earliest"),
                                        F.max_by("event_id", order).alias("latest"))


@query("win_04", "ev", """
    WITH g AS (SELECT event_type, computer, count(*) AS n, min(us) AS first_us, min_by(event_id, us) AS anchor_event
               FROM ev GROUP BY event_type, computer)
    SELECT event_type, computer, CAST(n AS BIGINT) AS n, anchor_event FROM g
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first_us) = 1""")
def win_04(lake):
    groups = Q.plain_groups(lake.events().withColumnRenamed("event_id", "anchor_event"), ["event_type", "computer"],
                            "event_time", F.col("anchor_event"), ["anchor_event"])
    best = F.struct((-F.col("n")).alias("rank"), F.col("start_us"), F.col("anchor_event").alias("tie"))
    ranked = groups.withColumn("_best", best)
    return first_in_order(ranked, ["event_type"], "_best", ["computer", "n", "anchor_event"])


@query("win_05", "ev", """
    SELECT event_id, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS late, CASE WHEN k % 10 = 0 THEN 0 ELSE us END AS at,
           CASE WHEN k % 10 = 0 THEN 'unknown' ELSE '' END AS text,
           '1' || sensor || ':|0' || lpad(CAST(length(CAST(event_id AS VARCHAR)) AS VARCHAR), 6, '0') || event_id AS natural
    FROM ev""")
def win_05(lake):
    ev = lake.events()
    shown = F.when(F.col("k") % 10 == 0, F.lit("unknown")).otherwise(F.col("event_time_utc"))
    order = event_order(shown, shown.try_cast("timestamp"), F.concat(F.initcap("sensor"), F.lit(":"), F.col("record_key")))
    return ev.select("event_id", order.alias("o")).select(
        "event_id", "o.late", "o.at", "o.text", F.array_join("o.key", "|").alias("natural"))


@query("win_06", "ev", "SELECT user_id, max_by(event_id, us) AS event_id, max_by(event_type, us) AS event_type FROM ev GROUP BY user_id")
def win_06(lake):
    return first_in_order(lake.events(), ["user_id"], "event_time", ["event_id", "event_type"], latest=True)


@query("win_07", "pkg", """
    SELECT case_id, line_no, first(record_id ORDER BY event_time_utc, record_id) AS kept_first,
           last(record_id ORDER BY event_time_utc, record_id) AS kept_last, CAST(count(*) AS BIGINT) AS copies
    FROM pkg GROUP BY case_id, line_no""")
def win_07(lake):
    order = F.struct("event_time_utc", "record_id")
    return lake.evidence().groupBy("case_id", "line_no").agg(
        F.min_by("record_id", order).alias("kept_first"), F.max_by("record_id", order).alias("kept_last"),
        F.count(F.lit(1)).alias("copies"))


@query("win_08", sql=r"""
    SELECT doc_id, CAST(u.i AS BIGINT) AS line_no, CAST(length(u.line) AS BIGINT) AS chars
    FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                             generate_subscripts(string_split(text, chr(10)), 1) AS i) u""")
def win_08(lake):
    lines = lake.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"),
                        F.length("line").cast("bigint").alias("chars"))


@query("win_09", "ev", """
    SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_name AS user,
           format('user-{:02d}', dense_rank() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY user_name)) AS pseudonym
    FROM ev""")
def win_09(lake):
    ev = lake.events().select(F.date_format("event_time", "yyyy-MM-dd").alias("day"), "user")
    named = numbered_distinct(ev, ["day"], "user", "rn")
    return named.select("day", "user", F.format_string("user-%02d", "rn").alias("pseudonym"))


@query("win_10", sql="SELECT o_orderkey AS case_id, o_orderstatus AS status FROM orders ORDER BY 1")
def win_10(lake):
    return lake.table("orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status")).orderBy("case_id")


@query("win_12", sql="""
    SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    ORDER BY o_orderkey LIMIT 25""")
def win_12(lake):
    done = lake.table("lineitem").select(F.col("l_orderkey").alias("case_id"))
    todo = lake.table("orders").select(F.col("o_orderkey").alias("case_id")).join(done, "case_id", "left_anti")
    return todo.orderBy("case_id").limit(25)


@query("win_13", sql="SELECT o_orderkey AS case_id, md5('20260722:' || o_orderkey) AS shuffle_key FROM orders")
def win_13(lake):
    key = F.md5(F.concat(F.lit("20260722:"), F.col("o_orderkey").cast("string")))
    return lake.table("orders").select(F.col("o_orderkey").alias("case_id"), key.alias("shuffle_key")).orderBy("shuffle_key")


@query("win_14", "pkg", """
    WITH r AS (SELECT DISTINCT case_id, line_no * 100 AS s, line_no * 100 + CASE WHEN status = 'O' THEN 100 ELSE 90 END AS e FROM pkg),
    n AS (SELECT *, lead(s) OVER (PARTITION BY case_id ORDER BY s, e) AS nxt FROM r)
    SELECT case_id, CAST(count(*) AS BIGINT) AS ranges, bool_and(nxt IS NULL OR nxt = e) AS contiguous FROM n GROUP BY case_id""")
def win_14(lake):
    start = F.col("line_no") * 100
    ranges = lake.evidence().select(
        "case_id", start.alias("s"), (start + F.when(F.col("status") == "O", 100).otherwise(90)).alias("e")).distinct()
    ranked = split_row_number(ranges, ["case_id"], F.floor(F.col("s") / 100000), [F.col("s"), F.col("e")], "rn")
    following = ranked.select("case_id", (F.col("rn") - 1).alias("rn"), F.col("s").alias("nxt"))
    return ranked.join(following, ["case_id", "rn"], "left").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("ranges"), F.bool_and(F.col("nxt").isNull() | (F.col("nxt") == F.col("e"))).alias("contiguous"))


@query("win_15", "ev", """
    SELECT computer, event_type, CAST(count(*) AS BIGINT) AS n, min(us) AS first_us, max(us) AS last_us,
           round_even(count(*) / ((max(us) - min(us)) / 60000000.0), 6) AS per_minute
    FROM ev GROUP BY computer, event_type""")
def win_15(lake):
    us = F.unix_micros("event_time")
    return lake.events().groupBy("computer", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us")
    ).withColumn("per_minute", F.bround(F.col("n") / ((F.col("last_us") - F.col("first_us")) / F.lit(60000000.0)), 6))


@query("agg_02", "ev", """
    SELECT computer, event_type, CAST(count(*) AS BIGINT) AS n, min(us) AS start_us, max(us) AS end_us,
           min_by(event_id, us) AS anchor_event, CAST(count(DISTINCT user_id) AS BIGINT) AS n_distinct
    FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY computer, event_type ORDER BY us, event_id) AS sid
          FROM (SELECT *, us - lag(us) OVER (PARTITION BY computer, event_type ORDER BY us, event_id) AS gap FROM ev))
    GROUP BY computer, event_type, sid
    HAVING count(*) >= 2 AND max(us) - min(us) <= 14400000000 AND count(DISTINCT user_id) >= 2""")
def agg_02(lake):
    rule = {"group_by": ["computer", "attributes.event_type"], "count_gte": 2, "within_seconds_lte": 14400,
            "session_gap_seconds_lte": 3600, "distinct": {"field": "attributes.user", "count_gte": 2}}
    columns = {"computer": "computer", "attributes.event_type": "event_type", "attributes.user": "user"}
    ev = lake.events().withColumnRenamed("event_id", "anchor_event")
    return Q.bursts(ev, rule, columns, "event_time", F.col("anchor_event"), ["anchor_event"])


@query("agg_03", "ev", f"""
    WITH h(scenario, rule) AS (VALUES {expected_hits_sql()}),
    rules(rule) AS (VALUES {", ".join(f"('{r['case_id']}')" for r in shipped_rules())})
    SELECT r.rule AS case_id, (SELECT CAST(count(*) AS BIGINT) FROM ev) AS raw_events,
           CASE WHEN r.rule IN ('DISC-002', 'ST-003') THEN 0 ELSE (SELECT CAST(count(*) AS BIGINT) FROM ev) END AS scope_events,
           (SELECT CAST(count(*) AS BIGINT) FROM ev JOIN h ON ev.k % {len(SCENARIOS)} = h.scenario AND h.rule = r.rule) AS predicate_matches
    FROM rules r""")
def agg_03(lake):
    return R.funnel(telemetry(lake), shipped_rules())


@query("chk_23", "ev", """
    WITH best AS (SELECT event_type, computer, count(*) AS n, min(us) AS f, min_by(event_id, us) AS e FROM ev GROUP BY 1, 2),
    sel AS (SELECT event_type, e FROM best QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, f) = 1),
    cfg AS (SELECT event_type, min(event_id) AS expected, min_by(event_id, us) AS configured FROM ev GROUP BY 1)
    SELECT event_type, CAST(e AS VARCHAR) AS selected_key, CAST(expected AS VARCHAR) AS expected_key,
           e = expected AND e = configured AS pass FROM sel JOIN cfg USING (event_type)""")
def chk_23(lake):
    selected = win_04(lake).select("event_type", F.col("anchor_event").cast("string").alias("selected_key"))
    spec = lake.events().groupBy("event_type").agg(
        F.min("event_id").cast("string").alias("expected_key"),
        F.min_by("event_id", "event_time").cast("string").alias("configured_key"))
    return selected.join(spec, "event_type").select(
        "event_type", "selected_key", "expected_key",
        ((F.col("selected_key") == F.col("expected_key")) & (F.col("selected_key") == F.col("configured_key"))).alias("pass"))


_LATEST = ", ".join(f"'{r['case_id']}'" for r in shipped_rules() if r["selection"]["strategy"] == "latest_match")
_GROUPED = ", ".join(f"'{r['case_id']}'" for r in shipped_rules() if r.get("aggregation"))


@query("chk_23_replay", "ev", f"""
    WITH h(scenario, rule) AS (VALUES {expected_hits_sql()}),
    rules(rule, strategy) AS (VALUES {", ".join(f"('{r['case_id']}', '{r['selection']['strategy']}')" for r in shipped_rules())}),
    m AS (SELECT h.rule, ev.event_id, ev.us FROM ev JOIN h ON ev.k % {len(SCENARIOS)} = h.scenario),
    s AS (SELECT rule, count(*) AS n, arg_min(event_id, (us, event_id)) AS first, arg_max(event_id, (us, event_id)) AS last, min(event_id) AS smallest FROM m GROUP BY rule),
    t AS (SELECT r.rule, r.strategy, coalesce(s.n, 0) AS n, CASE WHEN r.rule IN ({_GROUPED}) THEN NULL WHEN r.rule IN ({_LATEST}) THEN s.last ELSE s.first END AS sel,
        CASE WHEN r.rule LIKE 'L%' THEN s.smallest WHEN r.rule IN ({_LATEST}) THEN s.last ELSE s.first END AS expected,
        CASE WHEN r.rule IN ('DISC-002', 'ST-003') THEN 0 ELSE (SELECT count(*) FROM ev) END AS scope FROM rules r LEFT JOIN s USING (rule))
    SELECT rule AS case_id, CAST(scope AS BIGINT) AS scope_events, CAST(n AS BIGINT) AS predicate_matches, CAST(0 AS BIGINT) AS qualifying_groups, strategy,
        CAST(sel AS VARCHAR) AS selected_key, CAST(expected AS VARCHAR) AS expected_key,
        concat_ws('|', CASE WHEN scope = 0 THEN 'no event in scope' END, CASE WHEN sel IS NULL THEN 'nothing selected' END,
            CASE WHEN expected IS NULL THEN 'no event configured' END, CASE WHEN sel <> expected THEN 'another event is configured' END) AS problems,
        scope > 0 AND sel IS NOT NULL AND expected IS NOT NULL AND sel = expected AS passed FROM t""")
def chk_23_replay(lake):
    """All shipped rules replayed over the telemetry; the L cases are configured on their smallest id instead of their first event."""
    events = telemetry(lake)
    place = F.struct("event_time", "event_id")
    found = R.match_rules(events, shipped_rules()).groupBy(F.col("rule_case").alias("case_id")).agg(
        F.min_by("event_id", place).alias("first"), F.max_by("event_id", place).alias("last"), F.min("event_id").alias("smallest"))
    latest = [r["case_id"] for r in shipped_rules() if r["selection"]["strategy"] == "latest_match"]
    case = F.col("case_id")
    key = F.when(F.startswith(case, F.lit("L")), F.col("smallest")).when(case.isin(latest), F.col("last")).otherwise(F.col("first"))
    rows = replay(events, shipped_rules(), taxonomy_rows(), found.select("case_id", key.cast("string").alias("record_key")))
    return rows.select("case_id", "scope_events", "predicate_matches", "qualifying_groups", "strategy", "selected_key", "expected_key",
                       F.array_join("problems", "|").alias("problems"), "passed")


_AGGREGATED = [r for r in shipped_rules() if r.get("aggregation")]


@query("chk_23_groups", sql=f"""
    WITH {bursts_sql({r['case_id']: Q.limits(r) for r in _AGGREGATED})},
    m AS (SELECT rule_case, count(*) AS n, min(e) AS smallest FROM b GROUP BY rule_case),
    q AS (SELECT rule_case, count(*) AS groups, arg_min(first_event, (-n, start_us, first_event)) AS sel FROM found GROUP BY rule_case),
    r(rule_case) AS (VALUES {", ".join(f"('{r['case_id']}')" for r in _AGGREGATED)}),
    j AS (SELECT rule_case, coalesce(m.n, 0) AS n, coalesce(groups, 0) AS groups, sel, smallest AS expected FROM r LEFT JOIN m USING (rule_case) LEFT JOIN q USING (rule_case))
    SELECT rule_case AS case_id, (SELECT CAST(count(*) AS BIGINT) FROM events) AS scope_events, CAST(n AS BIGINT) AS predicate_matches, CAST(groups AS BIGINT) AS qualifying_groups,
        CAST(sel AS VARCHAR) AS selected_key, CAST(expected AS VARCHAR) AS expected_key, concat_ws('|', CASE WHEN sel IS NULL THEN 'nothing selected' END, CASE WHEN sel <> expected THEN 'another event is configured' END) AS problems, coalesce(sel = expected, false) AS passed FROM j""")
def chk_23_groups(lake):
    """The aggregated library rules replayed over bursts; each is configured on the first event it matches, which need not be in its largest group."""
    events = burst_telemetry(lake)
    first = R.match_rules(events, _AGGREGATED).groupBy(F.col("rule_case").alias("case_id")).agg(F.min("event_id").cast("string").alias("record_key"))
    rows = replay(events, _AGGREGATED, taxonomy_rows(), first)
    return rows.select("case_id", "scope_events", "predicate_matches", "qualifying_groups", "selected_key", "expected_key", F.array_join("problems", "|").alias("problems"), "passed")
