"""JN-08/13..23, SET-01/03, AGG-24/25/29/32/35/36/38: investigation joins, cost and inventories."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from alertweft.fixed import PRICES
from alertweft.functions.stats import count_where
from alertweft.operators import correlation as T, cost as M, lineage as N, rules as R
from alertweft.operators.integrity import digest_bytes, row_digest
from alertweft.operators.inventory import met, seen
from alertweft.operators.provenance import verify_records
from alertweft.plans.adapters import add_view
from alertweft.plans.queries.rounds import RUN_KEYS, partial_runs
from alertweft.plans.registry import query
from alertweft.plans.rule_library import rules as shipped_rules, taxonomy_rows
from alertweft.plans.telemetry import SCENARIOS, expected_hits_sql, telemetry
from alertweft.session import materialise, scratch_path
from alertweft.sources.byte_ranges import csv_records, line_text, raw_lines


def literal_rows(lake, names, rows):
    """A small constant table without a Python worker."""
    structs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return lake.spark.range(1).select(F.inline_outer(structs))


_TAXONOMY = ", ".join(f"('{f}', '{p}', '{c}')" for f, p, c in taxonomy_rows())
add_view("tax", f"SELECT * FROM (VALUES {_TAXONOMY}) t(family, pattern, case_id)")
add_view("hits", f"SELECT h.rule AS case_id, count(*) AS matches FROM ev JOIN (VALUES {expected_hits_sql()}) h(scenario, rule) ON ev.k % {len(SCENARIOS)} = h.scenario GROUP BY h.rule", "ev")


def rule_hits(lake):
    return R.match_rules(telemetry(lake), shipped_rules()).groupBy(F.col("rule_case").alias("case_id")).agg(F.count(F.lit(1)).alias("matches"))


@query("jn_08", "tax hits", "SELECT family, pattern, case_id, CAST(coalesce(matches, 0) AS BIGINT) AS matches, 'ok' AS status FROM tax FULL JOIN hits USING (case_id)")
def jn_08(lake):
    """Taxonomy lookup of all rule hits with a two-sided inventory check."""
    tax = literal_rows(lake, ["family", "pattern", "case_id"], taxonomy_rows())
    both = tax.withColumn("listed", F.lit(True)).join(rule_hits(lake), "case_id", "full_outer")
    return both.select("family", "pattern", "case_id", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"),
                       F.when(F.col("listed").isNull(), "unlisted_rule").otherwise("ok").alias("status"))


@query("agg_38", "tax hits", """SELECT family, pattern, CAST(count(*) AS BIGINT) AS cases, CAST(coalesce(sum(matches), 0) AS BIGINT) AS matches FROM tax LEFT JOIN hits USING (case_id)
    GROUP BY GROUPING SETS ((family, pattern), (family))""")
def agg_38(lake):
    tax = literal_rows(lake, ["family", "pattern", "case_id"], taxonomy_rows())
    joined = tax.join(rule_hits(lake), "case_id", "left")
    return joined.groupingSets([["family", "pattern"], ["family"]], "family", "pattern").agg(
        F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum("matches"), F.lit(0)).cast("bigint").alias("matches"))


_PRICE = {i: "CASE " + " ".join(f"WHEN starts_with(model, '{p[0]}') THEN {p[i]}" for p in PRICES) + " END" for i in (1, 2)}


@query("jn_13", "usage", f"SELECT model, tag, {_PRICE[1]}::DOUBLE AS input_price, {_PRICE[2]}::DOUBLE AS output_price, CAST(count(*) AS BIGINT) AS calls FROM usage GROUP BY model, tag")
def jn_13(lake):
    return lake.usage().groupBy("model", "tag").agg(F.count(F.lit(1)).alias("calls")).select(
        "model", "tag", M.price(F.col("tag"), False).alias("input_price"), M.price(F.col("tag"), True).alias("output_price"), "calls")


add_view("canon", """SELECT run.case_id, run.model, run.round, u.input_tokens, u.output_tokens, u.billing_mode FROM run LEFT JOIN (
    SELECT * FROM usage QUALIFY row_number() OVER (PARTITION BY case_id, model, round ORDER BY seq DESC) = 1) u USING (case_id, model, round)""", "run usage")


@query("jn_14", "canon", "SELECT case_id, model, round, input_tokens, input_tokens IS NULL AS missing FROM canon")
def jn_14(lake):
    return M.canonical_usage(lake.usage(), lake.runs(), RUN_KEYS, "seq").select(*RUN_KEYS, "input_tokens", F.col("input_tokens").isNull().alias("missing"))


_COST = f"""CAST(count(*) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(count(*) FILTER (WHERE billing_mode = 'batch') AS BIGINT) AS batch_calls,
    round(sum(input_tokens * h)::DOUBLE / 2e6 * {_PRICE[1]} + sum(output_tokens * h)::DOUBLE / 2e6 * {_PRICE[2]}, 6) AS list_cost,
    CASE WHEN model LIKE 'gemini%' THEN 0.0::DOUBLE ELSE round(sum(input_tokens * h)::DOUBLE / 2e6 * {_PRICE[1]} + sum(output_tokens * h)::DOUBLE / 2e6 * {_PRICE[2]}, 6) END AS actual_cost"""
_HALF = "(SELECT *, CASE WHEN billing_mode = 'batch' THEN 1 ELSE 2 END AS h FROM %s)"


@query("agg_24", "usage", f"SELECT model, round, {_COST} FROM {_HALF % 'usage'} GROUP BY model, round")
def agg_24(lake):
    return lake.usage().withColumn("m", F.col("model")).groupBy(F.col("m").alias("model_key"), "round").agg(*M.cost_aggregates()).withColumnRenamed("model_key", "model")


@query("agg_25", "usage canon", f"""
    WITH a AS (SELECT 'incurred' AS view, model, {_COST} FROM {_HALF % 'usage'} GROUP BY model
      UNION ALL SELECT 'canonical', model, {_COST} FROM {_HALF % '(SELECT * FROM canon WHERE input_tokens IS NOT NULL)'} GROUP BY model)
    SELECT view, model, calls, input_tokens, output_tokens, list_cost, actual_cost FROM a
    UNION ALL SELECT view, 'total', CAST(sum(calls) AS BIGINT), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT), round(sum(list_cost), 6), round(sum(actual_cost), 6) FROM a GROUP BY view""")
def agg_25(lake):
    """Canonical and incurred cost per model, with totals over the few model rows."""
    canonical = M.canonical_usage(lake.usage(), lake.runs(), RUN_KEYS, "seq").filter("input_tokens is not null")
    fields = ["model", "input_tokens", "output_tokens", "billing_mode"]
    rows = lake.usage().select(F.lit("incurred").alias("view"), *fields).unionByName(canonical.select(F.lit("canonical").alias("view"), *fields))
    per = rows.withColumn("m", F.col("model")).groupBy("view", "m").agg(*M.cost_aggregates()).select(
        "view", F.col("m").alias("model"), "calls", "input_tokens", "output_tokens", "list_cost", "actual_cost")
    total = per.groupBy("view").agg(*[F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens")], *[F.round(F.sum(c), 6).alias(c) for c in ("list_cost", "actual_cost")])
    return per.unionByName(total.withColumn("model", F.lit("total")))


def inventory(lake):
    """Saved outputs with latest usage, matching run event, continuity and temporal status.

    All four meet in one shuffle by case, where digests travel once, as bytes; usage is matched by run,
    events by run and digests, continuity by package.  Equal records count as often as joins of them would.
    """
    k = F.col("case_id")
    package = digest_bytes(row_digest(k)).alias("package_sha")
    output = row_digest(k, F.col("verdict"), F.col("action"))
    outputs = lake.runs().select(*RUN_KEYS, "split", digest_bytes(output).alias("output_sha"), package, (k % 4 == 0).alias("package_newer"))
    events = lake.runs().filter(k % 3 != 0).select(*RUN_KEYS, digest_bytes(F.when(k % 10 == 1, "stale").otherwise(output)).alias("output_sha"), package)
    continuity = lake.outputs().filter(k % 8 == 0).select("case_id", package)
    usage = M.canonical_usage(lake.usage().select(*RUN_KEYS, "seq"), outputs, RUN_KEYS, "seq").select(*RUN_KEYS, F.col("seq").isNotNull().alias("has_usage"))
    found = met({"output": outputs.dropna(subset=RUN_KEYS), "usage": usage.dropna(subset=RUN_KEYS), "event": events.dropna(), "continuity": continuity.dropna()}, "case_id")
    joined = found.withColumn("bound", seen("event", *RUN_KEYS, "output_sha", "package_sha") > 0)
    joined = joined.withColumns({"usages": seen("usage", *RUN_KEYS), "has_usage": F.max("has_usage").over(Window.partitionBy(*RUN_KEYS))})
    joined = joined.filter("kind in ('output', 'continuity')").withColumn("documents", seen("continuity", "case_id", "package_sha")).filter("kind = 'output'")
    joined = joined.withColumn("_", F.explode(F.sequence(F.lit(1), "usages"))).withColumn("_", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "documents"))))
    status = (F.when(F.col("bound"), "api_time_byte_identity").when(~F.col("package_newer"), "package_not_newer_than_output")
              .when(F.col("documents") > 0, "package_newer_but_byte_identity_documented").otherwise("unresolved_package_newer_than_output"))
    return joined.select(*RUN_KEYS, "split", "has_usage", F.when(F.col("bound"), "api_time_bound").otherwise("reconstructed_after_run").alias("binding_status"), status.alias("temporal_status"))


add_view("inv", """SELECT case_id, model, round, split, case_id % 13 <> 0 AS has_usage, CASE WHEN b THEN 'api_time_bound' ELSE 'reconstructed_after_run' END AS binding_status,
    CASE WHEN b THEN 'api_time_byte_identity' WHEN case_id % 4 <> 0 THEN 'package_not_newer_than_output' WHEN case_id % 8 = 0 THEN 'package_newer_but_byte_identity_documented'
         ELSE 'unresolved_package_newer_than_output' END AS temporal_status FROM (SELECT *, case_id % 3 <> 0 AND case_id % 10 <> 1 AS b FROM run)""", "run")


@query("jn_15", "inv", "SELECT * FROM inv")
def jn_15(lake):
    return inventory(lake)


@query("agg_35", "inv", """SELECT binding_status, temporal_status, CAST(count(*) AS BIGINT) AS outputs, CAST(count(*) FILTER (WHERE has_usage) AS BIGINT) AS with_usage FROM inv GROUP BY binding_status, temporal_status""")
def agg_35(lake):
    return inventory(lake).groupBy("binding_status", "temporal_status").agg(F.count(F.lit(1)).alias("outputs"), count_where(F.col("has_usage")).alias("with_usage"))


@query("jn_16", "run", """SELECT model, round, split, case_id, 'missing' AS problem FROM run WHERE case_id % 29 = 0 AND round = 3
    UNION ALL SELECT model, round, split, case_id + 100000000, 'unexpected' FROM run WHERE case_id % 500 = 0""")
def jn_16(lake):
    expected = lake.runs().select("model", "round", "split", "case_id", F.lit(True).alias("e"))
    found = partial_runs(lake).select("model", "round", "split", "case_id")
    stray = lake.runs().filter("case_id % 500 = 0").select("model", "round", "split", (F.col("case_id") + 100000000).alias("case_id"))
    both = expected.join(found.unionByName(stray).withColumn("f", F.lit(True)), ["model", "round", "split", "case_id"], "full_outer")
    return both.filter("e is null or f is null").select("model", "round", "split", "case_id", F.when(F.col("f").isNull(), "missing").otherwise("unexpected").alias("problem"))


def edges(lake):
    return lake.events().select("guid", "parent_guid")


_UP = """WITH RECURSIVE e AS (SELECT guid, parent_guid FROM ev WHERE guid <> parent_guid),
    up(anchor, guid, depth) AS (SELECT guid, guid, 0 FROM ev WHERE event_type = 'error' UNION ALL SELECT u.anchor, e.parent_guid, u.depth + 1 FROM up u JOIN e ON u.guid = e.guid )"""


@query("jn_17", "ev", _UP + """, down(anchor, guid, depth) AS (SELECT guid, guid, 0 FROM ev WHERE event_type = 'error'
      UNION ALL SELECT d.anchor, e.guid, d.depth + 1 FROM down d JOIN e ON d.guid = e.parent_guid )
    SELECT 'up' AS direction, anchor, CAST(count(*) AS BIGINT) AS links, CAST(max(depth) AS INTEGER) AS deepest FROM up WHERE depth > 0 GROUP BY anchor
    UNION ALL SELECT 'down', anchor, CAST(count(*) AS BIGINT), CAST(max(depth) AS INTEGER) FROM down WHERE depth > 0 GROUP BY anchor""")
def jn_17(lake):
    """Ancestors and descendants of every error event."""
    anchors = lake.events().filter("event_type = 'error'").select("guid")
    reach = N.closure(edges(lake))
    parts = [
        walk(reach, anchors).groupBy("anchor").agg(F.count(F.lit(1)).alias("links"), F.max("depth").alias("deepest")).select(F.lit(name).alias("direction"), "anchor", "links", "deepest")
        for name, walk in (("up", N.ancestors), ("down", N.descendants))]
    return parts[0].unionByName(parts[1])


@query("jn_17_roots", "ev", """WITH RECURSIVE up(guid, cur, depth) AS (SELECT guid, guid, 0 FROM ev UNION ALL SELECT u.guid, e.parent_guid, u.depth + 1 FROM up u JOIN ev e ON u.cur = e.guid WHERE e.guid <> e.parent_guid)
    SELECT guid, max_by(cur, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY guid""")
def jn_17_roots(lake):
    """Root and depth of every process by pointer doubling."""
    return N.roots(edges(lake))


@query("jn_18", "ev", _UP + " SELECT event_id, event_type FROM ev WHERE event_code = 3 AND guid IN (SELECT guid FROM up WHERE depth > 0)")
def jn_18(lake):
    anchors = lake.events().filter("event_type = 'error'").select("guid")
    lineage = N.ancestors(N.closure(edges(lake)), anchors).select("guid").distinct()
    return lake.events().filter("event_code = 3").join(lineage, "guid", "left_semi").select("event_id", "event_type")


@query("jn_19", "ev", """
    WITH e AS (SELECT guid AS s, parent_guid AS t FROM ev WHERE event_code <> 1 UNION ALL SELECT parent_guid, guid FROM ev WHERE event_code IN (1, 3))
    SELECT least(s, t) AS low, greatest(s, t) AS high, CAST(count(*) FILTER (WHERE s < t) AS BIGINT) AS forward, CAST(count(*) FILTER (WHERE s > t) AS BIGINT) AS backward FROM e WHERE s <> t GROUP BY 1, 2""")
def jn_19(lake):
    """Both directions of a process pair from one aggregation on the unordered pair, no self-join."""
    ev = lake.events()
    one = ev.filter("event_code <> 1").select(F.col("guid").alias("s"), F.col("parent_guid").alias("t"))
    two = ev.filter("event_code in (1, 3)").select(F.col("parent_guid").alias("s"), F.col("guid").alias("t"))
    s, t = F.col("s"), F.col("t")
    return one.unionByName(two).filter("s <> t").groupBy(F.least(s, t).alias("low"), F.greatest(s, t).alias("high")).agg(
        count_where(s < t).alias("forward"), count_where(s > t).alias("backward"))


_MIN = 60_000_000


@query("jn_20", "ev", f"""SELECT p.computer, p.event_id FROM ev p WHERE p.event_type = 'signup'
    AND NOT EXISTS (SELECT 1 FROM ev q WHERE q.event_type = 'purchase' AND q.computer = p.computer AND q.us >= p.us AND q.us - p.us <= {90 * _MIN})""")
def jn_20(lake):
    ev = lake.events().select("event_id", "computer", "event_type", F.unix_micros("event_time").alias("us"))
    found = T.unconfirmed(ev, "computer", "us", F.col("event_type") == "signup", F.col("event_type") == "purchase", 90 * _MIN)
    return found.select("computer", "event_id")


@query("jn_20_coverage", "ev", """SELECT computer, sensor, CAST(count(*) AS BIGINT) AS events, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY computer, sensor""")
def jn_20_coverage(lake):
    """Scope coverage behind an absence claim: what each sensor saw on each host."""
    us = F.unix_micros("event_time")
    return lake.events().groupBy("computer", "sensor").agg(F.count(F.lit(1)).alias("events"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@query("jn_21", "ev", f"""SELECT p.event_id, EXISTS (SELECT 1 FROM ev q WHERE q.computer = p.computer AND q.sensor <> p.sensor AND abs(q.us - p.us) <= {10 * _MIN}) AS corroborated FROM ev p""")
def jn_21(lake):
    ev = lake.events().select("event_id", "computer", "sensor", F.unix_micros("event_time").alias("us"))
    found = T.corroborated(ev, "computer", "us", "sensor", ["sysmon", "security"], 10 * _MIN)
    return found.select("event_id", (F.col("n_sensors") >= 2).alias("corroborated"))


def doc_lines(lake):
    lines = lake.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.sha2("line", 256).alias("sha256"))


@query("jn_22", sql="""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    SELECT doc_id, CAST(CASE WHEN (doc_id + i) % 70 = 0 THEN i + 100000 ELSE i END AS INTEGER) AS line_no, CASE WHEN (doc_id + i) % 70 = 0 THEN 'absent' ELSE 'mismatch' END AS problem
    FROM l WHERE (doc_id + i) % 70 = 0 OR (doc_id + i) % 50 = 0""")
def jn_22(lake):
    """Declared record hashes against the source lines, by locator."""
    n = F.col("doc_id") + F.col("line_no")
    declared = doc_lines(lake).select("doc_id", F.when(n % 70 == 0, F.col("line_no") + 100000).otherwise(F.col("line_no")).alias("line_no"),
                                      F.when(n % 50 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("sha256")).alias("declared"))
    checked = declared.join(doc_lines(lake), ["doc_id", "line_no"], "left")
    return checked.filter("sha256 is null or sha256 <> declared").select("doc_id", "line_no", F.when(F.col("sha256").isNull(), "absent").otherwise("mismatch").alias("problem"))


@query("jn_22_locators", "ev", """
    SELECT event_id, 'line' AS kind, CASE WHEN event_id % 70 = 0 THEN 'absent' ELSE 'mismatch' END AS problem FROM ev WHERE event_id % 70 = 0 OR event_id % 50 = 0
    UNION ALL SELECT event_id, 'bytes', CASE WHEN event_id % 60 = 0 THEN 'invalid byte range' ELSE 'mismatch' END FROM ev WHERE event_id % 60 = 0 OR event_id % 45 = 0
    UNION ALL SELECT event_id, 'csv', 'absent' FROM ev WHERE event_id % 40 = 0
    UNION ALL SELECT event_id, 'csv', 'id mismatch' FROM ev WHERE event_id % 40 <> 0 AND event_id % 35 = 0
    UNION ALL SELECT event_id, 'csv', 'mismatch' FROM ev WHERE event_id % 40 <> 0 AND event_id % 55 = 0""")
def jn_22_locators(lake):
    """Declared records of line files and of CSV files with quoted line breaks, by all three locators and with seeded faults.

    Places are read from the files, hashes are taken from the table, so a record read from a wrong place would be one more problem.
    """
    events = lake.events().select("event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.coalesce("props", F.lit(""))).alias("value"), "event_type")
    plain, table = scratch_path(lake.spark, "lines"), scratch_path(lake.spark, "csv")
    events.select("value").write.text(plain)
    note = F.concat("value", F.lit("\n\n\"quoted\", end"))
    rows = events.select(F.col("event_id").cast("string").alias("_id"), note.alias("note"), F.col("event_type").alias("a"))
    rows.write.option("header", True).option("escape", '"').csv(table)
    lines, csv_lines = raw_lines(lake.spark, plain, 1 << 20), raw_lines(lake.spark, table, 1 << 20)

    e, none = F.col("event_id"), F.lit(None).cast("bigint")
    tampered = lambda every, digest: F.when(e % every == 0, F.sha2(F.lit("tampered"), 256)).otherwise(digest)
    places = lines.select("file", "line_no", "byte_start", (F.col("byte_end") - 1).alias("byte_end"), F.split_part(line_text(F.col("raw")), F.lit("|"), F.lit(1)).cast("bigint").alias("event_id"))
    placed = places.join(events.select("event_id", F.sha2("value", 256).alias("digest")), "event_id")
    by_line = placed.select("event_id", F.lit("line").alias("kind"), "file", F.when(e % 70 == 0, F.col("line_no") + 1_000_000_000_000).otherwise(F.col("line_no")).alias("number"),
                            none.alias("byte_start"), none.alias("byte_end"), F.lit("").alias("record_id"), tampered(50, F.col("digest")).alias("declared_sha256"))
    by_range = placed.select("event_id", F.lit("bytes").alias("kind"), "file", none.alias("number"), "byte_start", F.when(e % 60 == 0, F.col("byte_start")).otherwise(F.col("byte_end")).alias("byte_end"),
                             F.lit("").alias("record_id"), tampered(45, F.col("digest")).alias("declared_sha256"))
    content = rows.select(F.col("_id").cast("bigint").alias("event_id"), F.sha2(F.to_json(F.struct("_id", "a", "note")), 256).alias("digest"))
    ordinals = csv_records(csv_lines).filter("ordinal > 1").select("file", "ordinal", F.split_part(line_text(F.col("raw")), F.lit(","), F.lit(1)).cast("bigint").alias("event_id")).join(content, "event_id")
    by_ordinal = ordinals.select("event_id", F.lit("csv").alias("kind"), "file", F.when(e % 40 == 0, F.col("ordinal") + 1_000_000_000_000).otherwise(F.col("ordinal")).alias("number"),
                                 none.alias("byte_start"), none.alias("byte_end"), F.when(e % 35 == 0, "other").otherwise(e.cast("string")).alias("record_id"), tampered(55, F.col("digest")).alias("declared_sha256"))
    declared = materialise(by_line.unionByName(by_range).unionByName(by_ordinal), "declared")
    return verify_records(declared, lines, csv_lines, "_id").select("event_id", "kind", "problem")


@query("jn_23", "pkg", """SELECT DISTINCT case_id, evidence_id, record_id, 'differs' AS problem FROM pkg WHERE case_id % 17 = 0 AND evidence_id = 'EV-002'
    UNION ALL SELECT DISTINCT case_id, evidence_id, record_id, 'undeclared_extra' FROM pkg WHERE case_id % 19 = 0 AND evidence_id = 'EV-005'""")
def jn_23(lake):
    """Shared events must be equal in both versions; extras must be the declared ones (EV-003)."""
    key = ["case_id", "evidence_id", "record_id"]
    content = F.sha2(F.concat_ws("|", "flag", "status", "event_time_utc", F.col("attributes")["quantity"]), 256)
    all_events = lake.evidence().groupBy(*key).agg(F.min(content).alias("content"))
    base = all_events.filter("evidence_id <> 'EV-003' and not (case_id % 19 = 0 and evidence_id = 'EV-005')")
    strong = all_events.withColumn("strong", F.when((F.col("case_id") % 17 == 0) & (F.col("evidence_id") == "EV-002"), "changed").otherwise(F.col("content"))).drop("content")
    both = strong.join(base, key, "left")
    problem = F.when(F.col("content").isNull() & (F.col("evidence_id") != "EV-003"), "undeclared_extra").when(F.col("content") != F.col("strong"), "differs")
    return both.select(*key, problem.alias("problem")).filter("problem is not null")


@query("set_01", "ev", "SELECT sensor || ':' || event_id AS record_key FROM ev")
def set_01(lake):
    ev = lake.events()
    parts = [ev.filter(F.col("sensor") == s).select(F.concat(F.lit(s + ":"), "record_key").alias("record_key")) for s in ("sysmon", "security")]
    return parts[0].unionByName(parts[1])


@query("set_03", sql="""SELECT 'orders_only' AS side, o_orderkey AS case_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'lineitem_only', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def set_03(lake):
    orders = lake.table("orders").select(F.col("o_orderkey").alias("case_id")).distinct()
    items = lake.table("lineitem").select(F.col("l_orderkey").alias("case_id")).distinct()
    both = orders.withColumn("o", F.lit(True)).join(items.withColumn("l", F.lit(True)), "case_id", "full_outer")
    return both.filter("o is null or l is null").select(F.when(F.col("l").isNull(), "orders_only").otherwise("lineitem_only").alias("side"), "case_id")


@query("agg_29", sql="""
    WITH n AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1), b AS (SELECT p_brand, count(*) AS c FROM part GROUP BY 1)
    SELECT 'suppliers_per_nation_max' AS rule, CAST(max(c) AS BIGINT) AS observed, CAST(8 AS BIGINT) AS bound, max(c) <= 8 AS pass FROM n
    UNION ALL SELECT 'distinct_brands_min', CAST(count(*) AS BIGINT), CAST(12 AS BIGINT), count(*) >= 12 FROM b
    UNION ALL SELECT 'smallest_brand_min', CAST(min(c) AS BIGINT), CAST(1000000 AS BIGINT), min(c) >= 1000000 FROM b
    UNION ALL SELECT 'types_required', CAST(count(DISTINCT p_type) FILTER (WHERE p_type IN ('ECONOMY', 'SMALL')) AS BIGINT), CAST(2 AS BIGINT),
        count(DISTINCT p_type) FILTER (WHERE p_type IN ('ECONOMY', 'SMALL')) >= 2 FROM part""")
def agg_29(lake):
    """Quota audit: each constraint is one row with what was seen and whether it holds."""
    per_nation = lake.table("supplier").groupBy("s_nationkey").count().agg(F.max("count").alias("v"))
    per_brand = lake.table("part").groupBy("p_brand").count()
    brands = per_brand.agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least"))
    types = lake.table("part").agg(*[F.max((F.col("p_type") == t).cast("bigint")).alias(t) for t in ("ECONOMY", "SMALL")])
    rows = [
        per_nation.select(F.lit("suppliers_per_nation_max").alias("rule"), F.col("v").alias("observed"), F.lit(8).cast("bigint").alias("bound"), (F.col("v") <= 8).alias("pass")),
        brands.select(F.inline_outer(F.array(
            F.struct(F.lit("distinct_brands_min").alias("rule"), F.col("n").alias("observed"), F.lit(12).cast("bigint").alias("bound"), (F.col("n") >= 12).alias("pass")),
            F.struct(F.lit("smallest_brand_min").alias("rule"), F.col("least").alias("observed"), F.lit(1000000).cast("bigint").alias("bound"), (F.col("least") >= 1000000).alias("pass"))))),
        types.select(F.lit("types_required").alias("rule"), (F.col("ECONOMY") + F.col("SMALL")).alias("observed"), F.lit(2).cast("bigint").alias("bound"), (F.col("ECONOMY") + F.col("SMALL") >= 2).alias("pass")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("agg_32", "ev", """SELECT computer, event_code, CAST(count(*) AS BIGINT) AS n, min(us) AS first_us, max(us) AS last_us, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
    string_agg(DISTINCT sensor, '|' ORDER BY sensor) AS sensors FROM ev GROUP BY computer, event_code""")
def agg_32(lake):
    """Search statistics; the listed values are sensor classes, a fixed small set."""
    us = F.unix_micros("event_time")
    return lake.events().groupBy("computer", "event_code").agg(
        F.count(F.lit(1)).alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count_distinct("user_id").alias("users"),
        F.array_join(F.array_sort(F.collect_set("sensor")), "|").alias("sensors"))


@query("agg_36", sql="""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'dev' ELSE 'heldout' END AS split, ['strong', 'weak', 'missing', 'counter'][CAST(o_custkey % 4 + 1 AS INT)] AS condition,
    CASE WHEN o_orderstatus = 'P' THEN 'second' ELSE 'first' END AS corpus, CAST(count(*) AS BIGINT) AS cases FROM orders GROUP BY ALL""")
def agg_36(lake):
    k = F.col("o_orderkey")
    cond = F.get(F.array(*[F.lit(c) for c in ("strong", "weak", "missing", "counter")]), (F.col("o_custkey") % 4).cast("int"))
    return lake.table("orders").groupBy(F.when(k % 2 == 0, "dev").otherwise("heldout").alias("split"), cond.alias("condition"),
                                        F.when(F.col("o_orderstatus") == "P", "second").otherwise("first").alias("corpus")).agg(F.count(F.lit(1)).alias("cases"))


