"""SRC and SNK: readers over files written from the tables, and sinks read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from alertweft.fixed import CASE_LEAK_PATTERN
from alertweft.functions.codec import base64_text
from alertweft.functions.stats import count_where
from alertweft.operators import packages as K, projection as P
from alertweft.operators.integrity import manifest
from alertweft.operators.package_build import build_packages
from alertweft.operators.projection import attribute_text, canonical_from_xml
from alertweft.plans.adapters import add_view
from alertweft.plans.queries.projection import event_xml
from alertweft.plans.queries.scoring import checks
from alertweft.plans.registry import query
from alertweft.session import materialise, scratch_path, ship
from alertweft.sources.byte_ranges import range_hashes
from alertweft.sources import audit_log, exports, lines as L, outputs as O, records as D, sinks, windows as Wd

ship(__name__)


def text_files(lake, rows, label):
    """Write a text column below the shared folder and return the path."""
    path = scratch_path(lake.spark, label)
    rows.write.text(path)
    return path


_SRC1 = "SELECT record_key AS record_id, CAST(event_code AS VARCHAR) AS event_code, computer, time_text AS event_time_utc, attributes FROM evx"


@query("src_01", "evx", _SRC1)
def src_01(lake):
    path = text_files(lake, lake.events().select(event_xml()), "event-xml")
    parsed = canonical_from_xml(Wd.read_event_xml(lake.spark, path))
    return parsed.select("record_id", "event_code", "computer", "event_time_utc", attribute_text(F.col("attributes")).alias("attributes"))


def stanza_text():
    s = lambda c: F.col(c).cast("string")
    return F.concat(
        F.date_format("event_time", "MM/dd/yyyy hh:mm:ss a"), F.lit("\nLogName=Security\nEventCode="), s("event_code"), F.lit("\nComputerName="), F.col("computer"),
        F.lit("\nRecordNumber="), s("event_id"), F.lit("\nMessage=An event.\n\nSubject:\n\tAccount Name:\t\tSYSTEM\n\nNew Logon:\n\tAccount Name:\t\t"), F.col("user"),
        F.lit("\n\tAccount Domain:\t\tCORP\n\nAccount For Which Logon Failed:\n\tAccount Name:\t\t"), F.col("user"), F.lit("x\n\nDetail:\n\tLogon Type:\t\t3\n\tShare Name:\t\tIPC\n"))


add_view("evst", """SELECT *, CASE event_code WHEN 4624 THEN 'target_user_name=' || user_name || '|target_domain_name=CORP|logon_type=3'
    WHEN 4625 THEN 'target_user_name=' || user_name || 'x|logon_type=3' WHEN 5145 THEN 'share_name=IPC|subject_user_name=SYSTEM' ELSE '' END AS attributes FROM ev""", "ev")


def stanzas(lake):
    return Wd.read_stanzas(lake.spark, text_files(lake, lake.spread_events().select(stanza_text()), "stanza"))


@query("src_02", "ev", "SELECT event_code, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(event_id) AS BIGINT) AS id_sum FROM ev GROUP BY event_code")
def src_02(lake):
    raws = stanzas(lake).select(Wd.stanza_value(F.col("raw"), "EventCode").cast("int").alias("event_code"), Wd.stanza_value(F.col("raw"), "RecordNumber").cast("bigint").alias("id"))
    return raws.groupBy("event_code").agg(F.count(F.lit(1)).alias("blocks"), F.sum("id").alias("id_sum"))


@query("src_03", "evst", "SELECT record_key AS record_id, CAST(event_code AS VARCHAR) AS event_code, computer, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000000000Z' AS event_time_utc, attributes FROM evst")
def src_03(lake):
    parsed = Wd.canonical_from_stanza(stanzas(lake))
    return parsed.select("record_id", "event_code", "computer", "event_time_utc", attribute_text(F.col("attributes")).alias("attributes"))


def flat_json(lake):
    """Flat NDJSON with a malformed line after every event divisible by 50, and blanks."""
    s = lambda c: F.col(c).cast("string")
    body = F.to_json(F.struct(
        F.when(F.col("k") % 2 == 0, "13").otherwise(s("event_code")).alias("EventID"), F.when(F.col("sensor") == "sysmon", "Microsoft-Windows-Sysmon/Operational").otherwise("Security").alias("Channel"),
        F.col("computer").alias("Hostname"), F.col("event_time_utc").alias("UtcTime"), F.lit("INFO").alias("EventType"), F.col("event_type").alias("Image"),
        F.when(F.col("k") % 5 == 0, "").otherwise(F.col("user")).alias("TargetUserName"), F.lit("").alias("Empty"), F.col("event_id").alias("RecordNumber"), F.lit("x").alias("port")))
    return text_files(lake, lake.events().select(F.when(F.col("event_id") % 50 == 0, F.concat(body, F.lit("\n{broken"))).otherwise(body)), "flat-json")


@query("src_04", "ev", "SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT event_id) AS BIGINT) AS ids, CAST(sum(event_id) AS BIGINT) AS id_sum FROM ev")
def src_04(lake):
    f = F.col("fields")["RecordNumber"].cast("bigint")
    return D.read_flat_json(lake.spark, flat_json(lake)).agg(F.count(F.lit(1)).alias("events"), F.count_distinct(f).alias("ids"), F.sum(f).alias("id_sum"))


@query("src_05", "ev", """SELECT record_key AS record_id, CASE WHEN k % 2 = 0 THEN '13' ELSE CAST(event_code AS VARCHAR) END AS event_code, sensor, computer,
    CASE WHEN sensor = 'sysmon' THEN 'Microsoft-Windows-Sysmon' ELSE 'Microsoft-Windows-Security-Auditing' END AS provider, time_text AS event_time_utc,
    CASE WHEN k % 2 = 0 THEN 'image=' || event_type || '|registry_event=SetValue' WHEN event_code IN (1, 3) THEN 'image=' || event_type
         WHEN event_code IN (4624, 4625) AND k % 5 <> 0 THEN 'target_user_name=' || user_name ELSE '' END AS attributes FROM ev""")
def src_05(lake):
    parsed = D.read_flat_events(lake.spark, flat_json(lake))
    return parsed.select("record_id", "event_code", "sensor", "computer", "provider", "event_time_utc", attribute_text(F.col("attributes")).alias("attributes"))


@query("src_06", "ev", "SELECT record_key AS record_id FROM ev WHERE k % 4 <> 3")
def src_06(lake):
    raw = event_xml()
    k = F.col("k") % 4
    plain, wrapped = F.to_json(F.struct(raw.alias("_raw"))), F.to_json(F.struct(F.lit(False).alias("preview"), F.struct(raw.alias("raw")).alias("result")))
    many = F.to_json(F.struct(F.array(F.struct(raw.alias("_raw")), F.struct(F.lit("no event").alias("_raw"))).alias("results")))
    line = F.when(k == 0, plain).when(k == 1, wrapped).when(k == 2, many).otherwise(F.lit('{"_raw": "just text"}'))
    rows = exports.load_export(lake.spark, text_files(lake, lake.events().select(line), "export"))
    return rows.select(P.xml_tag(F.col("raw"), "EventRecordID").alias("record_id"))


add_view("mixed", "SELECT evx.event_id, CASE WHEN evx.k % 2 = 0 THEN evx.attributes ELSE evst.attributes END AS attributes FROM evx JOIN evst USING (event_id)", "evx evst")


@query("src_07", "mixed", "SELECT CAST(event_id AS VARCHAR) AS record_id, attributes FROM mixed")
def src_07(lake):
    raws = lake.spread_events().select(F.when(F.col("k") % 2 == 0, event_xml()).otherwise(stanza_text()).alias("raw"))
    return Wd.canonical_mixed(raws).select("record_id", attribute_text(F.col("attributes")).alias("attributes"))


@query("src_08", sql=r"""
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS record_key, CAST(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 ELSE 0 END AS INTEGER) AS event_code,
           CASE l_linenumber WHEN 1 THEN 'process_create' WHEN 2 THEN 'network_connection' WHEN 3 THEN 'image_load' WHEN 4 THEN 'monitoring_status' ELSE 'external_record' END AS event_type,
           'host-' || l_suppkey AS computer, 'C:\bin\' || l_returnflag AS parent_image, CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'line one' || chr(10) || 'two "q"' END AS rule_name FROM lineitem""")
def src_08(lake):
    n = F.col("l_linenumber")
    flat = lake.table("lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string"), F.col("l_partkey").cast("string")).alias("_id"), F.lit("idx").alias("_index"),
        F.when(n == 4, "ossec: Agent disconnected: 'x'").otherwise("").alias("_source.full_log"), F.concat(F.lit("host-"), F.col("l_suppkey").cast("string")).alias("_source.agent.name"),
        F.when(n == 1, "1").when(n == 2, "3").when(n == 3, " 7 ").otherwise("n/a").alias("_source.data.win.system.eventID"),
        F.concat(F.lit("C:\\\\bin\\\\"), F.col("l_returnflag")).alias("_source.data.win.eventdata.parentImage"),
        F.when(F.col("l_linestatus") == "O", " ").otherwise('line one\ntwo "q"').alias("_source.data.win.eventdata.ruleName"))
    path = scratch_path(lake.spark, "wide-csv")
    flat.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    parsed = Wd.read_wide_csv(lake.spark, path)
    return parsed.select("record_key", "event_code", "event_type", "computer", F.col("attributes")["parent_image"].alias("parent_image"), F.col("attributes")["rule_name"].alias("rule_name"))


@query("src_09", "ev", "SELECT 'log-' || user_id % 5 || ':line:' || row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS record_key, CASE WHEN k % 2 = 0 THEN computer ELSE 'aminer' END AS computer, CAST(k AS VARCHAR) AS record_k FROM ev")
def src_09(lake):
    """JSON lines of members with locators; members come from the user groups."""
    from alertweft.functions.ranking import split_row_number
    agent = F.when(F.col("k") % 2 == 0, F.col("computer"))
    body = F.to_json(F.struct(F.col("event_time_utc").alias("@timestamp"), F.struct(agent.alias("name")).alias("agent"), F.struct(F.lit("aminer").alias("ID")).alias("AMiner"), F.col("k")))
    rows = lake.events().select("event_id", F.concat(F.lit("log-"), (F.col("user_id") % 5).cast("string")).alias("member"), body.alias("line"))
    numbered = split_row_number(rows, ["member"], F.floor(F.col("event_id") / 100000), [F.col("event_id")], "line_no")
    return D.json_members(numbered).select("record_key", "computer", F.try_variant_get("record", "$.k", "string").alias("record_k"))


@query("src_10", sql="""SELECT 'doc-' || doc_id || ':line:' || i AS record_key, CASE WHEN i = 1 THEN 1765796989444000 + doc_id * 1000000 END AS us, md5(rtrim(line, ' ')) AS digest
    FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i
          FROM (SELECT doc_id, 'type=X msg=audit(' || (1765796989 + doc_id) || '.444:1): ' || text AS body FROM documents)) WHERE rtrim(line, ' ') <> ''""")
def src_10(lake):
    body = F.concat(F.lit("type=X msg=audit("), (F.lit(1765796989) + F.col("doc_id")).cast("string"), F.lit(".444:1): "), F.col("text"))
    lines = lake.table("documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("member"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    parsed = D.text_members(lines.withColumn("line_no", F.col("pos") + 1))
    return parsed.select("record_key", F.unix_micros("event_time").alias("us"), F.md5("raw_text").alias("digest"))


@query("src_11", "ev", """SELECT 'm' || user_id % 3 || ':audit:' || (user_id * 1000000 + us // 60000000 % 1000000) AS record_key, CAST(count(*) AS BIGINT) AS n_lines, min(event_id) AS first_line
    FROM ev GROUP BY user_id, us // 60000000, user_id % 3""")
def src_11(lake):
    us = F.unix_micros("event_time")
    serial = F.col("user_id") * 1000000 + F.floor(us / 60000000) % 1000000
    line = F.concat(F.lit("type=PATH msg=audit("), F.floor(us / 1000000).cast("string"), F.lit(".5:"), serial.cast("string"), F.lit("): syscall=59 item="), F.col("event_id").cast("string"))
    rows = lake.events().select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("member"), F.col("event_id").alias("line_no"), line.alias("line"))
    grouped = audit_log.group_records(rows)
    return grouped.select("record_key", F.size(F.split("raw_text", "\n")).cast("bigint").alias("n_lines"), F.col("first_line"))


@query("src_12", sql="SELECT doc_id, CAST(2 AS BIGINT) AS blocks, CAST(1 AS INTEGER) AS first_code, '2025-01-01T10:00:00.5Z' AS second_time FROM documents")
def src_12(lake):
    """Two blocks per document, the whole text in the second one."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    body = F.concat(F.lit("preamble\nInformation\tMicrosoft-Windows-Sysmon\t1\tx\nmore\nError\tother\n2025-01-01 10:00:00.5\n"), F.regexp_replace("text", "(?m)^(?=(Information|Error|Warning)\t)", " "))
    lines = lake.table("documents").select(name.alias("file"), F.lit(0).alias("chunk"), F.posexplode(F.split(body, "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    found = Wd.canonical_blocks(L.blocks(lines, F.col("line").rlike(Wd.BLOCK_HEAD)))
    return found.groupBy(F.split_part("file", F.lit("-"), F.lit(2)).cast("bigint").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("blocks"), F.max(F.when(F.col("block_index") == 1, F.col("event_code"))).alias("first_code"),
        F.max(F.when(F.col("block_index") == 2, F.col("event_time_utc"))).alias("second_time"))


def _zip_bytes(batches):
    """One archive per (user group): members by event type, one line per event."""
    for batch in batches:
        for group, lines in batch.groupby("g"):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                for kind, part in lines.groupby("event_type"):
                    archive.writestr(f"logs/{kind}.log", "\n".join(part.sort_values("event_id")["line"]) + "\n")
            yield pd.DataFrame({"g": [group], "content": [buffer.getvalue()]})


def archives(lake):
    """Archive lines of ZIP files packed from the events, held as a table in the shared folder."""
    rows = lake.events().select(F.concat((F.col("user_id") % 4).cast("string"), F.lit("-"), F.spark_partition_id().cast("string")).alias("g"), "event_type", "event_id", F.col("props").alias("line"))
    packed = rows.mapInPandas(_zip_bytes, "g string, content binary")
    return D.expand_archives(materialise(packed.select(F.concat("g", F.lit(".zip")).alias("path"), "content"), "zip"))


@query("src_13", "ev", "SELECT 'logs/' || event_type || '.log' AS member, CAST(count(*) AS BIGINT) AS lines, CAST(sum(k) AS BIGINT) AS k_sum FROM ev GROUP BY event_type")
def src_13(lake):
    lines = archives(lake)
    return lines.groupBy("member").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.get_json_object("line", "$.k").cast("bigint")).alias("k_sum"))


@query("src_14", "ev", "SELECT 'json' AS format, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS records FROM ev UNION ALL SELECT 'text', CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) FROM ev")
def src_14(lake):
    lines = lake.events().select(F.concat("event_type", F.lit(".log")).alias("member"), F.col("event_id").alias("line_no"), F.col("props").alias("line"))
    kinds = ["view", "click", "signup", "purchase"]
    rows = D.dispatch(lines, {"json": ["error.log"], "text": [f"{k}.log" for k in kinds]})
    return rows.groupBy(F.when(F.col("record").isNull(), "text").otherwise("json").alias("format")).agg(F.count(F.lit(1)).alias("records"))


add_view("cases", """SELECT o_orderkey AS case_id, 1 + o_orderkey % 2 AS tier, ['strong', 'weak', 'missing', 'counter'][CAST(o_custkey % 4 + 1 AS INT)] AS condition,
    CASE WHEN o_orderkey % 2 = 0 THEN 'dev' ELSE 'heldout' END AS split FROM orders""")


def case_tree(lake):
    """Case files below tier/condition/split; every thousandth case id appears twice."""
    path = scratch_path(lake.spark, "cases")
    k = F.col("case_id")
    cases = lake.truth().select(k, (1 + k % 2).alias("tier"), "condition", F.when(k % 2 == 0, "dev").otherwise("heldout").alias("split"))
    again = cases.filter(k % 1000 == 0).withColumn("tier", F.lit(2))
    cases.unionByName(again).write.partitionBy("tier", "condition", "split").json(path)
    return path


def discovered(lake):
    where = F.col("_metadata.file_path")
    part = lambda n: F.regexp_extract(where, rf"/{n}=([^/]+)/", 1)
    rows = lake.spark.read.schema("case_id bigint").option("recursiveFileLookup", "true").json(case_tree(lake))
    return rows.select("case_id", part("tier").cast("int").alias("tier"), part("condition").alias("condition"), part("split").alias("split"))


@query("src_15", "cases", """SELECT CAST(tier AS INTEGER) AS tier, condition, split, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE case_id % 1000 = 0) AS BIGINT) AS duplicated
    FROM (SELECT * FROM cases UNION ALL SELECT case_id, 2, condition, split FROM cases WHERE case_id % 1000 = 0) GROUP BY tier, condition, split""")
def src_15(lake):
    """Partition columns from the path; ids that occur twice are counted per cell."""
    found = discovered(lake)
    twice = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(twice, "case_id").groupBy("tier", "condition", "split").agg(
        F.count(F.lit(1)).alias("cases"), count_where(F.col("n") > 1).alias("duplicated"))


@query("src_16", sql="SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'P' THEN 'external' ELSE 'canonical' END AS case_set FROM orders")
def src_16(lake):
    orders = lake.table("orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus")
    canonical = orders.filter("o_orderstatus <> 'P'").select("case_id", F.lit("canonical").alias("case_set"))
    external = orders.filter("o_orderstatus = 'P'").select("case_id", F.lit("external").alias("case_set"))
    return canonical.unionByName(external).orderBy("case_id")


@query("src_17", "run", """SELECT model, CASE WHEN round > 1 THEN round ELSE 1 END AS round, split, CAST(count(*) AS BIGINT) AS outputs FROM run GROUP BY ALL""")
def src_17(lake):
    """Outputs saved by tag, with two kinds of tags that must be skipped."""
    path = scratch_path(lake.spark, "outputs")
    rows = lake.runs().select("case_id", "verdict", "split", O.build_tag(F.col("model"), F.lit("A2"), F.col("round")).alias("tag"))
    extra = rows.filter("case_id % 100 = 0")
    skipped = extra.withColumn("tag", F.concat(F.lit("void-"), "tag")).unionByName(extra.withColumn("tag", F.lit("m__EXP_1")))
    rows.unionByName(skipped).write.partitionBy("tag", "split").json(path)
    found = O.read_outputs(lake.spark, path, "case_id bigint, verdict string")
    return found.groupBy("model", "round", "split").agg(F.count(F.lit(1)).alias("outputs"))


@query("src_18", "usage", "SELECT case_id, model, round, seq, input_tokens FROM usage")
def src_18(lake):
    path = scratch_path(lake.spark, "usage")
    sinks.append_log(lake.usage(), path)
    return lake.spark.read.schema("case_id bigint, model string, round int, seq int, input_tokens bigint").json(path)


@query("src_19")
def src_19(lake):
    """A missing source resolves to the one staged file with the expected hash."""
    path = scratch_path(lake.spark, "staged")
    lake.events().select("event_type", F.concat_ws("|", "record_key", "props").alias("value")).write.partitionBy("event_type").text(path)
    staged = lake.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select(
        "path", F.sha2("content", 256).alias("sha256"))
    wanted = staged.select("sha256", F.concat(F.lit("/gone/"), F.element_at(F.split("path", "/"), -2)).alias("declared")).unionAll(
        staged.limit(1).select(F.sha2(F.lit("nothing"), 256).alias("sha256"), F.lit("/gone/none").alias("declared")))
    return resolve_by_hash(wanted, staged)


def resolve_by_hash(wanted, staged):
    """(declared, matches, path): usable only when exactly one staged file has the hash."""
    hits = wanted.join(staged, "sha256", "left").groupBy("declared", "sha256").agg(F.count("path").alias("matches"), F.min("path").alias("path"))
    return hits.withColumn("path", F.when(F.col("matches") == 1, F.col("path")))


@query("udf_04", "ev", "SELECT event_type || '.log' AS requested, CAST(1 AS BIGINT) AS matches, 'logs/' || event_type || '.log' AS member FROM ev GROUP BY event_type UNION ALL SELECT 'none.log', CAST(0 AS BIGINT), NULL")
def udf_04(lake):
    """Archive expansion and unique suffix resolution of requested members."""
    members = archives(lake)
    names = lake.events().select(F.concat("event_type", F.lit(".log")).alias("requested")).distinct()
    missing = names.limit(1).select(F.lit("none.log").alias("requested"))
    one = members.select(F.lit("a").alias("archive"), "member").distinct()
    return D.resolve_members(one, names.unionByName(missing))


@query("snk_01", "pkg der", """SELECT p.case_id, CAST(count(*) AS BIGINT) AS event_count, CAST(count(*) FILTER (WHERE evidence_id <> 'A0') AS BIGINT) AS items, bool_or(evidence_id = 'A0') AS has_alert,
    p.case_id IN (SELECT case_id FROM der) AS has_derivation FROM pkg p GROUP BY p.case_id""")
def snk_01(lake):
    path = scratch_path(lake.spark, "packages")
    sinks.write_documents(K.documents(lake.evidence(), lake.derivations()), path)
    back = lake.spark.read.schema("case_id bigint, event_count bigint, main_alert struct<evidence_id:string>, evidence_items array<struct<evidence_id:string>>, deterministic_derivations array<struct<derivation_id:string>>").json(path)
    return back.select("case_id", "event_count", F.coalesce(F.size("evidence_items"), F.lit(0)).cast("bigint").alias("items"),
                       F.col("main_alert.evidence_id").isNotNull().alias("has_alert"), F.col("deterministic_derivations").isNotNull().alias("has_derivation"))


@query("snk_01_build", "ev", """
    WITH a AS (SELECT user_id, arg_min(event_id, (us, event_id)) AS alert FROM ev WHERE event_type = 'error' GROUP BY 1),
    s AS (SELECT ev.*, ev.event_id = a.alert AS is_alert FROM ev JOIN a USING (user_id) WHERE ev.event_id = a.alert OR ev.event_type = 'purchase'),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, is_alert ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), record_key) AS rn FROM s)
    SELECT user_id AS case_id, CAST(count(*) AS BIGINT) AS event_count, max(record_key) FILTER (WHERE is_alert) AS alert_record,
        CAST(count(*) FILTER (WHERE NOT is_alert) AS INTEGER) AS items, max(record_key) FILTER (WHERE NOT is_alert AND rn = 1) AS first_record,
        min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) AS start, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) AS "end",
        string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types, 'host-01' AS computers, 'user-01' AS users, 'host-01 by user-01' AS derived
    FROM n GROUP BY user_id""")
def snk_01_build(lake):
    """Packages built from raw events: the first error of a user with all the user's purchases."""
    ev = lake.events().withColumn("record_id", F.col("record_key")).withColumns({"provider": F.lit("p"), "channel": F.lit("c")})
    alerts = ev.where("event_type = 'error'").groupBy("user_id").agg(F.min_by("event_id", F.struct("event_time", "event_id")).alias("alert"))
    picked = ev.join(alerts, "user_id").where("event_id = alert or event_type = 'purchase'")
    selection = picked.select(F.col("user_id").alias("case_id"), "record_id", (F.col("event_id") == F.col("alert")).alias("is_alert"))
    # one decoded value per case; it names the host and the user, so it must come out with their pseudonyms
    told = F.concat("computer", F.lit(" by "), "user")
    blob = F.concat(F.lit("x -enc "), base64_text(F.encode(told, "UTF-16LE")))
    events = ev.withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("command_line"), blob)))
    specs = alerts.select(F.col("user_id").alias("case_id"), F.lit("DER-001").alias("derivation_id"), F.lit("A0").alias("source_evidence_id"), F.lit("command_line").alias("source_field"),
                          F.lit("base64_utf16le").alias("method"), F.lit("decoded").alias("derived_field"), F.lit("decoded").alias("note"))
    exclusions = alerts.select(F.col("user_id").alias("case_id"), F.lit("A0").alias("evidence_id"), F.lit("command_line").alias("field"))
    documents, _ = build_packages(events.select("record_id", "event_time_utc", "event_type", "provider", "channel", "event_code", "computer", "attributes"),
                                  selection, specs, exclusions, ["table"])
    seen = F.col("observed_context")
    return documents.select(
        "case_id", seen["event_count"].alias("event_count"), F.col("main_alert.source_event.event_record_id").alias("alert_record"), F.size("evidence_items").alias("items"),
        F.get("evidence_items", F.lit(0))["source_event"]["event_record_id"].alias("first_record"), seen["time_window_utc"]["start"].alias("start"),
        seen["time_window_utc"]["end"].alias("end"), F.array_join(seen["event_types_present"], "|").alias("types"), F.array_join(seen["computers"], "|").alias("computers"),
        F.array_join(seen["users"], "|").alias("users"), F.get("deterministic_derivations", F.lit(0))["value"].alias("derived"))


@query("snk_02", "o", "SELECT case_id, array_to_string(key_evidence, '|') AS key_evidence, rationale, action FROM o")
def snk_02(lake):
    path = scratch_path(lake.spark, "report")
    sinks.write_report(lake.outputs().select("case_id", "key_evidence", "rationale", "action"), path)
    return lake.spark.read.csv(path, header=True, schema="case_id bigint, key_evidence string, rationale string, action string", quote='"', escape='"')


@query("snk_03", "chk", "SELECT condition, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE c2) AS BIGINT) AS c2_n FROM chk GROUP BY condition")
def snk_03(lake):
    path = scratch_path(lake.spark, "metrics")
    sinks.write_report(checks(lake).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), count_where(F.col("c2")).alias("c2_n")), path)
    return lake.spark.read.csv(path, header=True, schema="condition string, n bigint, c2_n bigint")


@query("snk_04", "usage", "SELECT seq, CAST(count(*) AS BIGINT) AS rows FROM usage GROUP BY seq")
def snk_04(lake):
    """Two appends to one log."""
    path = scratch_path(lake.spark, "log")
    for part in (1, 2):
        sinks.append_log(lake.usage().filter(F.col("seq") == part), path)
    return lake.spark.read.schema("seq int").json(path).groupBy("seq").agg(F.count(F.lit(1)).alias("rows"))


@query("snk_05", "o pkg", "SELECT case_id, action FROM o WHERE case_id NOT IN (SELECT case_id FROM pkg)")
def snk_05(lake):
    return sinks.pending(lake.outputs(), lake.evidence().select("case_id").distinct(), "case_id").select("case_id", "action")


@query("snk_06", "pkg", "SELECT case_id, evidence_id, record_id, computer, flag FROM pkg")
def snk_06(lake):
    return sinks.publish(lake.evidence(), ["case_id", "evidence_id", "record_id", "computer", "flag"], [CASE_LEAK_PATTERN], scratch_path(lake.spark, "neutral"))


@query("snk_07", "o", "SELECT 'MODIFIED' AS status, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'SAME', CAST(count(*) AS BIGINT) FROM o")
def snk_07(lake):
    """Staged copy is read back and its row hashes are reconciled with the originals."""
    status = sinks.freeze(lake.outputs().select("case_id", "rationale", "action"), "case_id", scratch_path(lake.spark, "inputs"))
    return status.agg(count_where(F.col("status") != "SAME").alias("m"), count_where(F.col("status") == "SAME").alias("s")).select(
        F.inline_outer(F.array(F.struct(F.lit("MODIFIED").alias("status"), F.col("m").alias("n")), F.struct(F.lit("SAME").alias("status"), F.col("s").alias("n")))))


_KNOWN_TEXT = "CASE WHEN event_id % 7 = 0 THEN upper(event_type) ELSE event_type END || '|' || event_id || '|' || coalesce(props, '')"


def _known_line():
    kind = F.col("event_type")
    return F.concat_ws("|", F.when(F.col("event_id") % 7 == 0, F.upper(kind)).otherwise(kind), F.col("event_id").cast("string"), F.coalesce("props", F.lit("")))


def known_tree(lake):
    """One text file of known content per event type: its events, one line each, by id."""
    path = scratch_path(lake.spark, "known")
    kind, line = F.col("event_type"), _known_line()
    lake.table("events").select(kind.alias("kind"), "event_id", line.alias("value")).repartition("kind").sortWithinPartitions("kind", "event_id").select(
        "kind", "value").write.partitionBy("kind").text(path)
    return path


@query("int_01_known", sql=f"SELECT event_type AS kind, CAST(sum(strlen(v) + 1) AS BIGINT) AS bytes, sha256(string_agg(v || chr(10), '' ORDER BY event_id)) AS sha256 FROM (SELECT *, {_KNOWN_TEXT} AS v FROM events) GROUP BY event_type")
def int_01_known(lake):
    """Manifest of files whose content is known."""
    rows = manifest(lake.spark, known_tree(lake))
    return rows.select(F.regexp_extract("path", "kind=([^/]*)/", 1).alias("kind"), "bytes", "sha256")


@query("src_19_known", sql=f"""
    WITH f AS (SELECT event_type, sha256(string_agg(v || chr(10), '' ORDER BY event_id)) AS h FROM (SELECT *, {_KNOWN_TEXT} AS v FROM events) GROUP BY event_type)
    SELECT '/gone/' || event_type AS declared, CAST(1 AS BIGINT) AS matches, event_type AS found FROM f UNION ALL SELECT '/gone/changed-' || event_type, CAST(0 AS BIGINT), NULL FROM f""")
def src_19_known(lake):
    """Sources that are not where they were declared, found by a hash taken from the table; changed content is not found."""
    staged = manifest(lake.spark, known_tree(lake)).select("path", "sha256")
    lines = lake.table("events").select("event_type", "event_id", F.concat(_known_line(), F.lit("\n")).alias("value"))
    text = lines.groupBy("event_type").agg(F.expr("listagg(value) within group (order by event_id)").alias("t"))
    wanted = text.select(F.concat(F.lit("/gone/"), "event_type").alias("declared"), F.sha2("t", 256).alias("sha256")).unionAll(
        text.select(F.concat(F.lit("/gone/changed-"), "event_type"), F.sha2(F.concat("t", F.lit("\n")), 256)))
    found = resolve_by_hash(wanted, staged)
    return found.select("declared", "matches", F.nullif(F.regexp_extract("path", "kind=([^/]*)/", 1), F.lit("")).alias("found"))


_BLOCK_TEXT = "regexp_replace(coalesce(text, ''), '(?m)^(Information|Error|Warning)\\t', ' \\1' || chr(9), 'g')"


@query("src_12_ranges", sql=f"""
    WITH b AS (SELECT doc_id, 'Error' || chr(9) || 'doc-' || doc_id || chr(10) || '2025-01-01 10:00:00.5' || chr(10) || {_BLOCK_TEXT} || chr(10) AS t FROM documents)
    SELECT doc_id, CAST(strlen('Information' || chr(9) || 'Microsoft-Windows-Sysmon' || chr(9) || '1' || chr(9) || 'doc-' || doc_id || chr(10)) AS BIGINT) AS first_bytes, CAST(1 AS INTEGER) AS first_code,
        CAST(strlen(t) AS BIGINT) AS second_bytes, sha256(t) AS second_sha256, '2025-01-01T10:00:00.5Z' AS second_time FROM b""")
def src_12_ranges(lake):
    """Files of two blocks per document, read in ranges of 64 KB that cut blocks anywhere; the bytes of each second block are hashed by its range."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    body = F.concat(F.lit("Information\tMicrosoft-Windows-Sysmon\t1\t"), name, F.lit("\nError\t"), name, F.lit("\n2025-01-01 10:00:00.5\n"),
                    F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^(Information|Error|Warning)\t", " $1\t"))
    path = text_files(lake, lake.table("documents").select(body.alias("value")), "block-files")
    found = materialise(Wd.read_blocks(lake.spark, path, 1 << 16).withColumn("doc_id", F.regexp_extract("raw_text", r"\tdoc-(\d+)(?:\n|\z)", 1).cast("bigint")), "blocks")
    first = found.filter("event_code = 1").select("doc_id", (F.col("byte_end") - F.col("byte_start")).alias("first_bytes"), F.col("event_code").alias("first_code"))
    second = range_hashes(found.filter("event_code = 0").select("doc_id", "file", "byte_start", "byte_end", "event_time_utc"))
    return first.join(second, "doc_id").select(
        "doc_id", "first_bytes", "first_code", (F.col("byte_end") - F.col("byte_start")).alias("second_bytes"), F.col("sha256").alias("second_sha256"), F.col("event_time_utc").alias("second_time"))
