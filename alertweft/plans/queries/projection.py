"""PRJ: event normalisation and package assembly."""

from __future__ import annotations

from pyspark.sql import functions as F


from alertweft.functions.text import domain_user, snake_case, unescape_entities
from alertweft.functions.times import parse_time
from alertweft.operators import packages as K, projection as P
from alertweft.plans.adapters import _case_of, add_view
from alertweft.plans.registry import query


def entries_of(**fields):
    return F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items()])


def raw_fields(ev):
    """(name, value) entries of an event, with blank and irrelevant ones."""
    return entries_of(
        Image=F.concat("event_type", F.lit(".exe")), CommandLine=F.when(F.col("k") % 2 == 0, F.concat(F.lit("run "), F.col("k").cast("string"))).otherwise(""),
        User=F.col("user"), SourceIp=F.concat(F.lit("10.0.0."), F.col("k").cast("string")), TargetUserName=F.col("user"), LogonType=F.lit("3"),
        ShareName=F.lit("\\\\*\\SYSVOL"), SubjectUserName=F.col("user"), Unmapped=F.lit("x"))


@query("prj_01", "ev", r"""
    SELECT event_id, CASE event_code WHEN 1 THEN 'process_create' WHEN 3 THEN 'network_connection' WHEN 4624 THEN 'logon' WHEN 4625 THEN 'failed_logon'
           ELSE 'network_share_object_access' END AS type,
           CASE event_code WHEN 1 THEN 'image=' || event_type || '.exe' || CASE WHEN k % 2 = 0 THEN '|command_line=run ' || k ELSE '' END || '|user=' || user_name
             WHEN 3 THEN 'image=' || event_type || '.exe|user=' || user_name || '|source_ip=10.0.0.' || k
             WHEN 5145 THEN 'share_name=\\*\SYSVOL|subject_user_name=' || user_name
             ELSE 'target_user_name=' || user_name || '|logon_type=3|subject_user_name=' || user_name END AS attributes FROM ev""")
def prj_01(lake):
    ev = lake.events()
    mapped = P.project_attributes(ev.drop("attributes"), F.col("event_code"), raw_fields(ev))
    return mapped.select("event_id", P.event_type(F.col("event_code")).alias("type"), P.attribute_text(F.col("attributes")).alias("attributes"))


@query("prj_02", "ev", """
    SELECT event_id, CASE k % 4 WHEN 0 THEN 'source_process_guid=G' || event_id WHEN 1 THEN 'source_process_guid=g' || event_id
        WHEN 2 THEN 'source_process_guid=G' || event_id ELSE '' END AS attributes FROM ev""")
def prj_02(lake):
    """Alternate names: the first present one wins; a blank first name hides the second."""
    k, e = F.col("k") % 4, F.col("event_id").cast("string")
    upper = F.struct(F.lit("SourceProcessGUID").alias("k"), F.when(k == 3, "").otherwise(F.concat(F.lit("G"), e)).alias("v"))
    lower = F.struct(F.lit("SourceProcessGuid").alias("k"), F.concat(F.lit("g"), e).alias("v"))
    data = F.when(k == 0, F.array(upper)).when(k == 1, F.array(lower)).otherwise(F.array(lower, upper))
    return P.project_attributes(lake.events(), F.lit("10"), data).select("event_id", P.attribute_text(F.col("attributes")).alias("attributes"))


@query("prj_03", sql="""SELECT l_orderkey AS case_id, l_linenumber AS line_no, CAST(l_partkey AS VARCHAR) AS first_value, CAST(l_suppkey AS VARCHAR) AS last_value, l_linestatus AS other
    FROM lineitem""")
def prj_03(lake):
    pair = lambda name, v: F.struct(F.lit(name).alias("k"), F.col(v).cast("string").alias("v"))
    data = F.array(pair("x", "l_partkey"), pair("y", "l_linestatus"), pair("x", "l_suppkey"))
    maps = P.stage_entries(lake.table("lineitem"), data).select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line_no"), P.first_wins().alias("first"), P.last_wins().alias("last"))
    return maps.select("case_id", "line_no", F.col("first")["x"].alias("first_value"), F.col("last")["x"].alias("last_value"), F.col("last")["y"].alias("other"))


@query("prj_04", "ev", r"""SELECT event_id, 'other' AS type, 'Image=' || event_type || '.exe|CommandLine=' || CASE WHEN k % 2 = 0 THEN 'run ' || k ELSE '' END || '|User=' || user_name
    || '|SourceIp=10.0.0.' || k || '|TargetUserName=' || user_name || '|LogonType=3|ShareName=\\*\SYSVOL|SubjectUserName=' || user_name || '|Unmapped=x' AS attributes FROM ev""")
def prj_04(lake):
    ev = lake.events()
    mapped = P.project_attributes(ev, F.lit("9999"), raw_fields(ev))
    return mapped.select("event_id", P.event_type(F.lit(9999)).alias("type"), P.attribute_text(F.col("attributes")).alias("attributes"))


def escape(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


@query("prj_05", sql=r"""
    SELECT page_id, '\T' || page_id AS task_name, CASE WHEN page_id % 2 = 0 THEN 'CORP\u' || page_id ELSE 'u' || page_id END AS subject_user, url AS action_command,
           md5(trim(html)) AS arguments_md5, CASE WHEN page_id % 3 = 0 THEN 'S-1-5-18' ELSE 'S-1-5-32' END AS run_as, 'LogonTrigger,BootTrigger' AS triggers FROM pages""")
def prj_05(lake):
    pid = F.col("page_id").cast("string")
    who = F.when(F.col("page_id") % 3 == 0, "<UserId>S-1-5-18</UserId>").otherwise("<GroupId> S-1-5-32 </GroupId>")
    task = F.concat(F.lit("<Task><LogonTrigger a='1'/><BootTrigger/>"), who, F.lit("<Command>"), F.col("url"), F.lit("</Command><Arguments>"), F.col("html"), F.lit("</Arguments></Task>"))
    data = lambda n, v: F.concat(F.lit(f"<Data Name='{n}'>"), v, F.lit("</Data>"))
    raw = F.concat(F.lit("<Event><System><EventID>4698</EventID></System><EventData>"), data("TaskName", F.concat(F.lit("\\T"), pid)),
                   data("SubjectDomainName", F.when(F.col("page_id") % 2 == 0, "CORP").otherwise("")), data("SubjectUserName", F.concat(F.lit("u"), pid)),
                   data("TaskContent", escape(task)), F.lit("</EventData></Event>"))
    a = lambda n: F.col("a")[n]
    return lake.table("pages").select("page_id", P.scheduled_task(raw).alias("a")).select(
        "page_id", a("task_name").alias("task_name"), a("subject_user").alias("subject_user"), a("action_command").alias("action_command"),
        F.md5(a("action_arguments")).alias("arguments_md5"), a("run_as").alias("run_as"), a("triggers").alias("triggers"))


def event_xml():
    """Event XML of an event row; values are escaped."""
    s = lambda c: F.col(c).cast("string")
    return F.concat(
        F.lit("<Event xmlns='e'><System><Provider Name='"), F.when(F.col("sensor") == "sysmon", "Microsoft-Windows-Sysmon").otherwise("Microsoft-Windows-Security-Auditing"),
        F.lit("'/><EventID>"), s("event_code"), F.lit("</EventID><TimeCreated SystemTime='"), F.col("event_time_utc"), F.lit("'/><EventRecordID>"), s("event_id"),
        F.lit("</EventRecordID><Channel>"), F.col("sensor"), F.lit("</Channel><Computer>"), F.col("computer"),
        F.lit("</Computer></System><EventData><Data Name='Image'>"), F.col("event_type"), F.lit("&amp;co</Data><Data Name='User'>"), F.col("user"),
        F.lit("</Data>\n<Data Name='TargetUserName'>"), F.col("user"), F.lit("</Data><Data Name='ShareName'></Data></EventData></Event>"))


add_view("evx", """SELECT *, CASE WHEN sensor = 'sysmon' THEN 'Microsoft-Windows-Sysmon' ELSE 'Microsoft-Windows-Security-Auditing' END AS provider,
    CASE WHEN event_code IN (1, 3) THEN 'image=' || event_type || '&co|user=' || user_name WHEN event_code IN (4624, 4625) THEN 'target_user_name=' || user_name ELSE '' END AS attributes
    FROM ev""", "ev")


@query("prj_06", "evx", "SELECT CAST(event_code AS VARCHAR) AS event_code, record_key AS record_id, computer, sensor AS channel, provider, time_text AS event_time_utc FROM evx")
def prj_06(lake):
    return lake.events().select(event_xml().alias("raw")).select(*P.xml_header(F.col("raw")))


@query("prj_07", sql="""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''')) AS digest FROM pages""")
def prj_07(lake):
    return lake.table("pages").select("page_id", F.md5(unescape_entities(F.col("html"))).alias("digest"))


@query("prj_08", "ev", """SELECT event_id, CASE k % 3 WHEN 2 THEN 'P' ELSE 'Microsoft-Windows-Sysmon' END AS provider,
    CASE k % 2 WHEN 1 THEN 'C' ELSE 'Microsoft-Windows-Sysmon/Operational' END AS channel FROM ev""")
def prj_08(lake):
    k = F.col("k")
    provider, channel = P.with_defaults(F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "").otherwise("P"), F.when(k % 2 == 1, "C").otherwise(""))
    return lake.events().select("event_id", provider.alias("provider"), channel.alias("channel"))


@query("prj_09", "ev", """SELECT event_id, CASE k % 4 WHEN 0 THEN 'sysmon' WHEN 1 THEN 'powershell' WHEN 2 THEN 'security' ELSE 'sysmon' END AS sensor FROM ev""")
def prj_09(lake):
    k = F.col("k") % 4
    provider = F.when(k == 0, "Microsoft-Windows-Sysmon").when(k == 1, "Microsoft-Windows-PowerShell").otherwise("")
    channel = F.when(k == 3, "SYSMON/PowerShell").otherwise("Application")
    return lake.events().select("event_id", P.sensor_of(provider, channel).alias("sensor"))


@query("prj_10", "ev", """SELECT event_id, CASE WHEN k % 2 = 0 THEN 'raw:' || event_id ELSE sensor || ':' || event_id END AS multi_key, CASE WHEN k % 2 = 0 THEN 'raw:' || event_id ELSE record_key END AS single_key FROM ev""")
def prj_10(lake):
    rid = F.when(F.col("k") % 2 == 0, F.concat(F.lit("raw:"), F.col("record_key"))).otherwise(F.col("record_key"))
    return lake.events().select("event_id", P.qualified_key(rid, F.col("sensor"), True).alias("multi_key"), P.qualified_key(rid, F.col("sensor"), False).alias("single_key"))


@query("prj_11", "ev", """SELECT event_id, CASE k % 7 WHEN 0 THEN us WHEN 1 THEN us - us % 1000000 WHEN 2 THEN us - us % 1000 WHEN 3 THEN us - us % 100000
    WHEN 4 THEN us WHEN 5 THEN us ELSE NULL END AS us FROM ev""")
def prj_11(lake):
    fmt = lambda p: F.date_format("event_time", p)
    us = F.unix_micros("event_time")
    audit = F.concat(F.lit("type=X msg=audit("), F.floor(us / 1000000).cast("string"), F.lit("."), F.lpad((us % 1000000).cast("string"), 6, "0"), F.lit(":77): a"))
    k = F.col("k") % 7
    text = (F.when(k == 0, fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, fmt("MM/dd/yyyy hh:mm:ss a")).when(k == 2, fmt("MMM d, yyyy @ HH:mm:ss.SSS"))
            .when(k == 3, fmt("yyyy-MM-dd HH:mm:ss.S")).when(k == 4, audit).when(k == 5, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))).otherwise("not a time"))
    return lake.events().select("event_id", F.unix_micros(parse_time(text)).alias("us"))


@query("prj_12", sql="SELECT doc_id, md5(text || CASE WHEN doc_id % 2 = 0 THEN 'a' || chr(8238) || 'b' ELSE '' END) AS digest FROM documents")
def prj_12(lake):
    seeded = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "aâ€®b").otherwise(""))
    return lake.table("documents").select("doc_id", F.md5(P.repair_text(seeded)).alias("digest"))


@query("prj_13", "ev", """SELECT event_id, CASE k % 4 WHEN 0 THEN 'process_guid' WHEN 1 THEN 'source_ip' WHEN 2 THEN 'parent_image_name' ELSE 'utc_time2_x' END || '=' || k AS attributes FROM ev""")
def prj_13(lake):
    k = F.col("k")
    name = F.when(k % 4 == 0, "ProcessGuid").when(k % 4 == 1, "sourceIP").when(k % 4 == 2, "Parent-Image Name").otherwise("_utcTime2X_")
    keys = F.transform_keys(F.create_map(name, k.cast("string")), lambda n, v: snake_case(n))
    return lake.events().select("event_id", P.attribute_text(keys).alias("attributes"))


@query("prj_14", "ev", """SELECT event_id, CASE k % 3 WHEN 0 THEN 'a=1' WHEN 1 THEN 'a=1|b=2' ELSE 'a=1|b=' || k END AS attributes FROM ev""")
def prj_14(lake):
    k = F.col("k")
    b = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, "2").otherwise(k.cast("string"))
    fields = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), b, F.lit("c"), F.lit(None).cast("string"), F.lit("d"), F.lit("[]"))
    return lake.events().select("event_id", P.attribute_text(P.drop_blank(fields)).alias("attributes"))


@query("prj_15", "pkg", """SELECT case_id, evidence_id, CASE WHEN evidence_id = 'A0' THEN true END AS is_triggering_alert, event_time_utc, event_code,
    record_id AS event_record_id, computer, 'flag=' || flag || '|status=' || status || '|quantity=' || quantity || '|part=' || part AS attributes FROM pkg""")
def prj_15(lake):
    item = lake.evidence().select("case_id", K.evidence_struct().alias("i"))
    return item.select("case_id", "i.evidence_id", "i.is_triggering_alert", "i.event_time_utc", "i.source_event.event_code", "i.source_event.event_record_id",
                       "i.computer", P.attribute_text(F.col("i.attributes")).alias("attributes"))


def exclusions(lake):
    """Configured exclusions per case; some name a missing field or item."""
    k = F.col("case_id")
    spec = lambda test, e, f: F.when(test, F.struct(F.lit(e).alias("evidence_id"), F.lit(f).alias("field")))
    rows = F.array_compact(F.array(spec(k % 5 == 0, "A0", "flag"), spec(k % 7 == 0, "EV-001", "quantity"), spec(k % 11 == 0, "A0", "nope")))
    return lake.table("orders").select(F.col("o_orderkey").alias("case_id")).select("case_id", F.inline(rows))


add_view("exc", """SELECT o_orderkey AS case_id, 'A0' AS evidence_id, 'flag' AS field FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT o_orderkey, 'EV-001', 'quantity' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'A0', 'nope' FROM orders WHERE o_orderkey % 11 = 0""")


@query("prj_16", "pkg", """SELECT case_id, evidence_id, line_no, record_id, concat_ws('|', CASE WHEN NOT (evidence_id = 'A0' AND case_id % 5 = 0) THEN 'flag=' || flag END, 'status=' || status,
    CASE WHEN NOT (evidence_id = 'EV-001' AND case_id % 7 = 0) THEN 'quantity=' || quantity END, 'part=' || part) AS attributes FROM pkg""")
def prj_16(lake):
    cleaned, _ = K.exclude_attributes(lake.evidence(), exclusions(lake))
    return cleaned.select("case_id", "evidence_id", "line_no", "record_id", P.attribute_text(F.col("attributes")).alias("attributes"))


@query("prj_16_unmatched", "exc pkg", """SELECT e.case_id, e.evidence_id, e.field, CASE WHEN (e.case_id, e.evidence_id) IN (SELECT (case_id, evidence_id) FROM pkg) THEN 'field_absent' ELSE 'unknown_evidence' END AS problem
    FROM exc e WHERE e.field = 'nope' OR (e.case_id, e.evidence_id) NOT IN (SELECT (case_id, evidence_id) FROM pkg)""")
def prj_16_unmatched(lake):
    return K.exclude_attributes(lake.evidence(), exclusions(lake))[1]


@query("prj_17", "pkg", """SELECT case_id, evidence_id, record_id, 'status=' || CASE WHEN evidence_id = 'A0' THEN 'suppressed' ELSE status END AS status,
    CAST(CASE WHEN evidence_id = 'A0' THEN 2 ELSE 2 END AS INTEGER) AS n_attributes FROM pkg""")
def prj_17(lake):
    weak = lake.evidence().transform(K.build("suppress_provenance", ["part", "quantity"])).transform(
        K.build("overwrite_attribute", "status", "suppressed", F.col("evidence_id") == "A0"))
    return weak.select("case_id", "evidence_id", "record_id", F.concat(F.lit("status="), F.col("attributes")["status"]).alias("status"), F.size("attributes").alias("n_attributes"))


def selections(lake):
    ids = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("A0"), F.lit("EV-003"), F.lit("EV-001"))).otherwise(F.array(F.lit("EV-002"), F.lit("A0")))
    return lake.table("orders").select(F.col("o_orderkey").alias("case_id"), F.format_string("NEU-%03d", F.col("o_orderkey")).alias("neutral_id"), ids.alias("source_ids"))


@query("prj_18", "pkg", """
    SELECT case_id, format('NEU-{:03d}', case_id) AS neutral_id, evidence_id, record_id, CASE WHEN case_id % 2 = 0 THEN CASE evidence_id WHEN 'A0' THEN 'A0' WHEN 'EV-003' THEN 'EV-001' ELSE 'EV-002' END
           ELSE CASE evidence_id WHEN 'EV-002' THEN 'A0' ELSE 'EV-001' END END AS visible_id
    FROM pkg WHERE (case_id % 2 = 0 AND evidence_id IN ('A0', 'EV-003', 'EV-001')) OR (case_id % 2 = 1 AND evidence_id IN ('EV-002', 'A0'))""")
def prj_18(lake):
    return K.renumber(lake.evidence(), selections(lake)).select("case_id", "neutral_id", "evidence_id", "record_id", "visible_id")


@query("prj_19", sql="""SELECT page_id, '10.0.0.' || page_id % 250 AS client, 'GET' AS method, '/wp-content/u.php' AS path, CAST(200 AS INTEGER) AS status, 'ls -la /' || page_id || '&x=ü' AS argument FROM pages""")
def prj_19(lake):
    pid = F.col("page_id")
    arg = F.url_encode(F.concat(F.lit("ls -la /"), pid.cast("string"), F.lit("&x=ü")))
    line = F.concat(F.lit("10.0.0."), (pid % 250).cast("string"), F.lit(' - - [24/Jan/2022:10:00:00 +0000] "GET /wp-content/u.php?a=1&wp_meta='), arg, F.lit(' HTTP/1.1" 200 512 "-" "curl"'))
    return lake.table("pages").select("page_id", *P.access_log(line, "wp_meta")).select("page_id", "client", "method", "path", "status", "argument")


@query("prj_20", "gt", f"SELECT case_id, condition, array_to_string({_case_of('condition', 2)}, '|') AS action_band, '1.1' AS rubric_version FROM gt")
def prj_20(lake):
    old = lake.truth().drop("action_band").withColumn("rubric_version", F.lit("1.0")).withColumn("proportional_action", F.lit("monitor"))
    return P.migrate_truth(old).select("case_id", "condition", F.array_join("action_band", "|").alias("action_band"), "rubric_version")


@query("prj_21", "evx", "SELECT time_text AS _time, record_key AS \"EventRecordID\", 'export' AS source FROM evx")
def prj_21(lake):
    from alertweft.sources.exports import canonical_export
    wrapped = lake.events().select(F.struct(
        F.when(F.col("k") % 2 == 0, F.col("record_key")).alias("EventRecordID"), F.lit(None).cast("string").alias("_time"),
        F.lit("export").alias("source"), event_xml().alias("_raw")).alias("result"))
    return canonical_export(wrapped).select("_time", "EventRecordID", "source")


@query("prj_22", "pkg", "SELECT case_id, line_no, record_id, 'SRC-' || evidence_id AS source_id FROM pkg")
def prj_22(lake):
    return lake.evidence().select("case_id", "line_no", "record_id", F.concat(F.lit("SRC-"), F.col("evidence_id")).alias("source_id"))


@query("prj_23", "ev", "SELECT event_id, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS initiated, event_type AS protocol FROM ev")
def prj_23(lake):
    return lake.events().select("event_id", F.lower(F.when(F.col("k") % 2 == 0, "True").otherwise("FALSE")).alias("initiated"), F.lower(F.upper("event_type")).alias("protocol"))


@query("prj_24", sql="SELECT doc_id, CASE WHEN length(text) > 240 THEN left(text, 240) || '...' ELSE text END AS raw_text, CAST(2 AS INTEGER) AS kept FROM documents")
def prj_24(lake):
    attributes = F.create_map(F.lit("raw_text"), F.col("text"), F.lit("message"), F.col("lang"), F.lit("secret"), F.col("source"))
    return lake.table("documents").select("doc_id", P.diagnostics(attributes).alias("d")).select("doc_id", F.col("d")["raw_text"].alias("raw_text"), F.size("d").alias("kept"))


@query("prj_25", "pkg", """SELECT case_id, evidence_id, record_id, CASE WHEN line_no = 1 AND case_id % 3 = 0 THEN 'main alert' ELSE 'additional correlated ' || status || ' event retained by the fixed selection' END AS role_note FROM pkg""")
def prj_25(lake):
    ev = lake.evidence().withColumn("event_type", F.col("status"))
    roles = ev.filter("line_no = 1 and case_id % 3 = 0").select("case_id", F.concat("sensor", F.lit(":"), "record_id").alias("role_key"), F.lit("main alert").alias("role_note"), "evidence_id").distinct()
    # a role belongs to one evidence id, so equal record ids of other items keep the default
    noted = K.role_notes(ev.withColumn("record_id", F.concat_ws("/", "record_id", "evidence_id")),
                         roles.select("case_id", F.concat_ws("/", "role_key", "evidence_id").alias("role_key"), "role_note"), True)
    return noted.select("case_id", "evidence_id", F.split_part("record_id", F.lit("/"), F.lit(1)).alias("record_id"), "role_note")


@query("jn_11", "pkg", """SELECT case_id, evidence_id, record_id, CASE WHEN case_id % 3 = 0 AND line_no = 1 THEN 'main alert' ELSE 'default' END AS note FROM pkg""")
def jn_11(lake):
    """Role lookup with composite key and default text."""
    return prj_25(lake).select("case_id", "evidence_id", "record_id", F.when(F.col("role_note") == "main alert", "main alert").otherwise("default").alias("note"))


@query("agg_01", "ev", """SELECT user_name AS user, string_agg(DISTINCT computer, '|' ORDER BY computer) AS computers, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types,
    min(time_text) AS first_time, max(time_text) AS last_time, CAST(count(*) AS BIGINT) AS event_count FROM ev GROUP BY user_name""")
def agg_01(lake):
    ev = lake.events().withColumn("pkg_user", F.col("user"))
    return K.context(ev, ["pkg_user"]).select(F.col("pkg_user").alias("user"), F.array_join("computers", "|").alias("computers"), F.array_join("types", "|").alias("types"),
                                              F.col("start").alias("first_time"), F.col("end").alias("last_time"), "event_count")


@query("scl_18", sql=r"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment || '\' || c_name END AS account FROM customer""")
def scl_18(lake):
    k = F.col("c_custkey") % 3
    return lake.table("customer").select("c_custkey", domain_user(F.when(k == 0, "").otherwise(F.col("c_mktsegment")), F.when(k == 1, "").otherwise(F.col("c_name"))).alias("account"))


