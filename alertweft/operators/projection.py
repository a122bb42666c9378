"""Event normalisation: raw records to the canonical event and evidence shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.fixed import (
    DEFAULT_CHANNEL, DEFAULT_PROVIDER, DIAGNOSTIC_FIELDS, DIAGNOSTIC_WIDTH, FIELD_MAP,
    NDJSON_SYSTEM_KEYS, SECURITY_PROVIDER, TEXT_REPAIRS,
)
from alertweft.functions.ordinal import policy_value
from alertweft.functions.text import domain_user, replace_all, str_map, unescape_entities


def stage_entries(df: DataFrame, entries: Column) -> DataFrame:
    """Hold (k, v) entries and their keys as columns, so later expressions read them instead of rebuilding them."""
    return df.withColumn("_e", entries).withColumn("_k", F.transform("_e", lambda e: e["k"]))


def first_wins() -> Column:
    """Map of the staged entries; the first value of a repeated key is kept."""
    return F.map_from_entries(F.filter("_e", lambda e, i: F.array_position("_k", e["k"]) == i + 1))


def last_wins() -> Column:
    """Map of the staged entries; the last value of a repeated key is kept."""
    return F.map_from_entries(F.filter("_e", lambda e, i: ~F.array_contains(F.slice("_k", i + 2, F.size("_k")), e["k"])))


def event_type(code: Column) -> Column:
    table = str_map({c: t for c, (t, _) in FIELD_MAP.items()})
    text = code.cast("string")
    return F.when(text == "4698", "scheduled_task_created").otherwise(F.coalesce(table[text], F.lit("other")))


#: alternate data names a mapped attribute has at most
_ALTERNATES = max(len(names) for _, fields in FIELD_MAP.values() for names, _ in fields if not isinstance(names, str))


def _field_spec() -> str:
    """Literal map of the event code to its (attribute, alternate data names) entries in output order."""
    arms = []
    for known, (_, fields) in FIELD_MAP.items():
        entries = []
        for names, attr in fields:
            names = [names] if isinstance(names, str) else list(names)
            given = [f"'{n}'" for n in names] + ["cast(null as string)"] * (_ALTERNATES - len(names))
            entries.append(f"struct('{attr}' as k, {', '.join(f'{n} as n{i}' for i, n in enumerate(given))})")
        arms.append(f"'{known}', array({', '.join(entries)})")
    return f"map({', '.join(arms)})"


_FIELD_SPEC = _field_spec()


def mapped_entries(code: str = "_c", data: str = "_data") -> Column:
    """(attribute, value) entries of a known code, of alternate names the first present one; null for other codes.

    A lookup in a literal and one small lambda: a CASE with an arm per code makes methods too long to be compiled.
    """
    return F.transform(F.expr(_FIELD_SPEC)[F.col(code)], lambda s: F.struct(
        s["k"].alias("k"), F.coalesce(*[F.col(data)[s[f"n{i}"]] for i in range(_ALTERNATES)]).alias("v")))


def project_attributes(df: DataFrame, code: Column, entries: Column, name: str = "attributes") -> DataFrame:
    """Add the ordered attribute map of every event.

    Known codes take the mapped names; of alternate names the first present one
    wins even when blank, and blank values are dropped.  Unknown codes keep
    every field unchanged, the last duplicate winning.
    """
    staged = stage_entries(df.withColumn("_c", code.cast("string")), entries).withColumn("_data", first_wins())
    mapped = staged.withColumn("_m", mapped_entries())
    kept = F.map_from_entries(F.filter("_m", lambda e: F.length(e["v"]) > 0))
    return mapped.withColumn(name, F.when(F.col("_m").isNull(), last_wins()).otherwise(kept)).drop("_c", "_e", "_k", "_data", "_m")


def drop_blank(attributes: Column) -> Column:
    """Remove null, blank and empty-list values."""
    return F.map_filter(attributes, lambda k, v: v.isNotNull() & (v != "") & (v != "[]"))


def attribute_text(attributes: Column) -> Column:
    """``k=v|k=v`` in map order, for reports and comparisons."""
    return F.array_join(F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


# -- event XML ------------------------------------------------------------------

def xml_tag(raw: Column, tag: str) -> Column:
    return F.regexp_extract(raw, rf"<{tag}[^>]*>([^<]*)", 1)


def xml_entries(raw: Column) -> Column:
    """(name, value) structs of the event data, in document order, entities resolved."""
    pattern = r"Name='([^']+)'>([^<]*)"
    names = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(raw, F.lit(pattern), F.lit(2))
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("k"), unescape_entities(v).alias("v")))


def xml_header(raw: Column) -> list[Column]:
    """System header columns; times stay text because they carry up to nine fractional digits."""
    time = F.regexp_extract(raw, r"SystemTime='([0-9T:\.\-]+)", 1)
    return [
        xml_tag(raw, "EventID").alias("event_code"), xml_tag(raw, "EventRecordID").alias("record_id"),
        xml_tag(raw, "Computer").alias("computer"), xml_tag(raw, "Channel").alias("channel"),
        F.regexp_extract(raw, r"<Provider Name='([^']+)'", 1).alias("provider"), F.concat(time, F.lit("Z")).alias("event_time_utc"),
    ]


def canonical_from_xml(raw_events: DataFrame, raw: str = "raw") -> DataFrame:
    """Canonical events from event XML, one narrow projection."""
    text = F.col(raw)
    headed = raw_events.select("*", *xml_header(text), F.sha2(text, 256).alias("raw_sha256"))
    headed = headed.withColumn("event_type", event_type(F.col("event_code")))
    mapped = project_attributes(headed, F.col("event_code"), xml_entries(text))
    return mapped.withColumn("attributes", F.when(F.col("event_code") == "4698", scheduled_task(text)).otherwise(F.col("attributes")))


def scheduled_task(raw: Column) -> Column:
    """Attributes of a task-creation event from its embedded task document."""
    content = F.regexp_extract(raw, r"(?s)Name='TaskContent'>(.*?)</Data>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#13;", "\r"), ("&#10;", "\n"), ("&amp;", "&")):
        content = F.replace(content, F.lit(entity), F.lit(char))
    inside = lambda pattern: F.trim(F.regexp_extract(content, "(?s)" + pattern, 1))
    data = lambda name: unescape_entities(F.regexp_extract(raw, f"Name='{name}'>([^<]*)", 1))
    user = inside(r"<UserId>(.*?)</UserId>")
    values = {
        "task_name": data("TaskName"),
        "subject_user": domain_user(data("SubjectDomainName"), data("SubjectUserName")),
        "action_command": inside(r"<Command>(.*?)</Command>"),
        "action_arguments": inside(r"<Arguments>(.*?)</Arguments>"),
        "run_as": F.when(user != "", user).otherwise(inside(r"<GroupId>(.*?)</GroupId>")),
        "run_level": inside(r"RunLevel>(.*?)</"),
        "author": inside(r"<Author>(.*?)</Author>"),
        "triggers": F.array_join(F.regexp_extract_all(content, F.lit(r"<(\w*Trigger)\b"), F.lit(1)), ","),
    }
    # as drop_blank, but without a lambda: that would leave generated code, where the content is prepared once for all values
    kept = {k: F.when(v.isNotNull() & (v != "") & (v != "[]"), v).otherwise("") for k, v in values.items()}
    return F.map_from_arrays(F.array_remove(F.array(*[F.when(v != "", k).otherwise("") for k, v in kept.items()]), ""),
                             F.array_remove(F.array(*kept.values()), ""))


# -- small normalisations ---------------------------------------------------------

def with_defaults(provider: Column, channel: Column) -> tuple[Column, Column]:
    blank = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    return blank(provider, DEFAULT_PROVIDER), blank(channel, DEFAULT_CHANNEL)


def sensor_of(*texts: Column) -> Column:
    """Sensor class from provider and channel text."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.when(F.contains(text, F.lit("sysmon")), "sysmon").when(F.contains(text, F.lit("powershell")), "powershell").otherwise("security")


def qualified_key(record_id: Column, sensor: Column, multi: bool) -> Column:
    """``sensor:record_id`` in multi-source cases, unless already qualified."""
    if not multi:
        return record_id
    return F.when(F.contains(record_id, F.lit(":")), record_id).otherwise(F.concat(sensor, F.lit(":"), record_id))


def repair_text(text: Column) -> Column:
    return replace_all(text, TEXT_REPAIRS)


def canonical_from_json(rows: DataFrame, fields: str = "fields", ordinal: str = "line_no") -> DataFrame:
    """Canonical events of flat NDJSON objects held as map<string,string>."""
    f = F.col(fields)
    code, channel = F.coalesce(f["EventID"], F.lit("")), F.coalesce(f["Channel"], F.lit(""))
    present = lambda k: F.nullif(f[k], F.lit(""))
    time = F.replace(F.trim(F.coalesce(present("UtcTime"), present("EventTime"), present("@timestamp"), F.lit(""))), F.lit(" "), F.lit("T"))
    default = F.when(F.contains(channel, F.lit("ysmon")), DEFAULT_PROVIDER).otherwise(SECURITY_PROVIDER)
    headed = rows.select(
        "*",
        F.coalesce(present("RecordNumber"), present("EventRecordID"), F.col(ordinal).cast("string")).alias("record_id"),
        code.alias("event_code"), event_type(code).alias("event_type"),
        F.coalesce(present("SourceName"), default).alias("provider"), channel.alias("channel"),
        F.coalesce(f["Hostname"], F.lit("")).alias("computer"), sensor_of(channel).alias("sensor"),
        F.when((time == "") | time.endswith("Z"), time).otherwise(F.concat(time, F.lit("Z"))).alias("event_time_utc"),
    )
    data = F.map_filter(f, lambda k, v: ~k.isin(NDJSON_SYSTEM_KEYS) & v.isNotNull() & (v != "") & (v != "[]"))
    entries = F.transform(F.map_entries(data), lambda e: F.struct(e["key"].alias("k"), repair_text(e["value"]).alias("v")))
    set_value = F.array(F.struct(F.lit("EventType").alias("k"), F.lit("SetValue").alias("v")))
    return project_attributes(headed, code, F.when(code == "13", F.concat(entries, set_value)).otherwise(entries))


def diagnostics(attributes: Column) -> Column:
    """The diagnostic attributes only, long values cut."""
    kept = F.map_filter(attributes, lambda k, v: k.isin(DIAGNOSTIC_FIELDS))
    return F.transform_values(kept, lambda k, v: F.when(
        F.length(v) > DIAGNOSTIC_WIDTH, F.concat(F.left(v, F.lit(DIAGNOSTIC_WIDTH)), F.lit("..."))).otherwise(v))


def migrate_truth(old: DataFrame) -> DataFrame:
    """Ground truth 1.0 to 1.1: the action band comes from the condition, the single action field goes."""
    return old.withColumn("action_band", policy_value(F.col("condition"), 2)).withColumn("rubric_version", F.lit("1.1")).drop("proportional_action")


def access_log(line: Column, parameter: str) -> list[Column]:
    """Fields of a combined access-log line and one decoded query parameter."""
    head = r'^(\S+) \S+ \S+ \[([^\]]*)\] "(\S+) (\S+) ([^"]*)" (\d{3}) (\d+|-)'
    part = lambda i: F.regexp_extract(line, head, i)
    raw = F.regexp_extract(part(4), rf"[?&]{parameter}=([^&#]*)", 1)
    return [
        part(1).alias("client"), part(3).alias("method"), part(4).alias("target"), F.split_part(part(4), F.lit("?"), F.lit(1)).alias("path"),
        part(5).alias("protocol"), part(6).cast("int").alias("status"), F.try_url_decode(raw).alias("argument"),
    ]

