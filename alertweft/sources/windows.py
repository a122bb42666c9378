"""Windows event readers: concatenated event XML, key=value stanzas, wide CSV, header-delimited blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertweft.fixed import SECURITY_PROVIDER, STANZA_MAP
from alertweft.functions.text import snake_case
from alertweft.functions.times import parse_time
from alertweft.operators.projection import canonical_from_xml, event_type, project_attributes
from alertweft.sources.byte_ranges import RANGE_BYTES, byte_records, line_text, raw_lines
from alertweft.sources.lines import read_records

STANZA_HEAD = r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2} [AP]M\s*$"
BLOCK_HEAD = r"^(?:Information|Error|Warning)\t"


def read_event_xml(spark: SparkSession, path: str) -> DataFrame:
    """One raw event per row from files of concatenated, root-less event elements.

    The closing tag is the record separator, so files split like line text.
    """
    parts = spark.read.option("lineSep", "</Event>").text(path)
    raw = F.regexp_extract(F.concat("value", F.lit("</Event>")), r"(?s)<Event\b.*</Event>", 0)
    return parts.filter(F.contains("value", F.lit("<Event"))).select(F.col("_metadata.file_path").alias("file"), raw.alias("raw")).filter("raw <> ''")


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """One raw stanza per row; blocks without an event code are dropped."""
    found = read_records(spark, path, F.col("line").rlike(STANZA_HEAD))
    return found.filter(F.contains("text", F.lit("EventCode="))).select("file", "block_index", F.col("text").alias("raw"))


def stanza_value(raw: Column, key: str) -> Column:
    return F.trim(F.regexp_extract(raw, rf"(?m)^{key}=(.*)$", 1))


def stanza_fields(raw: Column) -> Column:
    """(k, v) entries of the message: ``Field`` and ``Section|Field``, in text order.

    One regular expression finds all ``Name:`` lines; a name without a value
    opens the section of the entries after it.  What cannot match otherwise is not tried again (``++``).
    """
    message = F.when(F.contains(raw, F.lit("Message=")), F.regexp_extract(raw, r"(?s)Message=.*", 0)).otherwise(raw)
    line = F.lit(r"(?m)^\t*+([A-Za-z][A-Za-z /]++):(?:\t++(.*\S))?[ \t\r]*$")
    names, values = F.regexp_extract_all(message, line, F.lit(1)), F.regexp_extract_all(message, line, F.lit(2))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(F.trim(n).alias("n"), F.trim(v).alias("v")))
    empty = F.array().cast("array<struct<k:string,v:string>>")

    def step(acc, pair):
        own = F.struct(pair["n"].alias("k"), pair["v"].alias("v"))
        full = F.struct(F.concat(acc["section"], F.lit("|"), pair["n"]).alias("k"), pair["v"].alias("v"))
        added = F.when(acc["section"] == "", F.array(own)).otherwise(F.array(own, full))
        opens = pair["v"] == ""
        return F.when(opens, F.struct(pair["n"].alias("section"), acc["found"].alias("found"))).otherwise(
            F.struct(acc["section"].alias("section"), F.concat(acc["found"], added).alias("found")))

    return F.aggregate(pairs, F.struct(F.lit("").alias("section"), empty.alias("found")), step, lambda acc: acc["found"])


def _stanza_spec() -> str:
    """Literal map of the event code to its (data name, sectioned field, plain field) entries."""
    arms = []
    for known, fields in STANZA_MAP.items():
        entries = [f"struct('{xml}' as k, '{src}' as full, '{src.split('|')[-1]}' as plain)" for src, xml in fields.items()]
        arms.append(f"'{known}', array({', '.join(entries)})")
    return f"map({', '.join(arms)})"


def _stanza_entries() -> Column:
    """(data name, value) entries of the code's fields; the plain field stands in for a sectioned one.

    A lookup in a literal and one small lambda: a CASE with an arm per code makes methods too long to be compiled.
    """
    value = lambda n: F.get("_found", F.nullif(F.array_position("_names", n), F.lit(0)).cast("int") - 1)["v"]
    return F.transform(F.expr(_STANZA_SPEC)[F.col("event_code")], lambda s: F.struct(
        s["k"].alias("k"), F.coalesce(value(s["full"]), value(s["plain"])).alias("v")))


_STANZA_SPEC = _stanza_spec()


def canonical_from_stanza(raws: DataFrame, raw: str = "raw") -> DataFrame:
    """Canonical events of raw stanzas; the first value of a repeated field wins."""
    text = F.col(raw)
    code = stanza_value(text, "EventCode")
    time = F.regexp_extract(text, r"^\s*(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2} [AP]M)", 1)
    iso = F.concat(F.date_format(parse_time(time), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000000Z"))
    headed = raws.select(
        "*", code.alias("event_code"), stanza_value(text, "RecordNumber").alias("record_id"), stanza_value(text, "ComputerName").alias("computer"),
        F.lit("Security").alias("channel"), F.lit(SECURITY_PROVIDER).alias("provider"), F.coalesce(iso, F.lit("Z")).alias("event_time_utc"),
        F.sha2(text, 256).alias("raw_sha256"), event_type(code).alias("event_type"), stanza_fields(text).alias("_found"),
    ).withColumn("_names", F.transform("_found", lambda e: e["k"]))
    arms = F.coalesce(_stanza_entries(), F.array().cast("array<struct<k:string,v:string>>"))
    entries = F.filter(arms, lambda e: F.length(e["v"]) > 0)
    return project_attributes(headed, F.col("event_code"), entries).drop("_found", "_names")


def canonical_mixed(raws: DataFrame) -> DataFrame:
    """Raw XML and raw stanzas in one column: each branch parsed by its own reader, then united.

    The whole text decides.  A row of neither kind stays as it is, with its hash
    and the event type ``unrecognised``; its parsed columns are null.
    """
    raws = raws.withColumn("raw", F.coalesce("raw", F.lit("")))
    is_xml = F.contains("raw", F.lit("<Event"))
    stanza = ~is_xml & F.contains("raw", F.lit("EventCode="))
    parsed = canonical_from_xml(raws.filter(is_xml)).unionByName(canonical_from_stanza(raws.filter(stanza)))
    other = raws.filter(~is_xml & ~stanza).withColumn("raw_sha256", F.sha2("raw", 256)).withColumn("event_type", F.lit("unrecognised"))
    return parsed.unionByName(other, allowMissingColumns=True)


_CSV_TYPES = {1: "process_create", 3: "network_connection", 7: "image_load", 5611: "system_state"}
_CSV_DATA = "_source.data.win.eventdata."


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events of a flattened search-index CSV.

    Quoted line breaks rule splitting out, so a large export should be split by
    index before it is landed; rows without an id are dropped.
    """
    csv = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    names = [c.lstrip("\ufeff") for c in csv.columns]
    csv = csv.toDF(*names)
    col = lambda n: F.coalesce(F.col(f"`{n}`"), F.lit("")) if n in names else F.lit("")
    code_text = F.trim(col("_source.data.win.system.eventID"))
    code = F.when(code_text.rlike(r"^\d+$"), code_text.try_cast("int")).otherwise(0)
    first = lambda a, b: F.when(F.trim(a) != "", F.trim(a)).otherwise(F.trim(b))
    fixed = {"source_partition": col("_index"), "full_log": col("_source.full_log"), "message": col("_source.data.win.system.message"), "agent_name": col("_source.agent.name")}
    data = [n for n in names if n.startswith(_CSV_DATA)]
    pairs = [x for n in data for x in (snake_case(F.lit(n[len(_CSV_DATA):])), F.replace(F.trim(col(n)), F.lit("\\\\"), F.lit("\\")))]
    extra = F.map_filter(F.create_map(*pairs), lambda k, v: v != "") if pairs else F.create_map().cast("map<string,string>")
    attributes = F.map_concat(F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), v)]), extra)
    kind = F.create_map(*[F.lit(x) for p in _CSV_TYPES.items() for x in p])[F.col("event_code")]
    status = F.when(F.contains(col("_source.full_log"), F.lit("Agent disconnected:")), "monitoring_status").otherwise("external_record")
    shaped = csv.filter(col("_id") != "").withColumn("event_code", code)
    return shaped.select(
        F.col("_id").alias("record_key"), first(col("_source.data.win.system.systemTime"), col("_source.@timestamp")).alias("event_time_utc"), "event_code",
        F.coalesce(kind, status).alias("event_type"), col("_source.data.win.system.providerName").alias("provider"), col("_source.data.win.system.channel").alias("channel"),
        first(col("_source.data.win.system.computer"), col("_source.agent.name")).alias("computer"), attributes.alias("attributes"))


def read_blocks(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Header-delimited multi-line records with block index, first line and the byte range ``[byte_start, byte_end)`` of each."""
    lines = raw_lines(spark, path, range_bytes)
    found = byte_records(lines, line_text(F.col("raw")).rlike(BLOCK_HEAD))
    return canonical_blocks(found.withColumn("text", F.regexp_replace(F.replace(F.decode("raw", "UTF-8"), F.lit("\r\n"), F.lit("\n")), r"\s+\z", "")))


def canonical_blocks(found: DataFrame) -> DataFrame:
    text = F.rtrim(F.col("text"))
    code = F.regexp_extract(text, r"Microsoft-Windows-Sysmon\t(\d+)\t", 1)
    time = F.regexp_extract(text, r"(?m)^(\d{4}-\d{2}-\d{2} [0-9:.]+)\s*$", 1)
    place = [c for c in ("first_line", "byte_start", "byte_end") if c in found.columns]
    return found.select(
        "file", "block_index", *place, F.when(code == "", 0).otherwise(code.try_cast("int")).alias("event_code"), F.lit("windows_event_block").alias("event_type"),
        F.when(time == "", "").otherwise(F.concat(F.replace(time, F.lit(" "), F.lit("T")), F.lit("Z"))).alias("event_time_utc"), text.alias("raw_text"))
