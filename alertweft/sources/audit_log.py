"""Linux audit records: field extraction and grouping of physical lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def audit_fields(line: Column) -> list[Column]:
    """Serial, system call number and instant of an audit line."""
    epoch = F.regexp_extract(line, r"audit\((\d+(?:\.\d+)?):", 1)
    return [
        F.regexp_extract(line, r"audit\([^:]+:(\d+)\)", 1).alias("serial"),
        F.coalesce(F.nullif(F.regexp_extract(line, r"\bsyscall=(\d+)\b", 1), F.lit("")).cast("int"), F.lit(0)).alias("syscall"),
        F.timestamp_micros((epoch.try_cast("decimal(20,6)") * 1000000).cast("bigint")).alias("event_time"),
    ]


def group_records(lines: DataFrame, member: str = "member", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Physical lines with the same serial become one logical event.

    A serial covers the handful of lines of one system call, so gathering its
    lines is bounded by the record format.
    """
    tagged = lines.select(member, line_no, line, F.regexp_extract(line, r"audit\([^:]+:(\d+)\)", 1).alias("serial")).filter("serial <> ''")
    grouped = tagged.groupBy(member, "serial").agg(
        F.min(line_no).alias("first_line"), F.array_sort(F.collect_list(F.struct(line_no, line))).alias("parts"))
    text = F.rtrim(F.array_join(F.transform("parts", lambda p: p[line]), "\n"))
    with_text = grouped.select(member, "serial", "first_line", text.alias("raw_text"))
    fields = audit_fields(F.col("raw_text"))
    return with_text.select("*", *fields[1:]).withColumn(
        "record_key", F.concat(F.col(member), F.lit(":audit:"), F.col("serial"))).withColumn("event_type", F.lit("linux_audit_group"))
