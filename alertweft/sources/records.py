"""NDJSON, plain text, archives and the format dispatch."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from alertweft.functions.times import parse_time
from alertweft.operators.projection import canonical_from_json
from alertweft.session import ship
from alertweft.sources.audit_log import group_records
from alertweft.sources.lines import blocks, read_lines
from alertweft.sources.windows import BLOCK_HEAD, canonical_blocks

_BATCH = 20_000
ship(__name__)


def read_flat_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, fields) of flat NDJSON; blank and malformed lines are skipped but counted."""
    lines = read_lines(spark, path)
    return lines.select("file", "line_no", F.from_json("line", "map<string,string>").alias("fields")).filter("fields is not null")


def read_flat_events(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events of flat NDJSON."""
    return canonical_from_json(read_flat_json(spark, path))


def json_members(lines: DataFrame) -> DataFrame:
    """Canonical events of JSON lines of archive members, located as ``member:line:n``."""
    record = lines.select("member", "line_no", F.rtrim("line").alias("raw_text"), F.try_parse_json("line").alias("record")).filter(
        "raw_text <> '' and record is not null")
    text = lambda p: F.try_variant_get("record", p, "string")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return record.select(
        F.concat("member", F.lit(":line:"), F.col("line_no").cast("string")).alias("record_key"), blank(text("$['@timestamp']")).alias("event_time_utc"),
        F.coalesce(F.nullif(text("$.agent.name"), F.lit("")), text("$.AMiner.ID"), F.lit("")).alias("computer"), "record", "raw_text")


def text_members(lines: DataFrame) -> DataFrame:
    """Canonical events of plain text lines; the time comes from an audit stamp when there is one."""
    kept = lines.select("member", "line_no", F.rtrim("line").alias("raw_text")).filter("raw_text <> ''")
    audit = F.when(F.col("raw_text").rlike(r"audit\(\d"), parse_time(F.regexp_extract("raw_text", r"audit\(\d+(?:\.\d+)?:", 0)))
    return kept.select(F.concat("member", F.lit(":line:"), F.col("line_no").cast("string")).alias("record_key"), audit.alias("event_time"), "raw_text")


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of every member of every archive, streamed member by member."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in archive.namelist():
                    if member.endswith("/"):
                        continue
                    rows: list[tuple[int, str]] = []
                    with archive.open(member) as handle:
                        for number, line in enumerate(handle, start=1):
                            rows.append((number, line.rstrip(b"\r\n").decode("utf-8", errors="replace")))
                            if len(rows) == _BATCH:
                                yield _frame(path, member, rows)
                                rows = []
                    if rows:
                        yield _frame(path, member, rows)


def _frame(path: str, member: str, rows: list[tuple[int, str]]) -> pd.DataFrame:
    return pd.DataFrame({"archive": path, "member": member, "line_no": [r[0] for r in rows], "line": [r[1] for r in rows]})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, line_no, line) of ZIP archives.

    ZIP is not splittable: one task expands one archive.  Land the result as
    parquet once and read that afterwards.
    """
    return expand_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path))


def expand_archives(files: DataFrame) -> DataFrame:
    """The same of archives already held in a table of (path, content)."""
    return files.select("path", "content").mapInPandas(_expand, "archive string, member string, line_no long, line string")


def resolve_members(members: DataFrame, requested: DataFrame) -> DataFrame:
    """(requested, matches, member): exact name first, else the only entry ending in ``/name``."""
    names = members.select("archive", "member").distinct()
    tails = names.withColumn("parts", F.split("member", "/")).select("archive", "member", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))).alias("requested"))
    hits = requested.join(tails, "requested", "left").withColumn("exact", F.coalesce(F.col("requested") == F.col("member"), F.lit(False)))
    grouped = hits.groupBy("requested").agg(
        F.count("member").alias("n"), F.max(F.when(F.col("exact"), F.col("member"))).alias("exact_member"), F.min("member").alias("any_member"))
    return grouped.select(
        "requested", F.when(F.col("exact_member").isNotNull(), 1).otherwise(F.col("n")).cast("bigint").alias("matches"),
        F.coalesce("exact_member", F.when(F.col("n") == 1, F.col("any_member"))).alias("member"))


# Registry of source formats: name -> function of (file, line_no, line, member) lines.
FORMATS = {
    "json": json_members,
    "text": text_members,
    "audit": lambda lines: group_records(lines).select("record_key", "event_time", "raw_text"),
    "blocks": lambda lines: canonical_blocks(
        blocks(lines.withColumnRenamed("member", "file").withColumn("chunk", F.lit(0)), F.col("line").rlike(BLOCK_HEAD))
    ).select(F.concat("file", F.lit(":block:"), F.col("block_index").cast("string")).alias("record_key"), "event_time_utc", "event_code", "raw_text"),
}


def dispatch(lines: DataFrame, units: dict[str, list[str]]) -> DataFrame:
    """Parse each declared source unit by its format and unite the canonical rows."""
    unknown = set(units) - set(FORMATS)
    if unknown:
        raise ValueError(f"unsupported source formats: {sorted(unknown)}")
    parsed = [FORMATS[name](lines.filter(F.col("member").isin(members))) for name, members in units.items()]
    result = parsed[0]
    for part in parsed[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result
